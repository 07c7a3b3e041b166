"""The pipeline over the smallest tables, stage by stage, against brute force on each stage's own input."""

import re
from pathlib import Path

import pandas as pd
import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What went into each stage and what came out."""
    folder = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        before = docs.toPandas()
        f(spark, docs, SF_DIR).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        found[name] = (before, docs.toPandas())
    return found


def shingles(text, n=5):
    w = text.encode().lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(w[i : i + n])) for i in range(len(w) - n + 1)} or {xxhash.xxh64_intdigest(b" ".join(w))}


def test_columns_stay_and_rows_only_go(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_dedup", "decontaminate", "pack"] and corpus_pipeline.ORACLE_SQL is None
    for name in names[:-1]:
        before, after = stages[name]
        assert list(after.columns) == list(before.columns)
        merged = after.merge(before, how="left", indicator=True)
        assert (merged["_merge"] == "both").all() and after["doc_id"].is_unique


def test_quality_and_language_keep_what_is_good(stages):
    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet").set_index("doc_id").quality
    before, after = stages["quality"]
    kept = before["doc_id"].isin(after["doc_id"])
    mark = before["doc_id"].map(labels)
    assert kept[mark == 1].mean() > 0.97 and kept[mark == 0].mean() < 0.5
    before, after = stages["language"]
    assert len(after) > 0.97 * len(before)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    sets = dict(zip(before["doc_id"], map(shingles, before["text"]), strict=True))
    kept = set(after["doc_id"])
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    both = [p for p, s in alike.items() if s >= 0.85 and p[0] in kept and p[1] in kept]
    assert not both
    for gone in set(sets) - kept:
        assert max(alike[min(gone, k), max(gone, k)] for k in sets if k != gone) >= 0.5


def test_no_passage_of_the_benchmark_stays(stages):
    def grams(text, n=8):
        w = re.findall(r"[^\W_]+", text.lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    bench = set().union(*(grams(t) for t in pd.read_parquet(f"{SF_DIR}/benchmark.parquet")["text"]))
    before, after = stages["decontaminate"]
    dirty = {k for k, t in zip(before["doc_id"], before["text"], strict=True) if grams(t) & bench}
    assert set(before["doc_id"]) - set(after["doc_id"]) == dirty


def test_all_that_is_left_is_packed(stages):
    before, after = stages["pack"]
    assert set(after["doc_id"]) == set(before["doc_id"])
    used = after.groupby("sequence_id")["length"].sum()
    assert used.max() <= 2048 and len(used) <= 1.05 * -(-after["length"].sum() // 2048) + 1


def test_run_is_the_stages(spark, stages):
    out = corpus_pipeline.run(spark, SF_DIR).toPandas()
    expected = stages["pack"][1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert out[key].sort_values(key).reset_index(drop=True).equals(expected[key].sort_values(key).reset_index(drop=True))


def test_python_gets_few_texts_at_once(spark):
    """In the stages whose result runs after they have returned, too; the session's number is set back."""

    def count(batches):
        for batch in batches:
            yield type(batch).from_pydict({"n": [len(batch)]})

    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.read.parquet(f"{SF_DIR}/documents.parquet")
    many, before = docs.crossJoin(spark.range(20)).drop("id").coalesce(1), spark.conf.get(key)
    for f in (corpus_pipeline.good_quality, corpus_pipeline.known_language):
        sizes = [r["n"] for r in f(spark, many, SF_DIR).mapInArrow(count, "n long").collect()]
        assert max(sizes) <= 1024 < sum(sizes)
    corpus_pipeline.near_dedup(spark, docs.limit(20), SF_DIR)
    assert spark.conf.get(key) == before
