import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vitrine.llm import packing
from vitrine.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


TEXT = st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("'’—…€ \n\t\x85\xa0\x1cΣσ日İ1²½_!é")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_are_the_tokenizers(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_word_ids_are_the_tokenizers, "t") else test_word_ids_are_the_tokenizers.t
    test_word_ids_are_the_tokenizers.t = t
    assert packing.word_ids(PATH).ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_tokens_and_contractions(tokenizer):
    for text in ("a <|endoftext|> b", "<|startoftext|>", "It's they'll I'd we've I'm 'tis ''s", "x<|y", "ŉ ǆ ß İstanbul", "á ó"):
        assert packing.word_ids(PATH).ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@given(st.lists(st.tuples(st.integers(1, 50), st.booleans()), max_size=80), st.integers(1, 6))
def test_ranges_match_as_one_sweep_would(rows, ranges):
    rows = sorted(((size, piece, i) for i, (size, piece) in enumerate(rows)), key=lambda r: (-r[0], r[1], r[2]))
    whole = {(m[0], m[2]) for m in packing.sweep(rows)[0]}
    cuts = [len(rows) * i // ranges for i in range(ranges + 1)]
    found, left, free, counts = set(), {}, {}, []
    for at in range(ranges):
        matches, pieces, gaps = packing.sweep(rows[cuts[at] : cuts[at + 1]])
        found |= {(m[0], m[2]) for m in matches}
        left[at], free[at] = pieces, gaps
        counts.append((at, len(pieces), len(gaps)))
    for at, first, end, other, gap in packing.meet(counts):
        found |= {(left[at][r][0], free[other][gap + r - first][0]) for r in range(first, end)}
    assert found == whole
    size = {i: s for s, _, i in rows}
    assert all(size[p] <= size[g] for p, g in found)


def check_packed(rows, texts, tokenizer, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for r in by_sequence.values():
        place = 0
        for x in sorted(r, key=lambda x: x["offset"]):
            assert x["offset"] == place
            place += x["length"]
        assert place <= capacity
    expected = defaultdict(list)
    for key, text in texts:
        whole = ids(tokenizer, text)
        for piece, start in enumerate(range(0, len(whole), capacity)):
            part = whole[start : start + capacity]
            expected[key].append((piece, start, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in expected.items()}
    return len(by_sequence), sum(r["length"] for r in rows)


def test_pack_edges(spark, edges, edge_rows, nothing, tokenizer):
    n, tokens = check_packed(packing.pack(edges).collect(), [(r[0], r[1]) for r in edge_rows], tokenizer, 2048)
    assert n <= -(-tokens // 2048) + 1
    out = packing.pack(nothing)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0


def test_pack_is_near_the_least(spark, tokenizer):
    rng = random.Random(1)
    texts = [(i, "a " * (rng.randrange(1, 200) if i % 3 else 0)) for i in range(900)]  # a third are of one token
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), capacity=64).collect()
    n, tokens = check_packed(rows, texts, tokenizer, 64)
    assert n <= 1.03 * -(-tokens // 64)


def test_rounds_in_one_task_have_the_same_outcome(spark, monkeypatch):
    rng = random.Random(7)
    sizes = spark.createDataFrame([(i, rng.choice((1, 1, 2, rng.randint(1, 63)))) for i in range(700)], "id long, size long")
    together = sorted(map(tuple, packing.best_fit(sizes, 64).collect()))
    monkeypatch.setattr(packing, "FINISH", 200)
    assert sorted(map(tuple, packing.best_fit(sizes, 64).collect())) == together
    monkeypatch.setattr(packing, "FINISH", -1)
    assert sorted(map(tuple, packing.best_fit(sizes, 64).collect())) == together
    total = sum(r["size"] for r in sizes.collect())
    assert len({r[1] for r in together}) <= 1.02 * -(-total // 64) + 1


@given(st.lists(st.integers(1, 99), max_size=60))
def test_all_rounds(sizes):
    found = list(packing.all_rounds([(s, i) for i, s in enumerate(sizes)], {}, 0, 100))
    assert sorted((i, s) for i, s, _, _ in found) == list(enumerate(sizes))
    used = defaultdict(int)
    for _, size, to, _ in found:
        used[to] += size
    assert all(n <= 100 for n in used.values())


def test_best_fit_of_equal_sizes(spark):
    sizes = spark.range(5000).selectExpr("id", "1L AS size")
    assert packing.best_fit(sizes, 100).select("bin").distinct().count() == 50
