"""The three classifiers: held-out accuracy on made-up text, agreement with brute force, and the edges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.llm import language, quality, toxicity
from vitrine.llm.common import bytes_of, fold, fold_column

from .conftest import words

SYLLABLES = {"aa": ("the", "an", "ti", "on"), "bb": ("der", "sch", "ung", "ö"), "cc": ("ción", "os", "la", "ñ")}
BAD = ("worthless", "pathetic", "moronic")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    rows = []
    for i in range(700):
        lang = rng.choice(sorted(SYLLABLES))
        text = words(rng, rng.randint(20, 200), SYLLABLES[lang])
        good, toxic = rng.random() < 0.8, rng.random() < 0.2
        if not good:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        if toxic:
            parts = text.split()
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(BAD))
            text = " ".join(parts)
        rows.append((i, text, lang, int(good), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(r[0], r[1], r[2], "x") for r in corpus], "doc_id long, text string, lang string, score string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark, corpus):
    return spark.createDataFrame([(r[0], r[3], r[4]) for r in corpus] + [(None, 1, 1), (99_999, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def check(found, corpus, column, parts, held):
    truth = {r[0]: r[column] for r in corpus}
    assert len(found) == len(corpus)
    right = []
    for r in found:
        assert r["held_out"] == (fold(r["doc_id"], parts) == held) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["held_out"]:
            right.append(r["predicted"] == truth[r["doc_id"]])
    assert np.mean(right) > 0.95, np.mean(right)


def test_quality(spark, docs, labels, corpus, edges, nothing):
    check(quality.classify(docs, labels).collect(), corpus, 3, 5, 0)
    kept = quality.keep_good(docs, docs, labels)
    good = {r[0] for r in corpus if r[3]}
    assert kept.columns == docs.columns and len({r["doc_id"] for r in kept.collect()} ^ good) < 20
    found = quality.classify(edges, labels).collect()
    assert len(found) == edges.count() and all(r["score"] is not None for r in found)
    both = quality.score(edges.select("doc_id", "text"), quality.learn(docs, labels)).collect()
    assert len({r["score"] for r in both if r["text"] in (None, "")}) == 1
    assert quality.classify(nothing, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_votes_are_those_of_all_neighbours():
    rng = np.random.default_rng(1)
    texts = [words(random.Random(i), 40, SYLLABLES["aa" if i % 2 else "cc"]) for i in range(120)]
    counts = quality.term_counts(*bytes_of(pa.array(texts)))
    y = np.array([i % 2 for i in range(80)])
    model = quality.fit(counts[:80], y, rng.uniform(1, 3, 80), 16)
    found = quality.vote(model, counts[80:])
    for i, v in enumerate(found):
        q = counts[80 + i] * model.idf
        q = (q / np.linalg.norm(q)) @ model.basis
        near = model.vectors @ (q / np.linalg.norm(q))
        best = np.argsort(-near)[: quality.NEAREST]
        w = np.maximum(near[best], 0) ** 8
        total = (w[:, None] * model.votes[best]).sum(axis=0)
        assert abs(v - total[0] / total[1]) < 1e-3


def test_toxicity(spark, docs, labels, corpus, edges, nothing):
    check(toxicity.classify(docs, labels).collect(), corpus, 4, 4, 2)
    model = toxicity.learn(docs, labels)
    plain = words(random.Random(1), 5000, SYLLABLES["aa"])
    tests = [(1, plain), (2, plain + " you are WORTHLES"), (3, plain[:12_000] + " pathetik. " + plain[12_000:]), (4, ""), (5, None), (6, "...")]
    out = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert out[1] < 0.3 <= out[2] and out[3] >= 0.3  # misspelt, in a long text
    assert out[4] == out[5] == out[6] == 0
    assert toxicity.classify(edges, labels).count() == edges.count() and toxicity.classify(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity.classify(docs, labels.filter("toxic = 0")).collect()} == {0.0}


def test_held_out_labels_change_nothing(spark, docs, labels):
    for module, name, parts, held in ((quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)):
        turned = labels.withColumn(name, F.when(fold_column(F.col("doc_id"), parts) == held, 1 - F.col(name)).otherwise(F.col(name)))
        assert turned.exceptAll(labels).count() > 50
        one, other = ({r["doc_id"]: r["score"] for r in module.classify(docs, x).collect()} for x in (labels, turned))
        assert one == other
    one, other = ({r["doc_id"] for r in quality.keep_good(docs, docs, x).collect()} for x in (labels, labels.filter(fold_column(F.col("doc_id"), 5) != 0)))
    assert one == other


def toxic_by_hand(model, text):
    """A text's logit word by word and n-gram by n-gram."""
    runs, word = [], b""
    for b in text.encode():
        c = toxicity._KEPT[b]
        if c:
            word += bytes([c])
        elif word:
            runs, word = [*runs, word], b""
    runs += [word] if word else []
    best = -math.inf
    for i in range(0, len(runs), toxicity.WORDS):
        pulls = []
        for word in runs[i : i + toxicity.WORDS]:
            padded = b"\0" + word + b"\0"
            for n in toxicity.GRAMS:
                for gram in (padded[j : j + n] for j in range(len(padded) - n + 1)):
                    h = 0
                    for c in gram:
                        h = (h * 0x01000193 + c) % 2**32
                    h = ((h ^ (h >> 13)) * 0x5BD1E995 + n - 1) % 2**32
                    pulls.append(float(model.pull[h >> 15]))
        best = max(best, sum(pulls) / max(1, len(pulls)) + model.bias)
    return best


def test_toxicity_by_hand():
    rng = np.random.default_rng(8)
    model = toxicity.Subwords(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.25)
    texts = ["", "one", "a", "  a bc\n", words(random.Random(3), 100), "é" * 9 + "x" * 40, "x y z " * 9, "日本語のテキスト word " * 30, "A-B c3!" * 50]
    for text, found in zip(texts, toxicity.text_logits(model, *bytes_of(pa.array(texts))), strict=True):
        assert found == pytest.approx(toxic_by_hand(model, text), abs=1e-4)
        for step in (7, 64, 1 << 18):
            assert toxicity.long_text_logit(model, np.frombuffer(text.encode(), np.uint8), step) == pytest.approx(found, abs=1e-4)


def test_toxic_training_follows_the_gradient():
    """A step moves each parameter against the numerical gradient of the cross-entropy."""
    texts = [words(random.Random(i), 20) for i in range(6)]
    labels = np.array([0, 1, 0, 1, 1, 0])
    t = toxicity.Trainer(*bytes_of(pa.array(texts)), labels, 4, 1)
    pick = np.arange(len(t.of))

    def loss(out, bias):
        total = 0.0
        for w in pick:
            logits = t.embedding[t.bags[t.bounds[w] : t.bounds[w + 1]]].astype(float).mean(axis=0) @ out + bias
            total += np.log(np.exp(logits).sum()) - logits[labels[t.of[w]]]
        return total

    out, bias, eps = t.out.astype(float), t.bias.astype(float), 1e-5
    grad = np.zeros_like(out)
    for i in np.ndindex(out.shape):
        step = np.zeros_like(out)
        step[i] = eps
        grad[i] = (loss(out + step, bias) - loss(out - step, bias)) / (2 * eps)
    before = t.out.copy()
    t.step(pick, 0.1)
    clear = np.abs(grad) > 0.01
    assert clear.any() and (np.sign(before - t.out)[clear] == np.sign(grad)[clear]).all()


def test_very_long_texts_in_bounded_memory():
    import tracemalloc

    text = np.frombuffer((words(random.Random(5), 2000) + " ").encode() * 600, np.uint8)
    model = toxicity.Subwords(np.zeros(toxicity.BUCKETS, np.float32), 0.0)
    for run in (lambda: toxicity.long_text_logit(model, text), lambda: quality.trigram_counts(text)):
        tracemalloc.start()
        run()
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
        tracemalloc.stop()


def test_every_window_is_read():
    rng = np.random.default_rng(2)
    model = toxicity.Subwords(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.5)
    texts = ["", "one", "  a bc\n", words(random.Random(3), 100), "é" * 9, "x y z " * 9]
    data, ends = bytes_of(pa.array(texts))
    together = toxicity.text_logits(model, data, ends)
    apart = [toxicity.text_logits(model, *bytes_of(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, apart, atol=1e-4) and together[0] == -np.inf
    w = texts[3].split()
    halves = [toxicity.text_logits(model, *bytes_of(pa.array([" ".join(w[i : i + toxicity.WORDS])])))[0] for i in range(0, 100, toxicity.WORDS)]
    assert abs(max(halves) - together[3]) < 1e-4


def test_language(spark, docs, corpus, edges, nothing):
    found = language.identify(docs).collect()
    truth = {r[0]: r[2] for r in corpus}
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(corpus) and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in found)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    net = language.learn(docs)
    out = {(r["doc_id"], r["text"] and r["text"][:9]): r for r in language.predict(edges.drop("score"), net).collect()}
    for (_, text), r in out.items():
        if text in (None, "", "  \t\n ", "... !!! -"):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in SYLLABLES and 0 < r["score"] <= 1
    assert language.identify(nothing).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
    mixed = spark.createDataFrame([(1, " ".join(words(random.Random(i), 300, SYLLABLES[x]) for i, x in enumerate(SYLLABLES)), "x")], "doc_id long, text string, vitrine_lang string")
    assert language.keep_known(mixed, docs).collect() == mixed.collect()  # in three known languages
    kept = language.keep_known(edges, docs)
    assert kept.columns == edges.columns and all(r["text"] for r in kept.collect())


def test_tables_are_the_network():
    rng = np.random.default_rng(4)
    windows = rng.integers(0, 256, (5, language.WINDOW + 3)).astype(np.uint8)
    f = 3
    net = language.ByteNet(("a", "b"), rng.normal(size=(256, 4)).astype(np.float32), tuple(rng.normal(size=(w, 4, f)).astype(np.float32) for w in language.WIDTHS), tuple(rng.normal(size=f).astype(np.float32) for _ in language.WIDTHS), rng.normal(size=(3 * f, 2)).astype(np.float32), np.zeros(2, np.float32))
    seen = net.embedding[windows]
    features = np.concatenate([(sum(seen[:, k : k + language.WINDOW] @ bank[k] for k in range(w)) + s).max(axis=1) for w, bank, s in zip(language.WIDTHS, net.filters, net.shifts, strict=True)], axis=1)
    expected = language.softmax(np.maximum(features, 0) @ net.out + net.bias)
    assert np.allclose(language.Predictor(net).probabilities(windows), expected, atol=1e-4)
    assert language.windows_of(np.arange(300) % 256).shape == (2, language.WINDOW + 3) and language.windows_of(np.zeros(0, np.uint8)).shape == (1, language.WINDOW + 3)
