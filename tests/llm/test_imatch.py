import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import imatch


def mixed(x, seed):
    x = (x + seed * 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def by_hand(text, words):
    """The parts of a fingerprint, term by term and subset by subset."""
    terms = {w for w in re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower()) if w in words}
    keys = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in sorted(terms)]
    parts = []
    for level in range(1, 10):
        for subset in range(16):
            kept = [mixed(k, 99) | 1 for k in keys if mixed(k, subset + 1) / 2**64 < 0.5**level]
            parts.append(mixed(sum(kept) % 2**64, 7) % 65535 + 1 if kept else 0)
    return parts


def alike(a, b):
    best = 0.0
    for at in range(0, 144, 16):
        x, y = a[at : at + 16], b[at : at + 16]
        if 2 * sum(p > 0 and q > 0 for p, q in zip(x, y, strict=True)) >= 16:
            best = max(best, sum(p == q > 0 for p, q in zip(x, y, strict=True)) / sum(p > 0 or q > 0 for p, q in zip(x, y, strict=True)))
    return best


def expected(rows, words):
    """rows in order. By plain numbers, apart from the code under test."""
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        own, other, following = (by_hand(x, words) for x in (text, new, after))
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), "".join(f"{p:04x}" for p in own), "".join(f"{p:04x}" for p in other), 1.0 if new == text else alike(own, other), 1.0 if after == text else alike(own, following)))
    return out


def lexicon(rows, low=imatch.LOW, high=imatch.HIGH):
    counts = Counter(w for _, t in rows for w in set(re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())))
    return {w for w, n in counts.items() if max(2, low * len(rows)) <= n <= high * len(rows)}


def in_order(spark, rows):
    """By id, nulls first, then by the hash of the text."""
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))


def test_edges(spark, edges, edge_rows, nothing):
    rows = in_order(spark, [(r[0], r[1]) for r in edge_rows])
    found = imatch.fingerprints(edges)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected(rows, lexicon(rows)), key=str)
    assert imatch.fingerprints(nothing).count() == 0
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert imatch.fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 5) for i in range(3000)]
    return [(i * 3, " ".join(rng.choices(vocabulary, weights, k=rng.randint(20, 300)))) for i in range(900)] + [(5000 + i, "the same text again and again") for i in range(300)]


def test_many_ranges(spark, corpus, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 150)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    found = imatch.fingerprints(docs).collect()
    assert sorted(map(tuple, found)) == sorted(expected(corpus, lexicon(corpus)))
    near, far = (np.array([r[c] for r in found if r["doc_id"] < 2600]) for c in ("near_edited", "near_next"))
    assert near.mean() > 0.35 and far.mean() < 0.05 and (near[:, None] > far[None]).mean() > 0.95
    assert len({r["fingerprint"] for r in found if r["doc_id"] >= 5000}) == 1


def test_lexicon_is_of_all_documents(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert imatch.lexicon(docs) == lexicon(corpus)


def test_likeness():
    words = imatch.Lexicon([b"one", b"two", b"three"])
    a, none = words.fingerprint("one two three"), words.fingerprint("four")
    assert imatch.likeness(a, a) == 1 and imatch.likeness(a, none) == 0 == imatch.likeness(none, none)
    assert not none.any() and words.fingerprint("three one TWO two five").tolist() == a.tolist()


def test_text_ids(spark):
    rows = [("b", "one two three four"), ("a", "five six seven eight"), (None, "nine ten"), ("", "x" * 9)]
    found = {r["doc_id"]: r["edited_sha256"] for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    order = [rows[2], rows[3], rows[1], rows[0]]
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(text) // 4
        assert found[key] == hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()
