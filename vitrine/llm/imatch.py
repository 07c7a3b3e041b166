"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the words whose document frequency, as a share of all documents, is in a band: what is too frequent
says little, what is too rare breaks a fingerprint at the first change. A text's terms are its distinct words in the
lexicon, sorted. Random subsets of the lexicon, LEVELS levels of SUBSETS each, each level with half the words of the one
before, keep some of the terms; the hash of what a subset keeps is one part of the fingerprint. A small subset keeps
few terms of a long text, so that most of its hashes outlive an edit; a large one does the same for a short text. The likeness
of two fingerprints is the share of equal hashes at the level where it is largest, of the levels at which most subsets keep something.

Document frequencies are counted over all documents. A word in the lexicon is in a share of `low` of them or more,
so that the lexicon has at most 1 / low times the mean number of distinct words of a text, however many documents
there are; it goes to every worker.

Defined cases: a null text is empty. A text without a term in the lexicon has a fingerprint of nothing kept, which says nothing: its likeness
to that of another text is 0. Equal texts have likeness 1. Ids may be of any type that can be ordered; null ids come first in the order, and of rows
with equal ids the order is that of a hash of their texts. The document after the last is the first, of a single one itself. Tables may be
empty and may have further columns; only the id and the text are read. Very long texts are read whole.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vitrine.llm.common import extended, ship, texts_of

LOW, HIGH = 0.001, 0.1
LEVELS, SUBSETS = 9, 16
#: Words a task counts before it sends what it has.
FLUSH = 400_000
#: Rows of a range of the order, about; how many of them a boundary is chosen from; at most so many ranges and rows to choose from, whatever the table's size.
RANGE, SAMPLED, RANGES, CHOSEN = 20_000, 100, 1 << 16, 1 << 20

#: Bytes that are no part of a word become a space, A-Z lower case.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def distinct_words(text: str) -> set[bytes]:
    return set(text.encode(errors="surrogatepass").translate(_WORDS).split())


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> set[bytes]:
    """The words in a share of low to high of all documents, and in two at least."""

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in parts:
            found[b""] += len(batch)  # no word: the documents
            for text in texts_of(batch["text"]):
                found.update(distinct_words(text))
                if len(found) > FLUSH:
                    yield sent()
                    found.clear()
        yield sent()

    counts = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = docs.count()
    return {bytes(r["word"]) for r in counts.filter((F.col("n") >= max(2, low * total)) & (F.col("n") <= high * total) & (F.length("word") > 0)).select("word").collect()}


def word_key(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def spread(keys: np.ndarray, seed: int) -> np.ndarray:
    z = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def kept_sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By part, the sum of the hashes of the terms that the subset keeps, and whether it keeps any. The subsets of a level are within those of the level before."""
    seeds = np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    chance = spread(keys[:, None] + seeds, 0).astype(np.float64) / 2**64
    own = (spread(keys, 99) | np.uint64(1))[:, None]
    kept = [chance < 0.5**level for level in range(1, LEVELS + 1)]
    return np.concatenate([(own * k).sum(axis=0, dtype=np.uint64) for k in kept]), np.concatenate([k.any(axis=0) for k in kept])


class Lexicon:
    """Words of the lexicon, 8 bytes each besides the words themselves."""

    def __init__(self, words: Iterable[bytes]) -> None:
        self.keys = {w: word_key(w) for w in words}

    def fingerprint(self, text: str) -> np.ndarray:
        """LEVELS x SUBSETS parts; 0 where nothing is kept, else the sum of the sorted distinct terms' hashes, folded to 1..65535."""
        keys = np.array([self.keys[w] for w in sorted(distinct_words(text) & self.keys.keys())], np.uint64)
        total, some = np.zeros(LEVELS * SUBSETS, np.uint64), np.zeros(LEVELS * SUBSETS, bool)
        for i in range(0, len(keys), 1024):
            sums, any_ = kept_sums(keys[i : i + 1024])
            total += sums
            some |= any_
        return np.where(some, spread(total, 7) % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.uint16)


@functools.lru_cache(maxsize=1)
def _lexicon(key: int, words: frozenset[bytes]) -> Lexicon:
    """Once for a Python worker, not for a task."""
    return Lexicon(words)


def shown(parts: np.ndarray) -> str:
    """Four hexadecimal digits a part."""
    return parts.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.reshape(LEVELS, SUBSETS), b.reshape(LEVELS, SUBSETS)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    both = ((a != 0) & (b != 0)).sum(axis=1)
    some = ((a != 0) | (b != 0)).sum(axis=1)
    level = 2 * both >= SUBSETS
    return float((equal[level] / some[level]).max(initial=0.0))


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many code points from the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _ordered(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs in ranges of the order, and the first of each once more at the end of the range before it; and how many ranges there are."""
    kind = docs.schema["doc_id"].dataType
    kind = "long" if isinstance(kind, IntegralType) else kind.simpleString()
    given = F.col("doc_id").isNotNull().cast("int")
    rows = docs.select("doc_id", "text", given.alias("given"), F.coalesce(F.col("doc_id").cast(kind), F.lit(0 if kind == "long" else "").cast(kind)).alias("key"), F.xxhash64("text").alias("tie"))
    total = docs.count()
    ranges = min(RANGES, max(1, -(-total // RANGE), min(total // SAMPLED, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    share = min(1.0, min(CHOSEN, ranges * SAMPLED) / max(1, total))
    chosen = sorted(tuple(r) for r in rows.filter(F.pmod(F.xxhash64("key", "tie"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("given", "key", "tie").distinct().collect())  # about CHOSEN at most
    bounds = sorted({chosen[len(chosen) * i // ranges] for i in range(1, ranges)}) if chosen else []

    @F.pandas_udf("int")
    def place(given: pd.Series, key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, x) for x in zip(given.tolist(), key.tolist(), tie.tolist(), strict=True)], dtype="int32")

    firsts = {r["range"]: tuple(r["first"]) for r in rows.select(place("given", "key", "tie").alias("range"), "given", "key", "tie").groupBy("range").agg(F.min(F.struct("given", "key", "tie")).alias("first")).collect()}  # RANGES at most
    used = sorted(firsts)
    before = {firsts[r]: used[i - 1] for i, r in enumerate(used)}
    held = docs.sparkSession.sparkContext.broadcast((bounds, before))

    def deal(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are compressed one by one, which halves what is shuffled."""
        pack = zstandard.ZstdCompressor(level=1)
        bounds, before = held.value
        for batch in parts:
            keys = list(zip(*(batch[c].to_pylist() for c in ("given", "key", "tie")), strict=True))
            packed = pa.array([pack.compress(t.encode(errors="surrogatepass")) for t in texts_of(batch["text"])], pa.binary())
            ranges = [bisect.bisect_right(bounds, x) for x in keys]
            again = [i for i, x in enumerate(keys) if x in before]
            at = pa.array([*range(len(keys)), *again], pa.int64())
            place = pa.array([*ranges, *(before[keys[i]] for i in again)], pa.int32())
            copy = pa.array([0] * len(keys) + [1] * len(again), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), packed.take(at), *(batch[c].take(at) for c in ("given", "key", "tie")), place, copy], names=["doc_id", "packed", "given", "key", "tie", "range", "copy"])

    return rows.mapInArrow(deal, extended(docs.select("doc_id").schema, f"packed binary, given int, key {kind}, tie long, range int, copy int")), len(bounds) + 1


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(frozenset(lexicon(docs, low, high)))  # at most 1 / low times the mean vocabulary of a text
    number = id(held)  # tells this lexicon from those of other runs
    schema = extended(docs.select("doc_id").schema, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unpack = _lexicon(number, held.value), zstandard.ZstdDecompressor()
        last = None  # range, text, fingerprint, id of the row that waits for the next
        for batch in parts:
            ids, rows = [], []
            for i, (text, at, copy) in enumerate(zip(batch["packed"], batch["range"].to_pylist(), batch["copy"].to_pylist(), strict=True)):
                text = unpack.decompress(text.as_py()).decode(errors="surrogatepass")
                own = words.fingerprint(text)
                if last and last[0] == at:
                    _, before, its, key = last
                    new = edited(before, text)
                    other = its if new == before else words.fingerprint(new)
                    ids.append(key)
                    rows.append((len(before), hashlib.sha256(new.encode(errors="surrogatepass")).hexdigest(), shown(its), shown(other), 1.0 if new == before else likeness(its, other), 1.0 if text == before else likeness(its, own)))
                last = None if copy else (at, text, own, batch["doc_id"].slice(i, 1))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            keys = pa.concat_arrays(ids) if ids else batch["doc_id"].slice(0, 0)
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.fieldNames())

    ordered, ranges = _ordered(docs)
    dealt = ordered.repartitionById(ranges, F.col("range"))  # a range is a task, by its number
    return dealt.sortWithinPartitions("range", "copy", "given", "key", "tie").mapInArrow(run, schema)
