"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly.

A window of words is the bag of its words' character n-grams (bytes, words padded by a boundary), hashed into
buckets with an embedding each; the bag's mean goes to a softmax over the two labels. Unseen misspellings share most
n-grams with the words they come from. Documents are labelled as a whole, so that training goes first over all
windows, then, round after round, over the window of each document that the model itself finds most toxic. A
document's score is that of its most toxic window; every window of the whole text is read.

For prediction the embeddings are folded into the one number by which each bucket moves the softmax.

Defined cases: a null text is empty; a text without words scores 0, as do all if no toxic document is labelled.
Labels that are null, of absent documents or of the held-out fold teach nothing: what is counted and sampled are labelled
documents outside it, none longer than `longest` characters; each is learnt from as a whole. A very long text is scored
in steps, whole, in memory that doesn't depend on its length. Ids may be null (they count as empty text for the fold) or
repeat; repeated rows are scored alike. Tables may be empty and may have further columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bytes_of, extended, fold_column, labelled_sample, ship, spans

BUCKETS = 1 << 17
GRAMS = (3, 4, 5, 6, 7)
WORDS = 8
THRESHOLD = 0.3

#: A-Z in lower case, digits, and bytes of other letters stay; the rest is a boundary.
_KEPT = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 0 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Subwords:
    """pull: by bucket, its embedding's part in the difference of the two labels' logits; bias: what is added."""

    pull: np.ndarray
    bias: float


def grams(data: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each length of n-gram the buckets at all places and which places count; where windows begin; which text each is of.

    Texts are set apart by a boundary: place p of text i is at p - ends[0] + i + 1."""
    n = len(ends) - 1
    base = ends[0]
    chars = np.zeros(int(ends[-1] - base) + n + 1 + max(GRAMS), np.uint8)
    at = np.arange(n)
    shift = np.repeat(at + 1, np.diff(ends)) if n else np.zeros(0, int)
    chars[np.arange(ends[-1] - base) + shift] = _KEPT[data[base : ends[-1]]]
    inside = chars != 0
    size = len(chars) - max(GRAMS)
    found, hashed, real = [], chars[:size].astype(np.uint32), np.ones(size, bool)
    for k in range(1, max(GRAMS)):
        hashed = hashed * np.uint32(0x01000193) + chars[k : k + size]
        if k > 1:
            real = real & inside[k - 1 : k - 1 + size]
        if k + 1 in GRAMS:
            mixed = (hashed ^ (hashed >> np.uint32(13))) * np.uint32(0x5BD1E995) + np.uint32(k)
            found.append(((mixed >> np.uint32(15)).astype(np.int32) & (BUCKETS - 1), real & inside[1 : 1 + size]))
    starts = np.flatnonzero(inside[1:size] & ~inside[: size - 1])  # the boundary before each word
    bounds = np.searchsorted(starts, ends[:-1] - base + at)
    counts = np.diff(np.append(bounds, len(starts)))
    rank = np.arange(len(starts)) - np.repeat(bounds, counts)
    first = rank % WORDS == 0
    return found, starts[first], np.repeat(at, counts)[first]


def window_logits(model: Subwords, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, starts, of = grams(data, ends)
    if not len(starts):
        return np.zeros(0), of
    pull, count = None, None
    for bucket, real in found:
        part = np.where(real, model.pull.take(bucket), np.float32(0))
        pull, count = (part, real.astype(np.float32)) if pull is None else (pull + part, count + real)
    return np.add.reduceat(pull, starts) / np.maximum(np.add.reduceat(count, starts), 1) + model.bias, of


def text_logits(model: Subwords, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest of each text's windows; minus infinity without words."""
    logits, of = window_logits(model, data, ends)
    out = np.full(len(ends) - 1, -np.inf)
    np.maximum.at(out, of, logits)
    return out


def long_text_logit(model: Subwords, text: np.ndarray, step: int = 1 << 18) -> float:
    """The same for one text, step places at a time: what a window adds up is carried from one step to the next."""
    ahead = max(GRAMS)
    best, words, pull, count, started = -np.inf, 0, 0.0, 0.0, False
    for at in range(0, len(text) + 1, step):  # place p is the boundary or byte before text[p]
        size = min(step, len(text) + 1 - at)
        chars = np.zeros(size + ahead, np.uint8)
        first = max(0, at - 1)
        part = _KEPT[text[first : at + size + ahead - 1]]
        chars[first - at + 1 : first - at + 1 + len(part)] = part
        inside = chars != 0
        total, real_count = np.zeros(size), np.zeros(size)
        hashed, real = chars[:size].astype(np.uint32), np.ones(size, bool)
        for k in range(1, ahead):
            hashed = hashed * np.uint32(0x01000193) + chars[k : k + size]
            if k > 1:
                real = real & inside[k - 1 : k - 1 + size]
            if k + 1 in GRAMS:
                mixed = (hashed ^ (hashed >> np.uint32(13))) * np.uint32(0x5BD1E995) + np.uint32(k)
                counts = real & inside[1 : 1 + size]
                total += np.where(counts, model.pull.take((mixed >> np.uint32(15)).astype(np.int32) & (BUCKETS - 1)), 0)
                real_count += counts
        starts = np.flatnonzero(~inside[:size] & inside[1 : 1 + size])
        opened = starts[(words + np.arange(len(starts))) % WORDS == 0]
        words += len(starts)
        edges = np.concatenate([[0], opened, [size]]).astype(int)
        totals, places = np.concatenate([[0.0], np.cumsum(total)]), np.concatenate([[0.0], np.cumsum(real_count)])
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if i:  # a window begins here: the one before is complete
                if started:
                    best = max(best, pull / max(count, 1))
                pull, count, started = 0.0, 0.0, True
            if started:
                pull, count = pull + totals[b] - totals[a], count + places[b] - places[a]
    if started:
        best = max(best, pull / max(count, 1))
    return best + model.bias


class Trainer:
    """Windows as bags of buckets; embeddings and softmax under AdaGrad."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, labels: np.ndarray, dims: int, seed: int) -> None:
        bags, sizes, of = [], [], []
        for first, last in spans(ends, 1 << 18):  # in parts: places and buckets of all at once would fill the driver's memory
            found, starts, text = grams(data, ends[first : last + 1])
            place = np.concatenate([np.flatnonzero(real) for _, real in found])
            window = (np.searchsorted(starts, place, side="right") - 1).astype(np.int32)
            inside = window >= 0
            bucket = np.concatenate([b[real] for b, real in found])[inside]
            bags.append(bucket[np.argsort(window[inside], kind="stable")])
            sizes.append(np.bincount(window[inside], minlength=len(starts)))
            of.append(text + first)
        self.bags, self.of = np.concatenate([np.zeros(0, np.int32), *bags]), np.concatenate([np.zeros(0, int), *of])
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, int), *sizes]))]).astype(np.int64)
        self.labels, self.rng = labels, np.random.default_rng(seed)
        self.embedding = self.rng.uniform(-1, 1, (BUCKETS, dims)).astype(np.float32) / dims
        self.out, self.bias = self.rng.normal(0, 1, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.seen = [np.full_like(p, 1e-6) for p in (self.embedding, self.out, self.bias)]

    def step(self, pick: np.ndarray, rate: float) -> None:
        sizes = self.bounds[pick + 1] - self.bounds[pick]
        pick, sizes = pick[sizes > 0], sizes[sizes > 0]
        if not len(pick):
            return
        starts = np.cumsum(sizes) - sizes
        ids = self.bags[np.repeat(self.bounds[pick] - starts, sizes) + np.arange(sizes.sum())]
        mean = np.add.reduceat(self.embedding[ids], starts, axis=0) / sizes[:, None]
        logits = mean @ self.out + self.bias
        delta = np.exp(logits - logits.max(axis=1, keepdims=True))
        delta /= delta.sum(axis=1, keepdims=True)
        label = self.labels[self.of[pick]]
        delta[np.arange(len(pick)), label] -= 1
        back = (delta @ self.out.T) / sizes[:, None]
        unique, place = np.unique(ids, return_inverse=True)
        spread = np.repeat(back, sizes, axis=0)
        grad = np.stack([np.bincount(place, spread[:, d], len(unique)) for d in range(spread.shape[1])], axis=1)
        self.seen[0][unique] += grad**2
        self.embedding[unique] -= rate * grad / np.sqrt(self.seen[0][unique])
        for p, s, g in ((self.out, self.seen[1], mean.T @ delta), (self.bias, self.seen[2], delta.sum(axis=0))):
            s += g**2
            p -= rate * g / np.sqrt(s)

    def logits(self, block: int = 20_000) -> np.ndarray:
        """Of all windows, under the parameters as they are."""
        model, out = self.model(), []
        for i in range(0, len(self.of), block):
            bounds = self.bounds[i : i + block + 1]
            total = np.concatenate([[0.0], np.cumsum(model.pull[self.bags[bounds[0] : bounds[-1]]], dtype=np.float64)])
            out.append(np.diff(total[bounds - bounds[0]]) / np.maximum(1, np.diff(bounds)) + model.bias)
        return np.concatenate([np.zeros(0), *out])

    def model(self) -> Subwords:
        return Subwords((self.embedding @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


def train(data: np.ndarray, ends: np.ndarray, labels: np.ndarray, dims: int = 8, warm: int = 2, rounds: int = 12, rate: float = 0.1, seed: int = 5) -> Subwords:
    t = Trainer(data, ends, labels, dims, seed)
    for r in range(warm + rounds):
        if r < warm:
            pick = t.rng.permutation(len(t.of))
        else:
            order = np.lexsort((t.logits(), t.of))
            last = np.flatnonzero(np.append(np.diff(t.of[order]) != 0, True))
            pick = t.rng.permutation(order[last])
        for i in range(0, len(pick), 64):
            t.step(pick[i : i + 64], rate)
    return t.model()


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 1000, longest: int = 1 << 15) -> Subwords | None:
    """docs: doc_id, text; labels: doc_id, toxic. About per_label rows of each label are taken, of texts of at most `longest` characters: the sample's bound in memory. What is taken is learnt from as a whole."""
    rows, counts = labelled_sample(docs.filter(F.coalesce(F.char_length("text"), F.lit(0)) <= longest), labels, "toxic", per_label)
    found = sorted(rows.collect(), key=lambda r: (str(r["labelled_id"]), r["label"]))
    known = np.array([r["label"] for r in found], int)
    if not known.any():
        return None
    share = known.mean()
    if share == 1:
        return Subwords(np.zeros(BUCKETS, np.float32), 10.0)
    model = train(*bytes_of(pa.array([r["text"] for r in found], pa.string())), known)
    # the sample has more toxic documents than the corpus
    return Subwords(model.pull, model.bias + float(np.log(counts[1] / counts[0]) - np.log(share / (1 - share))))


#: Bytes of texts that are scored at once; a longer text goes by steps.
SPAN = 1 << 19


def score(docs: DataFrame, model: Subwords | None) -> DataFrame:
    """docs with score; docs: text and any columns but that."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in parts:
            data, ends = bytes_of(batch["text"])
            out = np.full(len(batch), -np.inf)
            for first, last in spans(ends, SPAN) if model else ():
                long = ends[last] - ends[first] > SPAN
                out[first:last] = long_text_logit(model, data[ends[first] : ends[last]]) if long else text_logits(model, data, ends[first : last + 1])
            with np.errstate(over="ignore"):
                scores = 1 / (1 + np.exp(-out))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, extended(docs.schema, "score double"))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, per_label: int = 1000) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic. Learns outside the held-out fold. Returns doc_id, held_out, score, predicted."""
    known = fold_column(F.col("doc_id"), parts) != held
    model = learn(docs.filter(known), labels.filter(known), per_label)
    scored = score(docs.select("doc_id", (fold_column(F.col("doc_id"), parts) == held).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
