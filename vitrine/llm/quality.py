"""Quality classification by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its byte trigrams, hashed, and a few terms of shape (how many letters are capitals, how much is
punctuation, how often trigrams repeat). Term weights are the square roots of the counts times the inverse document
frequency; a truncated singular value decomposition of the labelled documents' weights gives the latent space. The
labelled documents' vectors, a bounded number, go to every worker; in blocks, the cosine of every document with
every one of them is computed, and the nearest vote with their similarity as weight.

Defined cases: a null text is empty; an empty text has no terms, and gets the share of label 1 among the labelled
rows, as do all if nothing is labelled (0.5 then). Labels that are null, of absent documents or of the held-out fold
teach nothing: what is counted and sampled are labelled documents outside it. Of labelled documents that share an id, the
text that sorts first is learnt from. Very long texts are counted in steps, whole. Ids may be null (they count as empty text
for the fold) or repeat; repeated rows are scored alike. Tables may be empty and may have further columns, of any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bytes_of, extended, fold_column, give_back, labelled_sample, ship, spans, texts_of, unused

TERMS = 4096
#: Terms of shape: eight levels of each of SHAPES shares.
SHAPES, LEVELS = 6, 8
SHAPE_WEIGHT = 0.5
DIMS = 64
NEAREST = 15
THRESHOLD = 0.3

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_MARK = ~(_LETTER | _SPACE | _DIGIT)


@dataclass(frozen=True)
class Neighbours:
    """idf by term; basis: terms x dims; vectors: labelled documents x dims; votes and weights of each; prior."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    prior: float


#: Bytes of a text that are hashed at once.
STEP = 1 << 18


def trigram_counts(text: np.ndarray) -> np.ndarray:
    """How often each hashed trigram occurs; a text of one or two bytes has one, filled with zeros."""
    counts = np.zeros(TERMS, np.int64)
    places = max(1, len(text) - 2)
    for at in range(0, places, STEP):
        n = min(STEP, places - at)
        wide = np.zeros(n + 2, np.uint32)
        part = text[at : at + n + 2]
        wide[: len(part)] = part
        hashed = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
        hashed = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 12)
        counts += np.bincount(hashed, minlength=TERMS)
    return counts


def byte_counts(text: np.ndarray) -> np.ndarray:
    return sum((np.bincount(text[at : at + STEP], minlength=256) for at in range(0, len(text), STEP)), np.zeros(256, np.int64))


def term_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Texts x terms: square roots of counts of hashed trigrams, then levels of shape."""
    n = len(ends) - 1
    out = np.zeros((n, TERMS + SHAPES * LEVELS), np.float32)
    for i in range(n):
        text = data[ends[i] : ends[i + 1]]
        size = len(text)
        if not size:
            continue
        counts, bytes_ = trigram_counts(text), byte_counts(text)
        letters = max(1, bytes_[_LETTER].sum())
        different = np.count_nonzero(counts)
        expected = TERMS * (1 - np.exp(-size / TERMS)) * 0.5
        shares = (bytes_[_UPPER].sum() / letters, 4 * bytes_[_MARK].sum() / size, 4 * bytes_[_DIGIT].sum() / size, min(1, different / expected), counts.max() * 10 / size, min(1.0, np.log2(size) / 20))
        out[i, :TERMS] = np.sqrt(counts)
        norm = np.sqrt(size)
        for j, share in enumerate(shares):
            out[i, TERMS + j * LEVELS + min(LEVELS - 1, int(share * LEVELS))] = SHAPE_WEIGHT * norm
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def fit(counts: np.ndarray, labels: np.ndarray, stands_for: np.ndarray, dims: int = DIMS, seed: int = 3) -> Neighbours:
    """stands_for: how many labelled rows each sampled one stands for."""
    idf = np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + np.float32(0.1)
    weighted = counts * idf
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    dims = max(1, min(dims, *weighted.shape))
    probe = weighted.T @ rng.normal(size=(len(weighted), min(len(weighted), dims + 16))).astype(np.float32)
    for _ in range(3):
        probe = np.linalg.qr(weighted.T @ (weighted @ probe))[0]
    _, _, right = np.linalg.svd(weighted @ probe, full_matrices=False)
    basis = (probe @ right[:dims].T).astype(np.float32)
    votes = np.stack([labels * stands_for, stands_for], axis=1).astype(np.float32)
    return Neighbours(idf, basis, unit(weighted @ basis), votes, float(votes[:, 0].sum() / votes[:, 1].sum()))


def vote(model: Neighbours, counts: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The share of label 1 among the nearest, each counted with the eighth power of its cosine."""
    near = unit(unit(counts * model.idf) @ model.basis) @ model.vectors.T
    k = min(nearest, near.shape[1])
    best = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
    weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** 8
    total = (weight[:, :, None] * model.votes[best]).sum(axis=1)
    return np.where(total[:, 1] > 1e-9, total[:, 0] / np.maximum(total[:, 1], 1e-9), model.prior)


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> Neighbours | None:
    """docs: doc_id, text; labels: doc_id, quality. About per_label rows of each label are taken; their whole texts are counted by the executors, so that vectors, not texts, come here."""
    ship(docs.sparkSession)
    rows, counts = labelled_sample(docs, labels, "quality", per_label)

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            vectors = [zlib.compress(term_counts(*bytes_of(pa.array([text], pa.string()))).tobytes(), 1) for text in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["labelled_id"], batch["label"], pa.array(vectors, pa.binary())], names=["labelled_id", "label", "vector"])

    found = rows.select("labelled_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(count, f"labelled_id {rows.schema['labelled_id'].dataType.simpleString()}, label int, vector binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (str(r["labelled_id"]), r["label"]))
    labels_ = np.array([r["label"] for r in found])
    share = {k: counts[k] / max(1, (labels_ == k).sum()) for k in counts}
    vectors = np.stack([np.frombuffer(zlib.decompress(r["vector"]), np.float32) for r in found])
    return fit(vectors, labels_, np.array([share[k] for k in labels_], float))


def score(docs: DataFrame, model: Neighbours | None, name: str = "score") -> DataFrame:
    """docs with the score as a further column of that name; docs: text and any columns."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most about two labels' samples x DIMS

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in parts:
            data, ends = bytes_of(batch["text"])
            out = np.full(len(batch), model.prior if model else 0.5)
            for first, last in spans(ends, 1 << 20) if model else ():
                for i in range(first, last, 512):
                    j = min(last, i + 512)
                    out[i:j] = vote(model, term_counts(data, ends[i : j + 1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(out, 0, 1), pa.float64())], names=[*batch.schema.names, name])
        give_back()

    return docs.mapInArrow(run, extended(docs.schema, f"{name} double"))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, per_label: int = 1500) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, quality. Learns outside the held-out fold. Returns doc_id, held_out, score, predicted."""
    known = fold_column(F.col("doc_id"), parts) != held
    model = learn(docs.filter(known), labels.filter(known), per_label)
    scored = score(docs.select("doc_id", (fold_column(F.col("doc_id"), parts) == held).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, known: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without those that score under the threshold; known and labels: what is learnt from, outside the held-out fold."""
    outside = fold_column(F.col("doc_id"), parts) != held
    model = learn(known.filter(outside), labels.filter(outside))
    name = unused("vitrine_score", docs)
    return score(docs, model, name).filter(F.col(name) >= threshold).drop(name)
