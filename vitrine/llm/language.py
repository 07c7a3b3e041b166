"""Language identification by a byte convolutional network.

Bytes have an embedding; filters of several widths run over windows of a fixed number of bytes; each filter's
largest value in a window goes, after a rectifier, to a softmax over the languages. It is trained here, in numpy,
on windows from a bounded sample of labelled documents. For prediction the embedding and the filters are folded
into tables by pairs of bytes. Every window of every text is read; a document's probabilities are the mean of those
of its windows.

Defined cases: a text that is null or has no letter gets `und` and score 0; with nothing to learn from, so do all.
Ids may be null (they count as empty text for the fold) or repeat; repeated rows are predicted alike. Tables may be
empty and may have further columns.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_sample, bytes_of, extended, fold_column, give_back, ship, spans, unused

WINDOW = 256
WIDTHS = (2, 3, 4)
UNDETERMINED = "und"


@dataclass(frozen=True)
class ByteNet:
    """langs; embedding 256 x e; filters of each width w: w x e x f and f biases; out: features x langs, and biases."""

    langs: tuple[str, ...]
    embedding: np.ndarray
    filters: tuple[np.ndarray, ...]
    shifts: tuple[np.ndarray, ...]
    out: np.ndarray
    bias: np.ndarray


def windows_of(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Windows of window bytes and as many of those after them as the widest filter needs; zeros after the end."""
    more = max(WIDTHS) - 1
    n = max(1, -(-len(data) // window))
    padded = np.zeros(n * window + more, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, window + more)[::window]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, langs: tuple[str, ...], steps: int = 800, dims: int = 8, filters: int = 8, rate: float = 0.01, seed: int = 1) -> ByteNet:
    """Adam on the cross-entropy, as many steps for few windows as for many; the gradient of a maximum goes to the place it was taken from."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.5, (256, dims)).astype(np.float32)
    banks = [rng.normal(0, 1 / np.sqrt(w * dims), (w, dims, filters)).astype(np.float32) for w in WIDTHS]
    shifts = [np.zeros(filters, np.float32) for _ in WIDTHS]
    out, bias = rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    params = [embedding, *banks, *shifts, out, bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = len(labels) / np.maximum(1, np.bincount(labels, minlength=len(langs))) / len(langs)
    for _ in range(-(-steps * 64 // len(labels))):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x, y = windows[pick].astype(np.int64), labels[pick]
            seen, features, places = embedding[x], [], []
            for w, bank, shift in zip(WIDTHS, banks, shifts, strict=True):
                value = sum(seen[:, k : k + WINDOW] @ bank[k] for k in range(w)) + shift
                places.append(value.argmax(axis=1))
                features.append(np.take_along_axis(value, places[-1][:, None], axis=1)[:, 0])
            raw = np.concatenate(features, axis=1)
            hidden = np.maximum(raw, 0)
            delta = softmax(hidden @ out + bias)
            delta[np.arange(len(y)), y] -= 1
            delta *= (weight[y] / len(y))[:, None]
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = hidden.T @ delta, delta.sum(axis=0)
            back = (delta @ out.T) * (raw > 0)
            for j, (w, bank) in enumerate(zip(WIDTHS, banks, strict=True)):
                g = back[:, j * filters : (j + 1) * filters]
                grads[1 + len(WIDTHS) + j] = g.sum(axis=0)
                for k in range(w):
                    taken = x[np.arange(len(y))[:, None], places[j] + k]
                    grads[1 + j][k] = np.einsum("bfe,bf->ef", embedding[taken], g)
                    np.add.at(grads[0], taken, g[:, :, None] * bank[k].T[None])
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ByteNet(langs, embedding, tuple(banks), tuple(shifts), out, bias)


class Predictor:
    """The network with its filters as tables by byte pairs: half the look-ups."""

    def __init__(self, net: ByteNet) -> None:
        self.net = net
        self.tables = []
        for bank, shift in zip(net.filters, net.shifts, strict=True):
            single = [net.embedding @ part for part in bank]
            pairs = [(k, (single[k][:, None] + single[k + 1][None]).reshape(65536, -1)) for k in range(0, len(single) - 1, 2)]
            if len(single) % 2:
                pairs.append((len(single) - 1, np.repeat(single[-1], 256, axis=0)))  # the second byte of the pair has no say
            self.tables.append((pairs, shift))

    def probabilities(self, windows: np.ndarray, block: int = 256) -> np.ndarray:
        found = []
        for i in range(0, len(windows), block):
            x = np.ascontiguousarray(windows[i : i + block])
            x = np.concatenate([x, np.zeros((len(x), 1), np.uint8)], axis=1).astype(np.uint16)
            pairs = (x[:, :-1] << 8) | x[:, 1:]
            features = []
            for tables, shift in self.tables:
                value = None
                for k, table in tables:
                    part = table.take(pairs[:, k : k + WINDOW], axis=0)
                    value = part if value is None else np.add(value, part, out=value)
                features.append(value.max(axis=1) + shift)
            found.append(softmax(np.maximum(np.concatenate(features, axis=1), 0) @ self.net.out + self.net.bias))
        return np.concatenate(found)




def training_windows(rows: list) -> tuple[np.ndarray, np.ndarray, tuple[str, ...]]:
    langs = tuple(sorted({r["label"] for r in rows}))
    windows = [windows_of(np.frombuffer((r["part"] or "").encode()[:WINDOW], np.uint8))[0] for r in rows]
    return np.array(windows), np.array([langs.index(r["label"]) for r in rows]), langs


@functools.lru_cache(maxsize=4)
def _letter():
    import regex

    return regex.compile(r"\p{L}")


def learn(docs: DataFrame, per_language: int = 1000) -> ByteNet | None:
    """docs: doc_id, text, lang; from a bounded sample of about per_language rows of each language, a window at a place that their hash gives."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    start = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.lit(1), F.char_length("text") - WINDOW)) + 1
    found, _ = bounded_sample(rows, "lang", per_language, [F.col("text").substr(start.cast("int"), F.lit(WINDOW)).alias("part")])
    return train(*training_windows(found)) if found else None


def predict(docs: DataFrame, net: ByteNet | None, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and the score as further columns of those names; docs: text and any columns.

    A third name: how sure the windows are, the mean of each one's own largest probability, whichever languages these are for."""
    ship(docs.sparkSession)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(net) if net else None
        for batch in parts:
            column = batch["text"]
            n = len(column)
            best, score, sure = np.zeros(n, int), np.zeros(n), np.zeros(n)
            data, ends = bytes_of(column)
            for first, last in spans(ends, 1 << 20) if predictor else ():
                each = [windows_of(data[ends[i] : ends[i + 1]]) for i in range(first, last)]
                starts = np.cumsum([0, *map(len, each)])[:-1]
                whole = np.concatenate(each)
                found, sizes = predictor.probabilities(whole), np.array([len(x) for x in each])
                mean = np.add.reduceat(found, starts, axis=0) / sizes[:, None]
                best[first:last], score[first:last] = mean.argmax(axis=1), mean.max(axis=1)
                sure[first:last] = np.add.reduceat(found.max(axis=1), starts) / sizes
            lettered = [bool(predictor) and text is not None and bool(_letter().search(text)) for text in column.to_pylist()]
            best_langs = pa.array([net.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], pa.string())
            scores = [pa.array(np.clip(np.where(lettered, x, 0.0), 0, 1), pa.float64()) for x in (score, sure)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[best_langs, *scores][: len(names)]], names=[*batch.schema.names, *names])
        give_back()

    return docs.mapInArrow(run, extended(docs.schema, f"{names[0]} string, " + ", ".join(f"{n} double" for n in names[1:])))


def identify(docs: DataFrame, parts: int = 3, held: int = 1, per_language: int = 1000) -> DataFrame:
    """docs: doc_id, text, lang. Learns from the documents outside the held-out fold. Returns doc_id, held_out, lang_pred, score."""
    net = learn(docs.filter(fold_column(F.col("doc_id"), parts) != held), per_language)
    return predict(docs.select("doc_id", (fold_column(F.col("doc_id"), parts) == held).alias("held_out"), "text"), net).drop("text")


def keep_known(docs: DataFrame, known: DataFrame, least: float = 0.5, parts: int = 3, held: int = 1) -> DataFrame:
    """docs, all columns, without those in no language that was learnt, and those whose windows are on average less sure than `least`; known: what is learnt from, outside the held-out fold.

    A text in several learnt languages stays, as each of its windows is sure of one."""
    net = learn(known.filter(fold_column(F.col("doc_id"), parts) != held))
    names = tuple(unused(f"vitrine_{n}", docs) for n in ("lang", "score", "sure"))
    return predict(docs, net, names).filter((F.col(names[0]) != UNDETERMINED) & (F.col(names[2]) >= least)).drop(*names)
