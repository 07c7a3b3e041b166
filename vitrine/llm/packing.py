"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

Each document's ids, and id 0 after them, are cut into pieces of at most `capacity` tokens. Full pieces are
sequences of their own; the others are packed. A round:

1. Counts by size (at most 2 x capacity rows) tell how many pieces and gaps there are. Pieces over the largest gap
   can't be placed in open sequences: as many new ones are opened as these pieces need at least.
2. Pieces and gaps are range-sorted by size, the largest first. A sweep through each range gives a piece the
   smallest gap passed so far that is still free, which is its successor: a gap passed is on a stack, a piece takes
   the top. What a range can't match itself (pieces without a gap, then gaps without a piece) is numbered.
3. From the two counts of each range the driver derives which run of pieces of a range meets which run of gaps of
   an earlier one; rank settles who gets which. Two joins by range and rank complete the matches.
4. Gaps shrink by what they got; gaps that no piece left over fits are closed. Until no piece is left.

If the largest piece left is at most half a gap, that gap counts as several slots, so that the number of rounds
grows with the logarithm of the number of small pieces that a sequence takes, not with their number.

Defined cases: a null text is empty, and an empty text is one piece of one token. Ids may be null or repeat; every
row is packed by itself. Tables may be empty and may have further columns; only the id and the text are read.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import drop, extended, give_back, ship, texts_of, tokenizer_path, written

CAPACITY = 2048
#: Rows of a range, about: what a task has on its stack at most.
RANGE = 1_000_000
#: Up to so many pieces and gaps, one task does the rounds that are left: with one range they have the same outcome, without the jobs.
FINISH = 100_000
#: Rows with texts that Python gets at once.
BATCH = 1024
#: Distinct words kept by a Python worker.
CACHE = 500_000


class WordIds(dict):
    """Little-endian 32-bit ids of lower-cased words between white space, made by the tokenizer's own model when first asked for."""

    #: Characters on which white space, lower case and composition need no look at their neighbours; texts with others, or with what may be a special token, are encoded as a whole.
    PLAIN = r"[\t-\r\x20-\x7e\xa1-ɏ‐-‧€]*"

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = regex.compile(self.PLAIN)
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.shown = {b: b if b in set(shown) else next(rest) for b in range(256)}

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for part in self.parts.findall(word) for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.shown))]
        out = np.array(ids, "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if "<|" in text or not self.plain.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of all documents."""
    spark_schema = extended(docs.select("doc_id").schema, "piece int, start long, length long, ids_crc32 long")
    path = tokenizer_path(tokenizer)

    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(path)
        for batch in parts:
            at, out = [], []
            for i, text in enumerate(texts_of(batch["text"])):
                ids = cache.ids(text) + b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    at.append(i)
                    out.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            piece, start, length, crc = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, spark_schema)


_SWEPT = "status string, range int, rank long, id long, size long, bin long"


def sweep(sizes: Iterable[tuple[int, bool, int]]) -> tuple[list, list, list]:
    """(size, is a piece, id), the largest first and gaps before pieces of their size. Returns matches (piece, size, gap), pieces and gaps left, the latter from the smallest."""
    free: list[tuple[int, int]] = []
    matches, left = [], []
    for size, piece, key in sizes:
        if not piece:
            free.append((key, size))
        elif free:
            matches.append((key, size, free.pop()[0]))
        else:
            left.append((key, size))
    return matches, left, free[::-1]


def _sweep_range(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId()
    rows = (row for b in parts for row in zip(b["size"].to_pylist(), b["piece"].to_pylist(), b["id"].to_pylist(), strict=True))
    matches, left, free = sweep(rows)
    for status, found in (("match", matches), ("piece", left), ("gap", free)):
        for i in range(0, len(found), 8192):
            part = found[i : i + 8192]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([status] * n), pa.array([at] * n, pa.int32()), pa.array(range(i, i + n), pa.int64()), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] if status == "match" else None for x in part], pa.int64())],
                names=["status", "range", "rank", "id", "size", "bin"])


def meet(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """counts: (range, pieces left, gaps left) in the order of the sweep. Returns runs (range of the pieces, first and end rank, range of the gaps, first rank)."""
    free: list[list[int]] = []
    runs = []
    for at, pieces, gaps in counts:
        done = 0
        while done < pieces and free:
            other, first, n = free[-1]
            take = min(n, pieces - done)
            runs.append((at, done, done + take, other, first))
            done += take
            if take == n:
                free.pop()
            else:
                free[-1][1:] = first + take, n - take
        if gaps:
            free.append([at, 0, gaps])
    return runs


def new_bins(over: dict[int, int], capacity: int) -> int:
    """How many sequences to open: one for each piece over half of one, and nine tenths of what the tokens need at least; over: how many pieces there are by size.

    The last tenth is opened once it is known what fits into the gaps of the others."""
    large = sum(n for size, n in over.items() if 2 * size > capacity)
    return max(large, -(-9 * sum(size * n for size, n in over.items()) // (10 * capacity)))


def most_slots(pieces: int, gaps: int) -> int:
    """Slots of a gap: more than there are pieces would be idle."""
    return max(1, -(-2 * pieces // max(1, gaps)))


def all_rounds(pieces: list[tuple[int, int]], gaps: dict[int, int], bins: int, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """The rounds in memory. pieces: (size, id); gaps: size by bin; bins: the first unused. Yields (id, size, bin, round)."""
    number = 0
    while pieces:
        widest, least, largest = max(gaps.values(), default=0), min(pieces)[0], max(pieces)[0]
        opened = new_bins(Counter(size for size, _ in pieces if size > widest), capacity)
        gaps |= dict.fromkeys(range(bins, bins + opened), capacity)
        bins += opened
        most = most_slots(len(pieces), len(gaps))
        rows = [(-size, True, key, 1) for size, key in pieces]
        for key, size in gaps.items():
            slots = max(1, min(most, size // largest))
            rows += [(-largest if slot > 1 else largest * (slots - 1) - size, False, key, slot) for slot in range(1, slots + 1)]
        rows.sort()
        matches, left, _ = sweep((-size, piece, key) for size, piece, key, _ in rows)
        for key, size, to in matches:
            gaps[to] -= size
            yield key, size, to, number
        pieces = [(size, key) for key, size in left]
        gaps = {key: size for key, size in gaps.items() if size >= least}
        number += 1


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces: id, size (under capacity). Returns id, bin, place: which bin each is in, and the tokens before it there."""
    spark = pieces.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state, placed, bins = written(pieces.select(F.lit(True).alias("piece"), "id", "size"), "packing"), [], 0
    while True:
        counts = state.groupBy("piece", "size").count().collect()  # at most 2 x capacity rows
        left, gaps = ({r["size"]: r["count"] for r in counts if r["piece"] == kind} for kind in (True, False))
        if not left:
            break
        largest, many = max(left), sum(left.values())
        if many + sum(gaps.values()) <= FINISH:
            placed.append(written(_finished(state, bins, len(placed), capacity), "packing"))
            break
        opened = new_bins({size: n for size, n in left.items() if size > max(gaps, default=0)}, capacity)
        fresh = spark.range(bins, bins + opened).select(F.lit(False).alias("piece"), "id", F.lit(capacity).cast("long").alias("size"))
        bins += opened
        state_now = state.unionByName(fresh)
        most = most_slots(many, sum(gaps.values()) + opened)
        slots = F.when(F.col("piece"), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("size") / largest))))
        rows = state_now.withColumn("slots", slots.cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("slots"))))
        size = F.when(F.col("slot") > 1, F.lit(largest).cast("long")).otherwise(F.col("size") - largest * (F.col("slots") - 1))
        rows = rows.select("piece", "id", size.alias("size"), "slot")
        ranges = max(tasks, -(-3 * many // RANGE))  # pieces, and slots of up to twice their number
        order = [F.desc("size"), F.asc("piece"), F.asc("id"), F.asc("slot")]
        swept = written(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_sweep_range, _SWEPT), "packing")
        ends = {(r["range"], r["status"]): r["count"] for r in swept.filter("status != 'match'").groupBy("range", "status").count().collect()}
        runs = meet([(at, ends.get((at, "piece"), 0), ends.get((at, "gap"), 0)) for at in sorted({k[0] for k in ends})])
        # two for each range at most; an Arrow table takes no Python on the executors, where a list would have further workers started there
        columns = zip(*runs, strict=True) if runs else ((),) * 5
        run_rows = spark.createDataFrame(pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), *(pa.int64(),) * 2, pa.int32(), pa.int64()), strict=True)], names=["range", "first", "end", "gap_range", "gap_first"]))
        waiting = swept.filter("status = 'piece'")
        met = waiting.alias("p").join(F.broadcast(run_rows).alias("r"), F.expr("p.range = r.range AND p.rank >= r.first AND p.rank < r.end"), "left").select("p.id", "p.size", F.col("r.gap_range").alias("range"), F.expr("r.gap_first + p.rank - r.first").alias("rank"))
        met = met.join(swept.filter("status = 'gap'").select("range", "rank", F.col("id").alias("bin")), ["range", "rank"], "left")
        done = written(swept.filter("status = 'match'").select("id", "size", "bin").unionByName(met.select("id", "size", "bin")), "packing")
        drop(swept)
        used = done.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("size").alias("used"))
        gaps_now = state_now.filter("NOT piece").join(used, F.col("id") == F.col("bin"), "left").select("piece", "id", (F.col("size") - F.coalesce("used", F.lit(0))).alias("size"))
        before, least = state, min(left)
        state = written(gaps_now.filter(F.col("size") >= least).unionByName(done.filter("bin IS NULL").select(F.lit(True).alias("piece"), "id", "size")), "packing")
        placed.append(done.filter("bin IS NOT NULL").select("id", "size", "bin", F.lit(len(placed)).alias("round")))
        drop(before)
    drop(state)
    if not placed:
        return spark.createDataFrame([], "id long, bin long, place long")
    whole = functools.reduce(DataFrame.unionByName, placed)
    place = F.sum("size").over(Window.partitionBy("bin").orderBy("round", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return whole.select("id", "bin", place.alias("place"))


def _finished(state: DataFrame, bins: int, rounds: int, capacity: int) -> DataFrame:
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [row for b in parts for row in zip(b["piece"].to_pylist(), b["size"].to_pylist(), b["id"].to_pylist(), strict=True)]
        found = list(all_rounds([(size, key) for piece, size, key in table if piece], {key: size for piece, size, key in table if not piece}, bins, capacity))
        key, size, to, number = zip(*found, strict=True) if found else ((),) * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, size, to)), pa.array([rounds + n for n in number], pa.int32())], names=["id", "size", "bin", "round"])

    return state.coalesce(1).mapInArrow(run, "id long, size long, bin long, round int")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row per piece."""
    ship(docs.sparkSession)
    pieces = written(token_pieces(docs, tokenizer, capacity).withColumn("id", F.monotonically_increasing_id()), "pieces", BATCH)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == capacity).select(*columns, (2 * F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    placed = best_fit(rest.select("id", F.col("length").alias("size")), capacity)
    return full.unionByName(rest.join(placed, "id").select(*columns, (2 * F.col("bin") + 1).alias("sequence_id"), F.col("place").alias("offset")))
