"""Near-duplicates by SimHash, found with a Gray-order hierarchical index.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles. Equal fingerprints are one
class from the start. For others, a bit mask and the bits under it are a bucket: a class is in the bucket of each of a
list of masks. If the masks are blocks, one more than the bits that may differ, two linked classes meet in a bucket
surely; a bucket with too many classes is dealt anew under other blocks, which is as sure.

Classes are sorted by the Gray rank of the masked bits, then of the whole, across the table in ranges, so that neighbours
share bits. Runs of them are nodes, runs of nodes upper nodes, at every size; each has a mask of the bits that all of it
shares and the pattern there. A search goes down from the top with pairs of nodes and leaves out every pair whose patterns
differ in more bits than the limit, that has no bucket in common, or that is joined already: a group of n near copies gives
n - 1 links, not all pairs. Links make components by large-star and small-star rounds.

Where a similarity of the sets of shingles is asked for, what meets is a candidate and is verified on the sets. Each bucket's
forest of least distances joins groups of near copies, with fewer links than it has classes. That finds most links, not all, so
that an exact set-similarity join goes through all that is still apart: two sets of that similarity share a shingle among the
first of each, in an order of all shingles that has the frequent ones last. Every pair of different groups that shares one, and
that sizes and places don't rule out, is verified: no link is lost, whatever the fingerprints say.

Defined cases: a null text is empty; texts without words have fingerprint zero and link like any others. A null id is
never the smallest of its component; a component without ids has a null one. Repeated rows are returned each. Tables may be
empty and may have further columns, of any names; only the id and the text are read. Very long texts are hashed in blocks, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import drop, free_heaps, give_back, looked_up, ship, texts_of, unused, written

BITS = 64
#: Nodes' runs.
RUN = 8
#: Pairs of nodes that are taken down a level at once: they have RUN x RUN times as many pairs below.
PAIRS = 4096
#: Rows that a task indexes at once, more only where a bucket has more; classes of a bucket, from which it is dealt anew.
CHUNK, BUCKET = 32_768, 16_384
#: One of so many classes is looked at to see which buckets are dealt anew before the shuffle; a bucket it misses is dealt anew after it.
SAMPLE = 64
#: Rows for a task of a search, about.
TASK = 1_000_000
#: Up to so many classes with candidates, the rows with their texts are picked by a broadcast.
BROADCAST = 1_000_000


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, a block at a time. Words are set apart by ASCII white space, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    found = text.encode(errors="surrogatepass").lower().split()
    if 0 < len(found) < words:
        yield np.array([xxh64_intdigest(b" ".join(found), 42)], np.uint64)
        return
    for at in range(0, len(found) - words + 1, 1 << 16):
        part = found[at : at + (1 << 16) + words - 1]
        n = len(part) - words + 1
        yield np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(part[i : n + i] for i in range(words)), strict=True)), repeat(42)), np.uint64, n)


def mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Another hash from each hash; the first is itself."""
    if not seed:
        return hashes
    z = hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def simhash(text: str, words: int, parts: int, repeats: bool = True) -> tuple[np.ndarray, int]:
    """parts x 64 bits, as unsigned numbers, and how many shingles there are. repeats: whether a shingle counts as often as it occurs."""
    return majority(shingle_hashes(text, words) if repeats else [shingle_set(text, words)], parts)


def majority(blocks_: Iterable[np.ndarray], parts: int) -> tuple[np.ndarray, int]:
    """Of blocks of hashes, the bits that are set in over half of them and of hashes made from them, and how many there are."""
    counts, n = np.zeros((parts, BITS), np.int64), 0
    for hashes in blocks_:
        n += len(hashes)
        for part in range(parts):
            counts[part] += np.unpackbits(mixed(hashes, part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8")[:, 0] if n else np.zeros(parts, np.uint64), n


def fingerprints(docs: DataFrame, words: int, parts: int = 1, repeats: bool = True) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, content (a hash of the text), size (how many shingles) and f0, f1 ...: 64 bits each."""
    ship(docs.sparkSession)
    names = [f"f{i}" for i in range(parts)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [simhash(text, words, parts, repeats) for text in texts_of(batch["text"])]
            found = np.array([bits for bits, _ in each], np.uint64).reshape(-1, parts).view(np.int64)
            sizes = pa.array([n for _, n in each], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["content"], sizes, *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(parts))], names=["doc_id", "content", "size", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("content")).mapInArrow(run, f"doc_id {kind}, content long, size long, " + ", ".join(f"{n} long" for n in names))


def gray_keys(codes: np.ndarray) -> list[np.ndarray]:
    """Sort keys of codes (rows of 64-bit parts) by Gray rank, the first in order last."""
    keys, odd = [], np.zeros(len(codes), np.uint64)
    for part in codes.T:
        rank = part.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        rank ^= odd  # after an odd number of bits the order of what follows turns round
        keys.append(rank)
        odd = np.where(rank & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return keys[::-1]


def different(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


class GrayTree:
    """Nodes over codes in the order of their buckets and of Gray ranks in each. bucket and group: a number for each code; codes of one bucket and of different groups are paired."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray, group: np.ndarray, radius: int) -> None:
        self.radius, self.seen, self.pruned = radius, 0, 0
        pattern, vary, first, last = codes, np.zeros_like(codes), bucket, bucket
        self.levels = [(pattern, vary, first, last)]
        while len(pattern) > RUN:
            starts = np.arange(0, len(pattern), RUN)
            ends = np.minimum(starts + RUN, len(pattern))
            upper = pattern[starts]
            vary = np.bitwise_or.reduceat((pattern ^ np.repeat(upper, ends - starts, axis=0)) | vary, starts, axis=0)
            pattern, first, last = upper, first[starts], last[ends - 1]
            self.levels.append((pattern, vary, first, last))
        self.regroup(group)

    def regroup(self, group: np.ndarray) -> None:
        """What is one group by now isn't paired any more."""
        low, high = group, group
        self.groups = [(low, high)]
        for _ in self.levels[1:]:
            starts = np.arange(0, len(low), RUN)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.groups.append((low, high))

    def left(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of nodes, the first never after the second, that may have a pair of codes under them."""
        pattern, vary, first, last = self.levels[level]
        low, high = self.groups[level]
        seen = len(a)
        keep = (last[a] >= first[b]) & ((low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b]))
        a, b = a[keep], b[keep]
        keep = np.bitwise_count((pattern[a] ^ pattern[b]) & ~(vary[a] | vary[b])).sum(axis=1, dtype=np.int32) <= self.radius
        if level:
            self.seen += seen
            self.pruned += seen - int(keep.sum())
        return a[keep], b[keep]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of codes within the radius, in parts. regroup() between these counts from the next on."""
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]), 0 if top else 1)
        waiting = [(top, *self.left(top, a, b))]
        while waiting:
            level, a, b = waiting.pop()
            if not level:
                if len(a):
                    yield a, b
                continue
            for at in range(PAIRS, len(a), PAIRS):
                waiting.append((level, a[at : at + PAIRS], b[at : at + PAIRS]))
            a, b = a[:PAIRS], b[:PAIRS]
            size = len(self.levels[level - 1][0])
            below = np.arange(RUN)
            one = np.broadcast_to((a[:, None] * RUN + below)[:, :, None], (len(a), RUN, RUN)).ravel()
            other = np.broadcast_to((b[:, None] * RUN + below)[:, None, :], (len(a), RUN, RUN)).ravel()
            real = (one < size) & (other < size) & ((one < other) if level == 1 else (one <= other))
            waiting.append((level - 1, *self.left(level - 1, one[real], other[real])))


class Forest:
    """Numbers 0 to n - 1, joined by pairs; root: the smallest that each is joined to."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Returns those of the pairs that joined what was apart: no two of them the same trees."""
        used = []
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return tuple(np.concatenate(z) for z in zip((np.zeros(0, int),) * 2, *used, strict=True))  # type: ignore[return-value]
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.append(True, np.diff(high[order]) != 0)]
            self.root[high[first]] = low[first]
            used.append((a[first], b[first]))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


#: Pairs that are held to be sorted at once; where there are more, the nearest are joined first, step by step.
HELD, STEPS = 1 << 19, 8


def linked(codes: np.ndarray, bucket: np.ndarray, radius: int, passes=None, counts: dict[str, int] | None = None, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links between codes of the same bucket, such that codes within the radius of each other, and what chains of such join, are one tree. passes(a, b): which of the pairs count.

    nearest: the forest is one of least distances, whole or by STEPS steps of the radius, so that each code hangs by a link as short as any."""
    order = np.lexsort((*gray_keys(codes), bucket))
    tree, forest = GrayTree(codes[order], bucket[order], np.arange(len(codes)), radius), Forest(len(codes))
    found = [(np.zeros(0, int), np.zeros(0, int))]

    def join(a: np.ndarray, b: np.ndarray) -> int:
        if nearest:
            apart_ = different(tree.levels[0][0][a], tree.levels[0][0][b])
            cuts = [a[apart_ == x] for x in np.unique(apart_)], [b[apart_ == x] for x in np.unique(apart_)]
        else:
            cuts = [a], [b]
        joined = 0
        for x, y in zip(*cuts, strict=True):
            x, y = forest.join(x, y)
            found.append((order[x], order[y]))
            joined += len(x)
        return joined

    def passing() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in tree.pairs():
            keep = slice(None) if passes is None else passes(order[a], order[b])
            yield a[keep], b[keep]

    held, n = [], 0
    for a, b in passing() if nearest else ():
        held.append((a, b))
        n += len(a)
        if n > HELD:
            break
    if nearest and n <= HELD:
        join(*(np.concatenate([np.zeros(0, int), *x]) for x in (zip(*held, strict=True) if held else ((), ()))))
    else:
        for step in range(1, STEPS + 1) if nearest else (STEPS,):
            tree.radius, since = radius * step // STEPS, 0
            tree.regroup(forest.root)
            for a, b in passing():
                since += join(a, b)
                if 16 * since > len(codes):
                    tree.regroup(forest.root)
                    since = 0
    if counts is not None:
        counts["seen"], counts["pruned"] = counts.get("seen", 0) + tree.seen, counts.get("pruned", 0) + tree.pruned
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def apart(codes: np.ndarray, bucket: np.ndarray, group: np.ndarray, radius: int, passes=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of codes of the same bucket and of different groups within the radius, in parts."""
    order = np.lexsort((*gray_keys(codes), group, bucket))
    tree = GrayTree(codes[order], bucket[order], np.unique(group[order], return_inverse=True)[1], radius)
    for a, b in tree.pairs():
        a, b = order[a], order[b]
        if passes is not None:
            keep = passes(a, b)
            a, b = a[keep], b[keep]
        yield a, b


def nearest_apart(codes: np.ndarray, bucket: np.ndarray, group: np.ndarray, radius: int, passes=None) -> tuple[np.ndarray, np.ndarray]:
    """For each code that has any, the nearest of the same bucket and another group within the radius, the first of several: at most a pair a code, whatever the groups' sizes."""
    best = np.full(len(codes), np.iinfo(np.int64).max)
    for a, b in apart(codes, bucket, group, radius, passes):
        far = different(codes[a], codes[b]).astype(np.int64) << 40
        np.minimum.at(best, a, far | b)
        np.minimum.at(best, b, far | a)
    found = np.flatnonzero(best < np.iinfo(np.int64).max)
    return found, best[found] & ((1 << 40) - 1)


@dataclass(frozen=True)
class Deal:
    """Masks, a number for each part of a code. What is dealt anew goes under those of the next deal."""

    masks: tuple[tuple[int, ...], ...]


def blocks(of) -> Deal:
    """Masks of one part: bits of the same of(place) are a block."""
    kinds = sorted({of(i) for i in range(BITS)})
    return Deal(tuple((sum(1 << i for i in range(BITS) if of(i) == kind),) for kind in kinds))


def exact_deals(radius: int) -> list[Deal]:
    """Blocks of one part, one more than the bits that may differ: whole runs, then bits spread over the runs in two ways."""
    n = radius + 1
    return [blocks(lambda i: i * n // BITS), blocks(lambda i: i % n), blocks(lambda i: i // n % n)]


def random_deal(parts: int, bits: int, count: int, seed: int) -> Deal:
    """Masks of so many bits each, drawn from all parts."""
    rng = np.random.default_rng(seed)
    drawn = [rng.choice(BITS * parts, bits, replace=False) for _ in range(count)]
    return Deal(tuple(tuple(sum(1 << int(b % BITS) for b in mask if b // BITS == part) for part in range(parts)) for mask in drawn))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(code: Column) -> Column:
    """Of a long as 64 bits; the first bit is turned, so that signed order is that of the ranks."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def dealt(rows: DataFrame, names: list[str], deal: Deal, anew: bool) -> DataFrame:
    """rows: names and what else they have. A row for each mask, with bucket and pattern; anew: rows have these already, and the new ones are within the old."""
    further = [c for c in rows.columns if c not in ("bucket", "pattern")]
    kinds = []
    for i, mask in enumerate(deal.masks):  # as text: Spark parses it at once, where hundreds of Columns would be as many calls
        under = [f"{n} & CAST('{signed(m)}' AS BIGINT)" for n, m in zip(names, mask, strict=True) if m]
        bucket = f"bucket * {len(deal.masks)} + {i}" if anew else f"{i}"
        pattern = f"xxhash64({', '.join(['pattern'] * anew + under)})" if anew or len(names) > 1 else under[0]
        kinds.append(f"struct(CAST({bucket} AS BIGINT) AS bucket, {pattern} AS pattern)")
    out = rows.selectExpr(*further, f"inline(array({', '.join(kinds)}))")
    return out if anew or len(names) > 1 else out.withColumn("pattern", gray_rank(F.col("pattern")))


_LINKS = "kind string, a long, b long, bucket long"


def _search(names: list[str], radius: int, again: bool, least: float | None, others: bool):
    """others: each class's nearest of another group; else a forest. least: the smallest share that the smaller of two sizes is of the larger."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: str, a: np.ndarray, b: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), *(pa.array(x, pa.int64()) for x in (a, b, bucket))], names=["kind", "a", "b", "bucket"])

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """rows: bucket, pattern, id, size, group, codes; buckets whole and one after another."""
            starts = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            sizes = np.diff(np.append(starts, len(rows)))
            number = np.repeat(np.arange(len(starts)), sizes)
            if again and (over := sizes > BUCKET).any():
                more = rows[over[number]]
                yield out("again", more[:, 2], more[:, 1], more[:, 0])
            keep = (sizes > 1) & ~(again & (sizes > BUCKET))
            rows, number = rows[keep[number]], number[keep[number]]
            if not len(rows):
                return
            ids, counted, group, codes = rows[:, 2], rows[:, 3], rows[:, 4], np.ascontiguousarray(rows[:, 5:]).view(np.uint64)
            passes = None if least is None else lambda a, b: np.minimum(counted[a], counted[b]) >= least * np.maximum(counted[a], counted[b]) - 1e-6
            a, b = nearest_apart(codes, number, group, radius, passes) if others else linked(codes, number, radius, passes, nearest=least is not None)
            for at in range(0, len(a), CHUNK):
                x, y = ids[a[at : at + CHUNK]], ids[b[at : at + CHUNK]]
                yield out("link", x, y, np.zeros(len(x), np.int64))

        held, n, need, over = [], 0, CHUNK, None
        for batch in batches:
            rows = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("bucket", "pattern", "id", "size", "group", *names)], axis=1)
            if over is not None and len(rows):  # a bucket that is dealt anew goes through
                same = (rows[:, :2] == over).all(axis=1)
                count = len(rows) if same.all() else int(np.argmin(same))
                yield out("again", rows[:count, 2], rows[:count, 1], rows[:count, 0])
                over, rows = (over if count == len(rows) else None), rows[count:]
            held.append(rows)
            n += len(rows)
            if n < need:
                continue
            whole = np.concatenate(held)
            edges = np.flatnonzero((whole[1:, :2] != whole[:-1, :2]).any(axis=1)) + 1
            cut = int(edges[-1]) if len(edges) else 0  # the last bucket may go on
            if cut:
                yield from found(whole[:cut])
            whole = whole[cut:]
            if again and len(whole) > BUCKET:
                yield out("again", whole[:, 2], whole[:, 1], whole[:, 0])
                over, whole = whole[0, :2].copy(), whole[:0]
            held, n = [whole], len(whole)
            need = max(CHUNK, 2 * n)
        if n:
            yield from found(np.concatenate(held))
        held.clear()
        give_back()

    return run


def class_links(classes: DataFrame, names: list[str], deals: list[Deal], radius: int, least: float | None = None, others: bool = False, start: int = 0) -> DataFrame:
    """classes: id, size, group, and the codes' names. Returns a, b: ids of linked classes; a table, which the caller may drop.

    A forest in each bucket, or each class's nearest of another group. A bucket of more than BUCKET classes is dealt anew, those found in a sample before the shuffle, so that none of
    them goes to one task; the last deal's are searched as they are. start: the deals before it are gone through at once."""
    spark = classes.sparkSession
    columns = ["id", "size", "group", *names]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, n, links, made = classes.select(*columns), classes.count(), [], []
    for depth in range(start):
        rows = dealt(rows, names, deals[depth], depth > 0)
        n *= len(deals[depth].masks)
    for depth in range(start, len(deals)):
        last, source = depth == len(deals) - 1, rows
        rows = dealt(source, names, deals[depth], depth > 0)
        n *= len(deals[depth].masks)
        hot = None
        if not last:
            few = dealt(source.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0), names, deals[depth], depth > 0)
            hot = written(few.groupBy("bucket", "pattern").count().filter(F.col("count") * SAMPLE > 2 * BUCKET).select("bucket", "pattern"), "hot")  # at most a row for 2 x BUCKET of all
            made.append(hot)
            if hot.isEmpty():
                hot = None
        cold = rows if hot is None else rows.join(F.broadcast(hot), ["bucket", "pattern"], "left_anti")
        ranges = max(tasks, -(-n // TASK))
        cold = cold.repartitionByRange(ranges, "bucket", "pattern") if len(names) == 1 else cold.repartition(ranges, "bucket", "pattern")
        swept = written(cold.sortWithinPartitions("bucket", "pattern").mapInArrow(_search(names, radius, not last, least, others), _LINKS), "links")
        made.append(swept)
        links.append(swept.filter("kind = 'link'").select("a", "b"))
        if last:
            break
        over = swept.filter("kind = 'again'").select(F.col("a").alias("id"), F.col("b").alias("pattern"), "bucket")
        more = [] if over.isEmpty() else [over.join(classes.select(*columns), "id").select(*columns, "bucket", "pattern")]
        if hot is not None:
            more.append(rows.join(F.broadcast(hot), ["bucket", "pattern"], "left_semi").select(*columns, "bucket", "pattern"))
        if not more:
            break
        rows = written(reduce(DataFrame.unionByName, more), "again")
        made.append(rows)
        n = rows.count()
    found = written(reduce(DataFrame.unionByName, links).distinct(), "links")
    for table in made:
        drop(table)
    return found


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns id, root: for every id in a link that isn't the smallest of its component, that smallest one. Large-star and small-star in turn, until nothing changes."""
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    state, before = written(ordered, "star"), None
    total = state.count()
    while True:
        # large-star: from each node, its larger neighbours go to its smallest
        both = state.unionByName(state.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v: the node, u: a neighbour
        least = written(both.groupBy("v").agg(F.count("*").alias("n"), F.least(F.min("u"), F.col("v")).alias("m")), "star-least")
        large = looked_up(both, "v", least, total=2 * total).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = written(large.filter("v <> u").distinct(), "star-large")
        drop(least)
        # small-star: each node and its smaller neighbours go to the smallest of them
        least = written(large.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("m")), "star-least")
        small = looked_up(large, "v", least, total=total).select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        old, state = state, written(small.filter("v <> u").distinct(), "star")
        mark = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        for table in (old, large, least):
            drop(table)
        if mark == before or not mark[0]:
            found = written(state.select(F.col("v").alias("id"), F.col("u").alias("root")), "roots")
            drop(state)
            return found
        before, total = mark, mark[0]


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """texts: id, n, text. Returns id, n, set: the different hashes of the text's shingles in order, 8 bytes each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words).tobytes() for text in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n"], pa.array(sets, pa.binary())], names=["id", "n", "set"])

    return texts.select("id", "n", "text").mapInArrow(run, "id long, n long, set binary")


def similar(a: bytes, b: bytes, least: float) -> bool:
    """Whether two sets of shingle_sets() have a Jaccard similarity of least or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-6:
        return False
    shared = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
    return shared >= least * ((len(a) + len(b)) // 8 - shared) - 1e-9


def undirected(links: DataFrame) -> DataFrame:
    """links: a, b. Each pair of two different ids once, the smaller first."""
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, contents: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """pairs: a table of undirected(); contents: id, content of each class. Returns those of the pairs whose texts' sets of shingles are similar; a table, which the caller may drop."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x.as_buffer(), y.as_buffer(), least) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).join(contents, "id"), "ends")
    texts, few = docs.select(F.xxhash64("text").alias("content"), "text"), ends.count() <= BROADCAST
    if few:
        texts = texts.join(F.broadcast(ends.select("content")), "content", "left_semi")
    texts = texts.groupBy("content").agg(F.first("text").alias("text"))  # of copies, each task sends one
    sets = written(shingle_sets(texts.join(F.broadcast(ends) if few else ends, "content"), words), "sets", BATCH)
    sides = pairs
    for end in ("a", "b"):
        sides = looked_up(sides, end, sets.select(F.col("id").alias(end), "n", F.col("set").alias(f"set_{end}")))
    found = written(sides.mapInArrow(run, "a long, b long"), "links", BATCH)
    for table in (ends, sets):
        drop(table)
    return found


def classes_of(prints: DataFrame, names: list[str]) -> DataFrame:
    """prints with their class: the codes, hashed if there are several."""
    return prints.withColumn("id", F.col(names[0]) if len(names) == 1 else F.xxhash64(*names))


def grouped(prints: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """prints: doc_id, content, id and others; classes: id, n, first; links: a, b. Returns prints with group (one number for all that chains of links reach) and component_id, the smallest id of the group."""
    roots = components(links)
    known = written(classes.join(roots, "id", "left").select("id", "n", "first", F.coalesce("root", "id").alias("group")), "classes")
    firsts = known.groupBy("group").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
    named = looked_up(known, "group", firsts).select("id", "n", "group", F.coalesce("component_id", "first").alias("component_id"))
    named = written(named, "components")
    drop(roots)
    drop(known)
    return looked_up(prints, "id", named)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, fingerprint (16 hexadecimal digits) and component_id, of all links at radius differing bits or fewer."""
    prints = classes_of(written(fingerprints(docs, words), "fingerprints"), ["f0"])
    classes = written(prints.groupBy("id").agg(F.first("f0").alias("f0"), F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    # with more classes than that, nearly all buckets of the first deal would be dealt anew
    start = 1 if classes.count() > BUCKET << BITS // (radius + 1) else 0
    links = class_links(classes.select("id", F.lit(0).cast("long").alias("size"), F.col("id").alias("group"), "f0"), ["f0"], exact_deals(radius), radius, start=start)
    found = grouped(prints, classes, links)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: For similarity 0.8 of the sets of shingles: the cosine is about 0.89, and 15 % of the bits differ, give or take 2 %. A bucket is of the classes that are equal in so many drawn
#: bits, at least MASK_BITS; such a pair meets in one of the masks' buckets with a chance of FIRST_MET, nearer ones nearly surely. What meets within the radius is a candidate and is
#: verified; what doesn't is left to the exact join. What is dealt anew under masks of AGAIN_BITS meets there with a chance of MET.
SIMILAR, SIMILAR_PARTS, SIMILAR_RADIUS, MASK_BITS, AGAIN_BITS, FIRST_MET, MET, ALIKE_BITS = 0.8, 4, 58, 18, 8, 0.7, 0.999, 0.8485
#: What a bucket has of other texts, about, as a power of two.
OTHERS = 6
#: Shingles of one text of so many are counted, and those that so many of these have are last in the order, at most so many shingles. An order alone: any gives the same links.
COUNTED, FREQUENT, MOST_FREQUENT = 16, 3, 1 << 18
#: Pairs that are looked at at once.
LOOK = 1 << 19
#: Rows with texts or sets that Python gets at once.
BATCH = 1024
#: A power of two.
PARITIES = 2048


def masks_for(bits: int, met: float = MET) -> int:
    """So many masks that a pair meets with a chance of met."""
    return math.ceil(math.log(1 - met) / math.log(1 - ALIKE_BITS**bits))


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of frequent shingles, the most frequent last: of a share of the different texts, counted by the executors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in texts_of(batch["text"]):
                found = shingle_set(text, words)
                for at in range(0, len(found), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 16)].view(np.int64))], names=["shingle"])

    content = F.xxhash64("text")
    texts = docs.select(content.alias("content"), "text").filter(F.pmod("content", F.lit(COUNTED)) == 0).groupBy("content").agg(F.first("text").alias("text"))
    counts = written(texts.select("text").mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= FREQUENT), "frequent", BATCH)
    n, fewest = 0, None
    for row in counts.groupBy(F.col("count").alias("times")).count().orderBy(F.desc("times")).collect():
        n += row["count"]
        if n > MOST_FREQUENT:
            break
        fewest = row["times"]
    found = sorted((r["count"], r["shingle"]) for r in counts.filter(F.col("count") >= fewest).collect()) if fewest else []
    drop(counts)
    return np.array([shingle for _, shingle in found], np.int64).view(np.uint64)


def first_shingles(found: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, least: float) -> np.ndarray:
    """So many of a set's shingles, in the order of all (by hash, but the frequent ones last), that it shares one of them with every set of a similarity of least: the first one that
    both have. frequent: in order of their hashes, with their ranks."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        found = found[np.lexsort((found, np.where(frequent[at] == found, ranks[at] + 1, 0)))]
    return found[: len(found) - math.ceil(least * len(found) - 1e-6) + 1]


def parities(found: np.ndarray) -> np.ndarray:
    """PARITIES bits: whether the number of a set's shingles is odd in each of as many parts of all. Two sets differ in as many shingles at least as they do in bits."""
    return np.packbits(np.bincount((found >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64), minlength=PARITIES) & 1 == 1)


def possible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """pairs: a, b; classes: id, size, parities. Returns those of the pairs that may be of a similarity of least by their parities, which are far smaller than sets; none that is goes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch[f"parities_{end}"].to_pylist()), np.uint64).reshape(len(batch), -1) for end in ("a", "b")] if len(batch) else [np.zeros((0, 1), np.uint64)] * 2
            keep = different(*sides) <= (1 - least) / (1 + least) * (batch["size_a"].to_numpy() + batch["size_b"].to_numpy()) + 1e-6
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    ends = written(ends.join(classes.select("id", "size", "parities"), "id"), "ends")
    sides = pairs
    for end in ("a", "b"):
        sides = looked_up(sides, end, ends.select(F.col("id").alias(end), "n", F.col("size").alias(f"size_{end}"), F.col("parities").alias(f"parities_{end}")))
    found = written(sides.mapInArrow(run, "a long, b long"), "pairs", 4 * BATCH)
    drop(ends)
    return found


def set_prints(docs: DataFrame, words: int, parts: int, least: float) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, content, id (a hash of the set of shingles: equal sets are one class), size of the set, parities, f0, f1 ... and first_shingles, 8 bytes each."""
    ship(docs.sparkSession)
    names, frequent = [f"f{i}" for i in range(parts)], frequent_shingles(docs, words)
    order = np.argsort(frequent)
    held = docs.sparkSession.sparkContext.broadcast((frequent[order], order))  # at most MOST_FREQUENT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [shingle_set(text, words) for text in texts_of(batch["text"])]
            bits = np.array([majority([x], parts)[0] for x in sets], np.uint64).reshape(-1, parts).view(np.int64)
            ids = np.array([xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            columns = [pa.array(ids), pa.array([len(x) for x in sets], pa.int64()), pa.array([parities(x).tobytes() for x in sets], pa.binary()), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(parts)), pa.array([first_shingles(x, *held.value, least).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["content"], *columns], names=["doc_id", "content", "id", "size", "parities", *names, "first_shingles"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("content")).mapInArrow(run, f"doc_id {kind}, content long, id long, size long, parities binary, " + ", ".join(f"{n} long" for n in names) + ", first_shingles binary")


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of the first shingles of a class: the shingle, the class's id, size and group, and the shingle's place."""
    for batch in batches:
        firsts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch["first_shingles"]]
        ends = np.cumsum([0, *map(len, firsts)])
        first = 0
        while first < len(firsts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + (1 << 16), side="right")) - 1)
            counts = np.diff(ends[first : last + 1])
            sizes = np.repeat(batch["size"].to_numpy()[first:last], counts)
            places = np.arange(ends[first], ends[last]) - np.repeat(ends[first:last], counts)
            columns = [np.concatenate(firsts[first:last]), np.repeat(batch["id"].to_numpy()[first:last], counts), sizes << 32 | places, np.repeat(batch["group"].to_numpy()[first:last], counts)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shingle", "id", "place", "group"])
            first = last


def sharing(shingle: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows, in parts, of the same shingle and of different groups that sizes and places allow: what two sets have in common is no more than what either has from its first
    common shingle on. Rows of one shingle are one after another."""
    starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(shingle))))
    order = np.lexsort((group, number))
    number, group, size, place = number[order], group[order], size[order], place[order]
    after = np.append(starts[1:], len(number))[number]
    turns = np.append(np.flatnonzero((number[1:] != number[:-1]) | (group[1:] != group[:-1])) + 1, len(number))
    other = turns[np.searchsorted(turns, np.arange(len(number)), side="right")]  # where its group ends
    ends = np.cumsum(np.append(0, after - other))
    for at in range(0, int(ends[-1]), LOOK):
        pair = np.arange(at, min(at + LOOK, int(ends[-1])))
        a = np.searchsorted(ends, pair, side="right") - 1
        b = other[a] + pair - ends[a]
        keep = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-6
        a, b = a[keep], b[keep]
        keep = np.minimum(size[a] - place[a], size[b] - place[b]) >= least / (1 + least) * (size[a] + size[b]) - 1e-6
        yield order[a[keep]], order[b[keep]]


def _meeting(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of _placed(), those of one shingle one after another. Pairs of ids, the smaller first, each once for a run of rows."""

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            shingle, ids, place, group = rows.T
            alone = np.append(True, shingle[1:] != shingle[:-1]) & np.append(shingle[1:] != shingle[:-1], True)
            shingle, ids, place, group = shingle[~alone], ids[~alone], place[~alone], group[~alone]
            kept, n = [], 0
            for a, b in sharing(shingle, group, place >> 32, place & 0xFFFFFFFF, least) if len(ids) else ():
                kept.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], axis=1))
                n += len(a)
                if n > LOOK:
                    yield from out(kept)
                    kept, n = [], 0
            if n:
                yield from out(kept)

        def out(kept: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pairs = np.concatenate(kept)
            pairs = pairs[np.lexsort(pairs.T)]
            pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]
            for at in range(0, len(pairs), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs[at : at + CHUNK].T], names=["a", "b"])

        held, n, need = [], 0, 8 * CHUNK
        for batch in batches:
            held.append(np.stack([batch[c].to_numpy() for c in ("shingle", "id", "place", "group")], axis=1))
            n += len(batch)
            if n < need:
                continue
            whole = np.concatenate(held)
            edges = np.flatnonzero(whole[1:, 0] != whole[:-1, 0]) + 1
            cut = int(edges[-1]) if len(edges) else 0  # the last shingle's rows may go on
            yield from found(whole[:cut]) if cut else ()
            held, n = [whole[cut:]], len(whole) - cut
            need = max(8 * CHUNK, 2 * n)
        if n:
            yield from found(np.concatenate(held))
        held.clear()
        give_back()

    return run


def sharing_pairs(classes: DataFrame, least: float) -> DataFrame:
    """classes: id, size, group, first_shingles. Returns a, b: all pairs of classes of different groups that share one of these and may be of a similarity of least, maybe more than once."""
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = classes.agg(F.sum(F.length("first_shingles"))).first()[0] or 0
    rows = classes.select("id", "size", "group", "first_shingles").mapInArrow(_placed, "shingle long, id long, place long, group long")
    return rows.repartition(max(tasks, -(-n // 8 // TASK)), "shingle").sortWithinPartitions("shingle").mapInArrow(_meeting(least), "a long, b long")


def similar_groups(docs: DataFrame, words: int) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, content and group: texts whose sets of shingles have a similarity of SIMILAR or more, and what chains of such reach, are one group."""
    names = [f"f{i}" for i in range(SIMILAR_PARTS)]
    prints = written(set_prints(docs, words, SIMILAR_PARTS, SIMILAR), "fingerprints", BATCH)
    classes = written(prints.groupBy("id").agg(*(F.first(n).alias(n) for n in names), F.first("size").alias("size"), F.first("parities").alias("parities"), F.first("first_shingles").alias("first_shingles"), F.min("doc_id").alias("first"), F.min("content").alias("content"), F.count("*").alias("n")), "classes")
    whole, prints = prints, written(prints.select("doc_id", "content", "id"), "prints")
    drop(whole)
    bits = max(MASK_BITS, math.ceil(math.log2(classes.count() + 1)) - OTHERS)
    deals = [random_deal(SIMILAR_PARTS, bits, masks_for(bits, FIRST_MET), 11), random_deal(SIMILAR_PARTS, AGAIN_BITS, masks_for(AGAIN_BITS), 12)]
    contents = classes.select("id", "content")
    links = class_links(classes.select("id", "size", F.col("id").alias("group"), *names), names, deals, SIMILAR_RADIUS, SIMILAR)
    candidates = written(undirected(links), "pairs")
    joined = verified(candidates, contents, docs, words, SIMILAR)
    roots = components(joined)
    free_heaps(docs.sparkSession)
    near = written(sharing_pairs(classes.join(roots, "id", "left").select("id", "size", F.coalesce("root", "id").alias("group"), "first_shingles"), SIMILAR), "links", 8 * BATCH)
    others = written(undirected(near).join(candidates, ["a", "b"], "left_anti"), "pairs")  # what has been verified already isn't again
    drop(near)
    likely = possible(others, classes, SIMILAR)
    rest = verified(likely, contents, docs, words, SIMILAR)
    found = grouped(prints, classes, joined.unionByName(rest)).select("doc_id", "content", "group")
    for table in (links, candidates, roots, others, likely, joined, rest):
        drop(table)
    return found


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs, all columns, with one row of each group of near-duplicates: shingles of five words, sets of similarity 0.8 or more.

    A bit of a fingerprint differs with the angle between two sets, so that candidates are within a radius of 256 bits; their sets decide. The row that stays is the one with the
    smallest id that isn't null, of several such the one whose text has the smallest hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content"))
    mark, ids, contents = (unused(f"vitrine_{n}", docs) for n in ("text", "id", "content"))
    kept = similar_groups(docs, words).groupBy("group").agg(first.alias("kept")).select(F.col("kept.doc_id").alias(ids), F.col("kept.content").alias(contents))
    left = docs.withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark])  # repeated rows are one before they are sent on
    return left.join(kept, F.col("doc_id").eqNullSafe(F.col(ids)) & (F.col(mark) == F.col(contents)), "left_semi").drop(mark)
