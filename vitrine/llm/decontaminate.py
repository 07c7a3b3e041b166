"""Benchmark decontamination by spaced seeds.

A spaced seed hashes the words at some positions of a window and ignores those at the others, so that a copy with
words replaced still has windows whose hashes are those of the benchmark's. Hashes of all windows of the training
texts are joined with those of the benchmark; the training side is never shuffled. A hit says where the two texts lie side by side.
For each such alignment, once, all of the words that lie side by side are compared: a run of words counts 1 for each that is equal and costs MISMATCH for
each that isn't, and an overlap is confirmed if the best run counts least_score() or more. All of it is DataFrame operations.

Benchmark items with the same words are one item, the smallest id, so that copies don't multiply hits. Its seeds, a row of fixed size
each, go to every worker in blocks of at most BLOCK, each a pass of its own; there is one as a rule. Items' words and those of the documents that have hits are read
after that.

Defined cases: a null text is empty. An item of 10 words or more is found where the best run counts 7.5, or 0.6 of its words if that is less. Of 7 to 9 words, where
all of them but one at most stand one after another; of 5 or 6, all of them; of fewer, where all of them are the whole document, as
they say too little among others. An item without words is never found. Null ids of documents or items are kept as such (among
items with the same words, the smallest that isn't null stands for all). Repeated rows give one result. Tables may be
empty and may have further columns; only ids and texts are read. Very long texts and items are compared whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import unused, written

#: The positions of a window that a seed looks at. Every passage of up to 23 words that counts 7.5 has a hit inside it, however its words are replaced.
MASKS = ("1101100111", "1110010111", "1011011011", "1110101001", "1000110111", "1101011100", "0010101111", "1111110000", "0110100111")
SPAN = 10
#: Items of so few words have further masks and whole runs of CLOSE words as seeds too, as a passage of theirs may count less.
CLOSE_ITEMS, CLOSE, CLOSE_MASKS = 11, 6, ("1110101100", "0100011111")
#: Shorter items are found as a whole; from TOLERANT words on, one may be replaced; under SHORTEST, they must be the whole document.
TOLERANT, SHORTEST = 7, 5
MISMATCH = 1.5
LEAST, SHARE = 7.5, 0.6
#: Seeds that are broadcast at once, a row of some 60 bytes each.
BLOCK = 1_000_000
#: Up to so many documents with hits are picked, and so many contaminated ones left out, by a broadcast.
BROADCAST = 1_000_000

#: number, window, positions, and the least and most words of the items that have it
Seed = tuple[int, int, list[int], int, int]


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: runs of letters and digits, in lower case."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def least_score(words: int) -> float:
    return min(LEAST, SHARE * words)


def seeds_for(lengths: list[int]) -> list[Seed]:
    """lengths: those under CLOSE_ITEMS that items have. Spaced seeds, whole runs for items a little longer than a window, both halves or the whole of shorter ones."""
    kinds = [(SPAN, [j for j, c in enumerate(mask) if c == "1"], SPAN, 1 << 30) for mask in MASKS]
    if any(n >= SPAN for n in lengths):
        kinds += [(SPAN, [j for j, c in enumerate(mask) if c == "1"], SPAN, CLOSE_ITEMS) for mask in CLOSE_MASKS]
        kinds.append((CLOSE, list(range(CLOSE)), SPAN, CLOSE_ITEMS))
    for n in (n for n in lengths if n < SPAN):
        halves = [range(n // 2), range(n // 2, n)] if n >= TOLERANT else [range(n)]
        kinds += [(n, list(half), n, n) for half in halves]
    return [(number, *kind) for number, kind in enumerate(kinds)]


def _windows(rows: DataFrame, seeds: list[Seed], keep: list[str]) -> DataFrame:
    """rows: hashes and further columns. A row for each window: at, seed, key."""
    least = min(window for _, window, *_ in seeds)
    places = F.when(F.size("hashes") >= least, F.sequence(F.lit(0), F.size("hashes") - least)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*keep, "hashes", F.explode(places).alias("at"))
    keys = [F.struct(F.lit(number).alias("seed"), F.when(F.size("hashes") - F.col("at") >= window, F.xxhash64(*(F.get("hashes", F.col("at") + p) for p in positions))).alias("key")) for number, window, positions, *_ in seeds]
    return rows.select(*keep, "at", F.inline(F.array(*keys))).filter("key IS NOT NULL")


def _best_run(own: Column, its: Column) -> Column:
    """The best run of two lists of as many words."""
    def step(run: Column, p: Column) -> Column:
        count = F.greatest(F.lit(0.0), run["now"] + F.when(F.get(own, p) == F.get(its, p), F.lit(1.0)).otherwise(F.lit(-MISMATCH)))
        return F.struct(count.alias("now"), F.greatest(run["best"], count).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("best")), step, lambda run: run["best"])


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """benchmark: item_id, text. Returns item_id, items, item_hashes: a row for each different sequence of words that isn't empty."""
    return benchmark.select("item_id", word_hashes(F.col("text")).alias("item_hashes")).groupBy("item_hashes").agg(F.min("item_id").alias("item_id"), F.count("*").alias("items")).filter(F.size("item_hashes") > 0)


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Returns doc_id, content (a hash of the text), item_id, items (how many have the item's words), item_words, shift, hits, first_hit and score (the best run): a row for each alignment
    of a document with an item that has a hit and is confirmed."""
    items = written(benchmark_items(benchmark).withColumn("item", F.xxhash64("item_hashes")), "items")
    words = F.size("item_hashes")
    counts = items.agg(F.collect_set(F.when(words <= CLOSE_ITEMS, words)).alias("short"), F.sum(words * (len(MASKS) + 1)).alias("seeds")).first()  # at most CLOSE_ITEMS lengths
    seeds = seeds_for(sorted(counts["short"]))
    blocks = max(1, -(-(counts["seeds"] or 0) // BLOCK))
    texts = docs.select("doc_id", F.xxhash64("text").alias("content"), "text")
    hashed = texts.select("doc_id", "content", word_hashes(F.col("text")).alias("hashes"))
    found = []
    for block in range(blocks):
        part = items.filter(F.pmod("item", F.lit(blocks)) == block)
        own = _windows(part.select("item", words.alias("item_words"), F.col("item_hashes").alias("hashes")), seeds, ["item", "item_words"])
        fits = reduce(Column.__or__, ((F.col("seed") == number) & F.col("item_words").between(least, most) for number, _, _, least, most in seeds))
        own = own.filter(fits).select("item", "item_words", F.col("at").alias("item_at"), "seed", "key")
        hits = _windows(hashed, seeds, ["doc_id", "content"]).join(F.broadcast(own), ["seed", "key"])
        found.append(hits.select("doc_id", "content", "item", "item_words", (F.col("at") - F.col("item_at")).alias("shift"), "seed", "at"))
    rows = reduce(DataFrame.unionByName, found).distinct()  # of repeated rows, one
    lying = written(rows.groupBy("doc_id", "content", "item", "item_words", "shift").agg(F.count("*").alias("hits"), F.min("at").alias("first_hit")), "alignments")
    hit = written(lying.select(F.col("doc_id").alias("hit_id"), F.col("content").alias("hit_content")).distinct(), "hit")
    side = F.broadcast(hit) if hit.count() <= BROADCAST else hit
    texts = texts.join(side, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("content") == F.col("hit_content")), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "content"]).select(F.col("doc_id").alias("hit_id"), F.col("content").alias("hit_content"), word_hashes(F.col("text")).alias("hashes"))
    sides = lying.join(texts, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("content") == F.col("hit_content")))
    first = F.greatest(F.lit(0), -F.col("shift"))  # of the item's words
    start = F.greatest(F.lit(0), F.col("shift"))
    length = F.least(F.size("hashes") - start, F.col("item_words") - first)
    columns = ["doc_id", "content", "item_words", "shift", "hits", "first_hit"]
    sides = sides.select(*columns, "item", first.alias("first"), F.size("hashes").alias("doc_words"), F.slice("hashes", start + 1, length).alias("own"))
    sides = sides.join(items, "item").withColumn("its", F.slice("item_hashes", F.col("first") + 1, F.size("own")))
    scored = sides.withColumn("score", _best_run(F.col("own"), F.col("its"))).withColumn("equal", F.size(F.filter(F.zip_with("own", "its", lambda a, b: a == b), lambda x: x)))
    n = F.col("item_words")
    long = (n >= SPAN) & (F.col("score") >= F.least(F.lit(LEAST), SHARE * n))
    whole = (n < SPAN) & (F.size("own") == n) & (F.col("equal") >= n - F.when(n >= TOLERANT, 1).otherwise(0)) & ((n >= SHORTEST) | (F.col("doc_words") == n))
    return scored.filter(long | whole).select(*columns, "item_id", "items", "score")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Returns doc_id, item_id, items (how many have the item's words), item_words, hits, score (the best run of all alignments), and first_word: where the first hit is; of texts that share an id, those of all."""
    return alignments(docs, benchmark).groupBy("doc_id", "item_id", "items", "item_words").agg(F.sum("hits").alias("hits"), F.max("score").alias("score"), F.min("first_hit").cast("long").alias("first_word"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that overlap with an item; all columns stay. Pairs of documents and items aren't made: alignments are added up by document."""
    mark, ids, contents = (unused(f"vitrine_{n}", docs) for n in ("text", "id", "content"))
    dirty = written(alignments(docs, benchmark).select(F.col("doc_id").alias(ids), F.col("content").alias(contents)).distinct(), "contaminated")
    side = F.broadcast(dirty) if dirty.count() <= BROADCAST else dirty
    left = docs.withColumn(mark, F.xxhash64("text"))
    return left.join(side, F.col("doc_id").eqNullSafe(F.col(ids)) & (F.col(mark) == F.col(contents)), "left_anti").drop(mark)
