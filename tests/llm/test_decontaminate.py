import random
import re

from vitrine.llm import decontaminate as d


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best_run(a, b):
    now = best = 0.0
    for x, y in zip(a, b, strict=True):
        now = max(0.0, now + (1 if x == y else -d.MISMATCH))
        best = max(best, now)
    return best


def brute(docs, items):
    """(doc, item): how many items, and the score of the best alignment, by looking at all alignments, without seeds."""
    distinct = {}
    for key, text in items:
        if w := tuple(tokens(text)):
            distinct.setdefault(w, []).append(key)
    out = {}
    for key, text in set(docs):
        own = tokens(text)
        for its, ids in distinct.items():
            n, score = len(its), None
            for shift in range(1 - n, len(own)):
                first, last = max(0, -shift), min(n, len(own) - shift)
                a, b = own[first + shift : last + shift], its[first:last]
                run = best_run(a, b)
                if n >= d.SPAN:
                    ok = run >= d.least_score(n)
                else:
                    ok = last - first == n and sum(x != y for x, y in zip(a, b, strict=True)) <= (n >= 7) and (n >= 5 or len(own) == n)
                if ok:
                    score = max(score or 0.0, run)
            if score is not None:
                out[key, min(x for x in ids if x is not None)] = (len(ids), score)
    return out


def world():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 90)))) for i in range(12)]
    items += [(100, items[0][1].upper() + "!"), (None, items[1][1]), (101, "five short words stand here"), (102, "too short"), (103, None), (104, ""), (105, "one two three four five six seven eight"), (106, "a b c d e f g h i j"), (107, "..."), (108, "a b c d e f g h i j k")]
    docs = []
    for i in range(60):
        body = rng.choices(vocabulary, k=rng.randint(0, 150))
        if i % 3 == 0:
            passage = tokens(items[rng.randrange(12)][1])
            for p in range(rng.randint(0, 6), len(passage), rng.randint(4, 9)):
                passage[p] = "changed"  # substitutions
            at = rng.randint(0, len(body))
            body[at:at] = passage
        docs.append((i, " ".join(body)))
    docs += [(200, "X five, short WORDS stand here y"), (201, None), (202, ""), (203, f"{items[2][1]} {items[2][1]}"), (204, items[3][1]), (205, "w1 " * 400)]
    docs += [(210, "Too short!"), (211, "it is too short for that"), (212, "x one two three 4 five six seven eight y"), (213, "one two 3 four 5 six seven eight"), (214, "five short words stand there")]
    docs += [(220, "y a b c d x f g h i j"), (221, "x b c d e f g x x x"), (222, "a b x d e f x h i j"), (223, "a b c d e x x x x x x"), (224, "q a b c d x f g h i x k"), (225, "d e f g h i j k")]
    return docs, items


def test_all_overlaps_are_found(spark):
    docs, items = world()
    rows = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, item_id long, score string").repartition(3)
    bench = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, key string")
    found = {(r["doc_id"], r["item_id"]): (r["items"], r["score"]) for r in d.overlaps(rows, bench).collect()}
    expected = brute(docs, items)
    assert found == expected and len(expected) > 15 and {(200, 101), (204, 3), (210, 102), (212, 105), (220, 106), (221, 106)} <= expected.keys()
    assert not {(211, 102), (213, 105), (214, 101)} & expected.keys()
    twice = d.overlaps(rows.unionByName(rows), bench)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, d.overlaps(rows, bench).collect()))


def test_clean_keeps_what_has_no_overlap(spark, edges, nothing):
    docs, items = world()
    dirty = {k for k, _ in brute(docs, items)}
    assert len(dirty) > 15
    rows = spark.createDataFrame([*docs, (None, items[4][1]), (None, "clean"), docs[0], docs[1]], "doc_id long, text string").selectExpr("*", "1 AS vitrine_id", "'c' AS content")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.clean(rows, bench)
    assert kept.columns == rows.columns
    expected = sorted([k for k, _ in [*docs, docs[0], docs[1]] if k not in dirty])
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == expected and ids.count(None) == 1
    assert d.clean(edges, bench).count() == edges.count()
    assert d.clean(nothing, bench).count() == 0 == d.overlaps(nothing, bench).count()
    assert d.overlaps(edges, bench.limit(0)).count() == 0


def test_main_path_is_native(spark, edges):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    plan = d.overlaps(edges.select("doc_id", "text"), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_blocks_of_seeds(spark, monkeypatch):
    docs, items = world()
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.overlaps(rows, bench).collect()))
    monkeypatch.setattr(d, "BLOCK", 700)
    assert sorted(map(tuple, d.overlaps(rows, bench).collect())) == whole


def test_every_passage_that_counts_is_found(spark):
    """Against all alignments, without masks: regular and random replacements."""
    rng = random.Random(6)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate((10, 11, 12, 15, 23, 40, 100))]
    docs = []
    for _, text in items:
        its = text.split()
        patterns = [range(start, len(its), step) for step in (3, 4, 5, 6, 7) for start in range(step)]
        patterns += [rng.sample(range(min(23, len(its))), rng.randint(1, 7)) for _ in range(30)]
        for replaced in map(set, patterns):
            docs.append((len(docs), " ".join("changed" if p in replaced else w for p, w in enumerate(its if rng.random() < 0.5 else its[:23]))))
    expected = brute(docs, items)
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["items"], r["score"]) for r in d.overlaps(rows, bench).collect()}
    assert found == expected and 100 < len(expected) < len(docs)


def test_masks_leave_no_short_pattern():
    """All places of up to four replaced words in the shortest passages that count, by each seed's positions; of the shortest items, of as many words as may be."""
    from itertools import combinations
    from math import ceil

    seeds = [(window, positions) for _, window, positions, _, most in d.seeds_for([10, 11]) if most > 11]
    for n, most in ((10, 4), (11, 4), (12, 4), (13, 5)):
        own = [(window, positions) for _, window, positions, _, upto in d.seeds_for([10, 11]) if upto >= n]
        for replaced in range(1, most + 1):
            for places in combinations(range(n), replaced):
                if best_run([i in places for i in range(n)], [False] * n) >= d.least_score(n):
                    assert any(not {at + p for p in positions} & set(places) for window, positions in own for at in range(n - window + 1)), (n, places)
    for replaced in range(1, 5):
        n = replaced + ceil(d.LEAST + d.MISMATCH * replaced)
        for places in combinations(range(n), replaced):
            assert any(not {at + p for p in positions} & set(places) for window, positions in seeds if window == d.SPAN for at in range(n - window + 1))


def test_very_long_items(spark):
    """Items of 2,000 words: what is broadcast is one row of fixed size a seed, and each alignment is scored once, whole."""
    rng = random.Random(9)
    items = [(i, " ".join(f"v{rng.randrange(5000)}" for _ in range(2000))) for i in range(5)]
    docs = [(0, items[0][1]), (1, " ".join(items[1][1].split()[500:1500])), (2, "none of it")]
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["score"], r["item_words"]) for r in d.overlaps(rows, bench).collect()}
    assert found == {(0, 0): (2000.0, 2000), (1, 1): (1000.0, 2000)}
    assert d.alignments(rows, bench).groupBy("doc_id").count().filter("count > 1").isEmpty()
    plan = d.overlaps(rows, bench)._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan
