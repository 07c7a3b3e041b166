import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from vitrine.llm import simhash


def brute(text, n=3):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def clustered(rng, n, flips, parts=1):
    """Codes in families: each a copy of an earlier one with some bits turned."""
    codes = [[rng.getrandbits(64) for _ in range(parts)]]
    while len(codes) < n:
        code = list(rng.choice(codes)) if rng.random() < 0.8 else [rng.getrandbits(64) for _ in range(parts)]
        for _ in range(rng.randint(1, flips)):
            code[rng.randrange(parts)] ^= 1 << rng.randrange(64)
        codes.append(code)
    return np.unique(np.array(codes, np.uint64), axis=0)


def all_links(codes, radius):
    return [(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero(simhash.different(codes[i + 1 :], codes[i]) <= radius) + i + 1]


def forest(codes, radius, bucket=None):
    a, b = simhash.linked(codes, np.zeros(len(codes), int) if bucket is None else bucket, radius)
    return list(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize(("parts", "radius", "flips"), [(1, 3, 6), (1, 0, 2), (4, 44, 60)])
def test_index_finds_all_links(parts, radius, flips):
    for seed, n in ((0, 2), (1, 7), (2, 400), (3, 1500)):
        codes = clustered(random.Random(seed), n, flips, parts)
        links = forest(codes, radius)
        assert roots(len(codes), links) == roots(len(codes), all_links(codes, radius))
        assert len(links) == len(codes) - len(set(roots(len(codes), links)))
        assert all(simhash.different(codes[a], codes[b]) <= radius for a, b in links)
        bucket = np.random.default_rng(seed).integers(0, 3, len(codes))
        same = [(a, b) for a, b in all_links(codes, radius) if bucket[a] == bucket[b]]
        assert roots(len(codes), forest(codes, radius, bucket)) == roots(len(codes), same)


@pytest.mark.parametrize(("parts", "radius", "flips"), [(1, 3, 6), (4, 44, 60)])
def test_all_pairs_of_different_groups(parts, radius, flips):
    for seed, n in ((4, 2), (5, 9), (6, 700)):
        codes = clustered(random.Random(seed), n, flips, parts)
        rng = np.random.default_rng(seed)
        bucket, group = rng.integers(0, 2, len(codes)), rng.integers(0, 4, len(codes)) * 7 - 9
        found = [tuple(sorted(p)) for a, b in simhash.apart(codes, bucket, group, radius) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(found) == [(a, b) for a, b in all_links(codes, radius) if bucket[a] == bucket[b] and group[a] != group[b]]
        near = {}
        for a, b in found:
            x = int(simhash.different(codes[a], codes[b]))
            near[a], near[b] = min(near.get(a, 99), x), min(near.get(b, 99), x)
        a, b = simhash.nearest_apart(codes, bucket, group, radius)
        assert dict(zip(a.tolist(), simhash.different(codes[a], codes[b]).tolist(), strict=True)) == near and (group[a] != group[b]).all() and (bucket[a] == bucket[b]).all()


@pytest.mark.parametrize("held", [1 << 19, 50])
def test_forest_of_least_distances(monkeypatch, held):
    """Against Kruskal's algorithm: the same total distance; by steps, not over it by more than a step for each link."""
    monkeypatch.setattr(simhash, "HELD", held)
    for seed in range(3):
        codes = clustered(random.Random(seed + 20), 300, 60, 4)
        a, b = simhash.linked(codes, np.zeros(len(codes), int), 58, nearest=True)
        found = sorted(simhash.different(codes[a], codes[b]).tolist())
        parent, expected = list(range(len(codes))), []

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for d, i, j in sorted((int(simhash.different(codes[i], codes[j])), i, j) for i, j in all_links(codes, 58)):
            if find(i) != find(j):
                parent[find(i)] = find(j)
                expected.append(d)
        assert len(found) == len(expected) and (found == sorted(expected) if held > 50 else sum(found) <= sum(expected) + 58 // 8 * len(found) + 58)


def test_gray_order():
    codes = np.array([[x] for x in range(16)], np.uint64)
    order = [int(codes[i, 0]) for i in np.lexsort(simhash.gray_keys(codes))]
    assert all(bin(a ^ b).count("1") == 1 for a, b in zip(order, order[1:], strict=False))
    wide = np.array([[a, b] for a in (0, 1) for b in (0, 1, 1 << 63)], np.uint64)
    assert sorted(map(tuple, wide[np.lexsort(simhash.gray_keys(wide))].tolist())) == sorted(map(tuple, wide.tolist()))


def test_gray_rank_is_the_order(spark):
    codes = np.array([[random.Random(i).getrandbits(64)] for i in range(200)], np.uint64)
    rows = spark.createDataFrame([(int(c),) for c in codes[:, 0].view(np.int64)], "f0 long").orderBy(simhash.gray_rank(F.col("f0"))).collect()
    assert [r["f0"] for r in rows] == codes[np.lexsort(simhash.gray_keys(codes)), 0].view(np.int64).tolist()


def test_nodes_prune_on_the_test_tables():
    """The index is what answers, at the size of the smallest tables too: pairs of nodes are looked at and left out."""
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    codes = np.unique(np.array([simhash.simhash(t or "", 3, 1)[0] for t in pq.read_table(path, columns=["text"])["text"].to_pylist()], np.uint64), axis=0)
    links = set()
    for deal in simhash.exact_deals(3)[:1]:
        for (mask,) in deal.masks:
            counts = {}
            bucket = np.unique(codes[:, 0] & np.uint64(mask), return_inverse=True)[1]
            a, b = simhash.linked(codes, bucket, 3, None, counts)
            links |= set(zip(a.tolist(), b.tolist(), strict=True))
            assert counts["seen"] > 0 and counts["pruned"] > 0.5 * counts["seen"]
    assert roots(len(codes), links) == roots(len(codes), all_links(codes, 3))
    counts = {}
    simhash.linked(codes, np.zeros(len(codes), int), 3, None, counts)  # by differing bits alone
    assert counts["pruned"] > 0


def test_deals_are_sure():
    """Codes at no more than the radius share a whole block of every deal."""
    rng = random.Random(1)
    for deal in simhash.exact_deals(3):
        masks = [m for (m,) in deal.masks]
        assert len(masks) == 4 and sum(masks) == (1 << 64) - 1
        for _ in range(200):
            code = rng.getrandbits(64)
            other = code
            for bit in rng.sample(range(64), 3):
                other ^= 1 << bit
            assert any(code & m == other & m for m in masks)
    for bits in (8, 18, 24):
        assert 1 - (1 - 0.8485**bits) ** simhash.masks_for(bits) >= 0.999


def run_search(batches, again):
    return pa.Table.from_batches(list(simhash._search(["f0"], 3, again, None, False)(iter(batches))))


def test_large_buckets_are_dealt_anew():
    n = simhash.BUCKET + 5
    codes = [*range(n), 7, 6]
    columns = [[3] * (n + 2), [1] * n + [2, 2], range(n + 2), [0] * (n + 2), range(n + 2), codes]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bucket", "pattern", "id", "size", "group", "f0"])
    parts = [batch.slice(i, 1000) for i in range(0, n + 2, 1000)]
    for given in ([batch], parts):
        out = run_search(given, True)
        kinds = out.column("kind").to_pylist()
        assert kinds.count("again") == n and kinds.count("link") == 1
    # without dealing anew the bucket is searched itself, also over several batches
    assert run_search(parts, False).num_rows == n


def test_dealing_anew_loses_no_link(spark, monkeypatch):
    """With buckets of ten, dealt anew both before the shuffle and after it, three deals deep."""
    codes = clustered(random.Random(10), 500, 4)
    classes = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)[:, 0]], "f0 long").select(F.col("f0").alias("id"), F.lit(0).cast("long").alias("size"), F.col("f0").alias("group"), "f0")
    ids = {int(c): i for i, c in enumerate(codes.view(np.int64)[:, 0])}
    real = simhash._search

    def small(*args):
        run = real(*args)

        def patched(batches):
            before = simhash.BUCKET, simhash.CHUNK
            simhash.BUCKET, simhash.CHUNK = 10, 16
            try:
                yield from run(batches)
            finally:
                simhash.BUCKET, simhash.CHUNK = before  # the worker goes on

        return patched

    monkeypatch.setattr(simhash, "_search", small)
    for bucket, start in ((10, 0), (10, 1), (1 << 20, 0)):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        links = [(ids[r["a"]], ids[r["b"]]) for r in simhash.class_links(classes, ["f0"], simhash.exact_deals(3), 3, start=start).collect()]
        assert roots(len(codes), links) == roots(len(codes), all_links(codes, 3))


def test_class_links_and_components(spark):
    codes = clustered(random.Random(9), 700, 5)
    classes = spark.createDataFrame([(int(np.int64(c[0])),) for c in codes.view(np.int64)], "f0 long").select(F.col("f0").alias("id"), F.lit(0).cast("long").alias("size"), F.col("f0").alias("group"), "f0")
    links = simhash.class_links(classes, ["f0"], simhash.exact_deals(3), 3)
    found = {r["id"]: r["root"] for r in simhash.components(links).collect()}
    ids = codes.view(np.int64)[:, 0].tolist()
    group = roots(len(codes), all_links(codes, 3))
    smallest = {}
    for i, g in enumerate(group):
        smallest[g] = min(smallest.get(g, ids[i]), ids[i])
    assert [found.get(x, x) for x in ids] == [smallest[g] for g in group]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 180)] + [(500, 500), (7, 3)]
    found = {r["id"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 180)}}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, edges, edge_rows, nothing):
    rng = random.Random(2)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(3000))
    more = [(50 - i, base if not i else base.replace("w7 ", "w8 ", i)) for i in range(6)] + [(60, base), (61, base)]
    docs = edges.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r[0], r[1]) for r in edge_rows] + more
    prints = np.array([[brute(t)] for _, t in rows], np.uint64)
    group = roots(len(rows), all_links(prints, 3))
    smallest = {}
    for (key, _), g in zip(rows, group, strict=True):
        smallest[g] = min((k for k in (smallest.get(g), key) if k is not None), default=None)
    expected = sorted(((key, f"{int(p[0]):016x}", smallest[g]) for (key, _), p, g in zip(rows, prints, group, strict=True)), key=str)
    found = simhash.near_duplicates(docs)
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert simhash.near_duplicates(nothing).count() == 0


def test_keep_one(spark, edges, edge_rows, nothing):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9000)}" for _ in range(400)]
    near = list(base)
    for i in range(0, 400, 80):
        near[i] = "changed"  # shingles' similarity about 0.88
    far = [f"w{rng.randrange(9000)}" for _ in range(400)]
    more = [(70, " ".join(base)), (71, " ".join(near)), (72, " ".join(far)), (73, " ".join(base))]
    docs = edges.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(i, t, "k") for i, t in more], "doc_id long, text string, key string"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i and i >= 70) == [70, 72]
    # 1 and 2 have the same text, and so have those without words: 3, 4, 6 and a null id; "..." is a word
    assert sorted(i for i in ids if i and i < 70) == [1, 1, 3, 7, 8, 9, 10, 11] and ids.count(None) == 1
    assert simhash.keep_one(nothing).count() == 0


def test_keep_one_decides_at_the_similarity_itself(spark):
    rng = random.Random(8)
    fresh = (f"x{i}" for i in range(1 << 20))
    rows, expected = [], set()
    for pair in range(60):
        # of n shingles a replaced word takes 5: k of them leave (n - 5 k) / (n + 5 k), 0.8 for k = n / 45
        k, alike = rng.randint(4, 8), pair < 40
        n = 45 * k if alike else 45 * k - 2
        base = [next(fresh) for _ in range(n + 4)]
        near = list(base)
        for i in range(k):
            near[20 + i * (n // k - 1)] = next(fresh)
        a, b = ({tuple(w[i : i + 5]) for i in range(n)} for w in (base, near))
        assert (len(a & b) / len(a | b) >= 0.8) == alike and len(a & b) / len(a | b) > 0.79
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(near))]
        expected |= {2 * pair} if alike else {2 * pair, 2 * pair + 1}
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == expected


def test_a_large_family_is_one_group(spark):
    """Three hundred texts, each at 0.8 or more to the one it was made from only: chains, not a centre, hold them together; strangers that share half of each stay."""
    rng = random.Random(12)
    fresh = (f"y{i}" for i in range(1 << 20))
    texts = [[next(fresh) for _ in range(260)]]
    while len(texts) < 300:
        words_ = list(rng.choice(texts[-40:]))
        for i in rng.sample(range(5, 255), 4):
            words_[i] = next(fresh)
        texts.append(words_)
    strangers = [texts[0][:130] + [next(fresh) for _ in range(130)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts + strangers)]
    sets = [{tuple(w[i : i + 5]) for i in range(256)} for w in texts + strangers]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    expected = set(roots(len(sets), alike))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == expected


def test_keep_one_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, None, "z", 3)], "doc_id long, text string, vitrine_text string, vitrine_id long")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["vitrine_text"] for r in kept.collect()) == ["x", "z"]


def brute_groups(texts, least=0.8, n=5):
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in texts]
    return roots(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])])


def test_no_link_is_lost_for_far_fingerprints(spark):
    """Pairs at 0.8 whose fingerprints differ in more bits than the radius: no bucket joins them."""
    rng, rows = random.Random(31), []
    while len(rows) < 8:
        base = [f"z{rng.getrandbits(60)}" for _ in range(49)]
        near = [*base[:20], f"z{rng.getrandbits(60)}", *base[21:]]
        codes = [simhash.simhash(" ".join(w), 5, simhash.SIMILAR_PARTS, repeats=False)[0] for w in (base, near)]
        if simhash.different(*codes) > simhash.SIMILAR_RADIUS:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(near))]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 2, 4, 6}


def test_no_link_is_lost_whatever_the_fingerprints_say(spark, monkeypatch):
    """Families of texts with common lines, and fingerprints that join nothing but equal sets."""
    monkeypatch.setattr(simhash, "SIMILAR_RADIUS", 0)
    rng = random.Random(33)
    line = [f"line{i}" for i in range(12)]
    texts = []
    for family in range(6):
        texts.append([f"f{family}x{rng.randrange(300)}" for _ in range(rng.randint(6, 160))] + line * (family % 2))
        for _ in range(24):
            words_ = list(rng.choice(texts[-20:] if family % 3 else texts[-1:]))
            for _ in range(rng.randint(0, 1 + len(words_) // 25)):
                words_[rng.randrange(len(words_))] = f"n{rng.getrandbits(40)}"
            texts.append(words_)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = set(brute_groups(texts))
    assert kept == expected and 6 < len(expected) < 140


@pytest.mark.parametrize("look", [1 << 19, 7])
def test_sharing_pairs_are_all_of_other_groups(monkeypatch, look):
    monkeypatch.setattr(simhash, "LOOK", look)
    rng = np.random.default_rng(3)
    shingle, group = np.sort(rng.integers(0, 9, 200)), rng.integers(0, 5, 200) - 2
    size, place = rng.integers(5, 40, 200), rng.integers(0, 5, 200)
    found = sorted(tuple(sorted(p)) for a, b in simhash.sharing(shingle, group, size, place, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True))
    pairs = [(i, j) for j in range(200) for i in range(j) if shingle[i] == shingle[j] and group[i] != group[j]]
    assert found == sorted((i, j) for i, j in pairs if 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and 9 * min(size[i] - place[i], size[j] - place[j]) >= 4 * (size[i] + size[j]))


def test_first_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.choice(100, n, replace=False).astype(np.uint64)
        b = np.unique(np.append(a[int(rng.integers(0, n // 8 + 1)) :], rng.integers(0, 100, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)))
        a, often = np.unique(a), rng.permutation(100)[: int(rng.integers(0, 30))].astype(np.uint64)
        order = np.argsort(often)
        first = [set(simhash.first_shingles(x, often[order], order, 0.8).tolist()) for x in (a, b)]
        shared = len(np.intersect1d(a, b))
        assert shared < 0.8 * (len(a) + len(b) - shared) or first[0] & first[1]
    assert not len(simhash.first_shingles(np.zeros(0, np.uint64), often, order, 0.8))


def test_parities_rule_out_no_similar_sets():
    rng = np.random.default_rng(7)
    for n in (1, 9, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.append(a[n // 10 :], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)))
        bits = [np.unpackbits(simhash.parities(x)) for x in (a, b)]
        assert len(bits[0]) == simhash.PARITIES and (bits[0] != bits[1]).sum() <= len(np.setxor1d(a, b))
    assert not simhash.parities(np.zeros(0, np.uint64)).any()
