import math
import re

from hypothesis import given
from hypothesis import strategies as st

from vitrine.llm import license


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=8), min_size=1, max_size=5), st.lists(st.sampled_from("abcdefghij"), max_size=10), st.sampled_from([0.3, 0.5, 0.8, 1.0]), st.dictionaries(st.sampled_from([c.encode() for c in "abcdefgh"]), st.integers(0, 9)))
def test_filters_lose_nothing(templates, block, threshold, rarity):
    index = license.build([(str(i), " ".join(t)) for i, t in enumerate(templates)], rarity, threshold)
    own = {w.encode() for w in block}
    expected = {}
    for i, t in enumerate(templates):
        share = len(own & {w.encode() for w in t}) / len(set(t))
        if share >= threshold - 1e-9 and own:
            expected[i] = share
    assert license.met(index, own) == expected


def test_every_filter_rejects():
    rarity = {w.encode(): i for i, w in enumerate("abcdefghij")}
    index = license.build([("x", "a b c d e"), ("y", "f g h i j")], rarity, 0.8)  # four of five needed, prefixes a b and f g
    for block, expected in (("a b c", {"length": 2}), ("c d e f h i", {"prefix": 2, "length": 0}), ("a b c d", {"candidate": 1}), ("f i j c", {"prefix": 2})):
        counts = {}
        license.met(index, block.encode().split(), counts)
        assert {k: counts.get(k, 0) for k in expected} == expected, (block, counts)
    # five words, the first one shared is the third of the block: on the block's side too few are left
    index = license.build([("x", "a b c d e"), ("y", "b c d f g h i j")], rarity, 0.6)
    seen = {}
    for n in range(1 << 10):
        counts = {}
        block = [w.encode() for i, w in enumerate("abcdefghij") if n >> i & 1]
        found = license.met(index, block, counts)
        for k, v in counts.items():
            seen[k] = seen.get(k, 0) + v
        for t, (_, own, needed) in enumerate(index.templates):
            share = sum(w in block for w, r in index.rank.items() if r in own)
            assert (t in found) == (share >= needed)
    assert min(seen.get(k, 0) for k in ("length", "prefix", "position", "candidate")) > 0, seen


def test_scan(spark, edges, edge_rows, nothing):
    more = [
        (20, "Text. Licensed under the Apache License, Version 2.0. More text."),
        (21, "CC-BY! cc by-nc 4.0 cc  by\ncc\nby ccby cc byx"),
        (22, "All rights reserved. GENERAL public LICENSE general public licenses"),
        (23, "Released under the MIT license"),
        (24, "the license was released under what MIT\nthought"),
        (25, "ÄCC BY cc Bÿ cc by"),
        (26, "cc " * 5 + "by"),
    ]
    docs = edges.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(*x, "s") for x in more], "doc_id long, text string, score string"))
    found = license.scan(docs).collect()
    assert len(found) == len(edge_rows) + len(more)
    texts = sorted(((r[0], r[1]) for r in edge_rows + more), key=str)
    for r, (key, n) in zip(sorted(found, key=lambda r: (str(r["doc_id"]), r["n_words"])), sorted(((k, len(words(t))) for k, t in texts), key=lambda x: (str(x[0]), x[1])), strict=True):
        assert (r["doc_id"], r["n_words"]) == (key, n)
    by = {r["doc_id"]: r for r in found if r["doc_id"] and r["doc_id"] >= 20}
    for key, text in more:
        w, places = words(text), []
        for phrase, label in license.PHRASES:
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        r = by[key]
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and (r["score"] == 1.0 or not places)
    assert by[20]["labels"] == "apache-2.0" and by[20]["blocks"][0]["first_word"] == 1 and by[20]["score"] == 1.0
    assert by[22]["n_base"] == 2 and by[22]["labels"] == "gpl,reserved" and by[23]["labels"] == "mit" and by[24]["labels"] == "mit"
    empty = next(r for r in found if r["doc_id"] == 3)
    assert tuple(empty)[1:8] == (0, 0, None, None, "", "", 0.0)
    assert license.scan(nothing).count() == 0


def test_a_wrap_loses_no_notice(spark):
    texts, labels = [], []
    short, long = license.notices(license.TEMPLATES)
    for label, template in short:
        w = template.split()
        for cut in range(1, len(w)):
            texts.append(f"/* Some file\n *\n * {' '.join(w[:cut])}\n * {' '.join(w[cut:])}.\n */")
            labels.append(label)
        texts.append("x y\n" * 30 + "\n".join(w) + "\nx y" * 30)
        labels.append(label)
    for label, template in long:  # whole notices, wrapped, in paragraphs, and after much else
        w = template.split()
        for width in (1, 7, 12):
            lines = [" ".join(w[i : i + width]) for i in range(0, len(w), width)]
            texts += ["\n".join(lines), "# " + "\n# ".join(lines), "zz yy. " * 200 + "\n\n".join(lines).upper() + " zz yy!" * 300]
            labels += [label] * 3
    cut = "released under\n\nthe mit license\n", "Released under. The MIT license", "released under.\nthe mit license"
    docs = spark.createDataFrame(list(enumerate([*texts, *cut])), "doc_id long, text string")
    found = {r["doc_id"]: r for r in license.scan(docs).collect()}
    for i, label in enumerate(labels):
        assert label in found[i]["labels"].split(",") and found[i]["score"] == 1.0, texts[i]
    assert all(found[len(labels) + i]["labels"] == "" for i in range(len(cut)))


def test_a_notice_with_a_fifth_of_its_words_changed(spark):
    _, long = license.notices(license.TEMPLATES)
    docs = []
    for label, template in long:
        distinct = sorted(set(license.words_of(template)))
        for gone in (len(distinct) - math.ceil(0.8 * len(distinct)), len(distinct) - math.ceil(0.8 * len(distinct)) + 1):
            other = {w for w in distinct[:gone]}
            docs.append((label, b" ".join(b"changed" if w in other else w for w in license.words_of(template)).decode()))
    found = {r["doc_id"]: r for r in license.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string"), phrases=[("no such phrase", "x")], templates=long).collect()}
    for i, (label, _) in enumerate(docs):
        assert found[i]["labels"] == ("" if i % 2 else label) and (found[i]["score"] >= 0.8) == (i % 2 == 0)
