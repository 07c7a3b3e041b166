"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Templates are single sentences and whole notices of several. A text's blocks are windows of words: for the sentences, of each
sentence of the text (what ., ! or ? with white space after it, or an empty line, ends; a mere line break doesn't, as notices are wrapped);
for the notices, of the whole text. A window has twice as many words as the longest template of its kind, and is half over the
next, so that any run of as many words as that template has is in one. A block meets a template if it contains at least
`threshold` of the template's distinct words.

The join filters exactly. Words of templates are ordered by the number of documents of the corpus that they are in, the rarest
first; of a block only such words matter, b of them, in that order. A block that meets a template of s words, t of them needed, has
b >= t (length filter); the first word that they share is among the first s - t + 1 of the template's and the first b - t + 1 of the
block's (prefix filter on both sides); and from any shared word on, what is shared so far and the lesser of the words left on
both sides make t (positional filter). What passes is verified by counting. Templates are a parameter, a bounded
list; their prefixes are an inverted index that goes to every worker, so that no block is shuffled.

Defined cases: a null text is empty, without words, labels and places; its score is 0. Ids may be null or repeat;
every row is scanned by itself, a very long text window by window. Tables may be empty and may have further columns; only the id and the text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import extended, ship, texts_of

#: Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Common notices and their labels, of one sentence and of several.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular "
        "purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, "
        "arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without "
        "warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of "
        "merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
]
THRESHOLD = 0.8
#: Templates of more words are notices, which a sentence's end doesn't cut.
SENTENCE_WORDS = 25
#: What ends a sentence.
SENTENCE_END = "[.!?][ \t\r\n]|\n[ \t\r]*\n"

#: Bytes that are no part of a word become a space, A-Z lower case.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_END = re.compile(SENTENCE_END.encode())


def words_of(text: str) -> list[bytes]:
    return text.encode(errors="surrogatepass").translate(_WORDS).split()


def notices(templates: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """The templates of one sentence, and those of several."""
    long = [len(words_of(text)) > SENTENCE_WORDS for _, text in templates]
    return [t for t, x in zip(templates, long, strict=True) if not x], [t for t, x in zip(templates, long, strict=True) if x]


@dataclass(frozen=True)
class Index:
    """rank: words by rarity; templates: label, words' ranks, words needed; prefixes: rank to (template, position); least: the fewest words that any needs; longest: words of the longest."""

    rank: dict[bytes, int]
    templates: list[tuple[str, tuple[int, ...], int]]
    prefixes: dict[int, list[tuple[int, int]]]
    least: int
    longest: int


def build(templates: list[tuple[str, str]], rarity: dict[bytes, int], threshold: float) -> Index:
    vocabulary = {w for _, text in templates for w in words_of(text)}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (rarity.get(w, 0), w)))}
    found: list[tuple[str, tuple[int, ...], int]] = []
    prefixes: dict[int, list[tuple[int, int]]] = {}
    for label, text in templates:
        words = tuple(sorted({rank[w] for w in words_of(text)}))
        needed = max(1, math.ceil(threshold * len(words) - 1e-9))
        for i, word in enumerate(words[: len(words) - needed + 1]):
            prefixes.setdefault(word, []).append((len(found), i))
        found.append((label, words, needed))
    return Index(rank, found, prefixes, min((n for _, _, n in found), default=1), max((len(words_of(text)) for _, text in templates), default=1))


def met(index: Index, words: Iterable[bytes], counts: dict[str, int] | None = None) -> dict[int, float]:
    """Templates that a block of these words meets, and how much of each it contains. counts: how many (block, template) each filter rejected."""
    block = sorted({index.rank[w] for w in words if w in index.rank})
    shared: dict[int, int] = {}  # so far, by template; below 0 once rejected
    for j, word in enumerate(block[: max(0, len(block) - index.least + 1)]):
        for t, i in index.prefixes.get(word, ()):
            _, own, needed = index.templates[t]
            so_far = shared.get(t, 0)
            if so_far < 0:
                continue
            if len(block) < needed:
                shared[t] = -1
            elif so_far == 0 and j > len(block) - needed:
                shared[t] = -2
            elif so_far + 1 + min(len(own) - i - 1, len(block) - j - 1) < needed:
                shared[t] = -3
            else:
                shared[t] = so_far + 1
    if counts is not None:
        for x, (_, _, needed) in enumerate(index.templates):
            name = "length" if len(block) < needed else {0: "prefix", -2: "prefix", -3: "position"}.get(shared.get(x, 0), "candidate")
            counts[name] = counts.get(name, 0) + 1
    inside, out = set(block), {}
    for t, so_far in shared.items():
        if so_far > 0:
            _, own, needed = index.templates[t]
            n = len(inside.intersection(own))
            if n >= needed:
                out[t] = n / len(own)
    return out


def windows(words: list[bytes], length: int) -> Iterator[tuple[int, list[bytes]]]:
    """Windows of 2 x length words, each `length` after the last, with their places. Any `length` words that follow each other are in one."""
    for at in range(0, max(1, len(words) - length), length):
        yield at, words[at : at + 2 * length]


def places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """Where each phrase's words stand one after another."""
    found = []
    for phrase, label in phrases:
        at = -1
        for _ in range(words.count(phrase[0])):
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                found.append((at, label))
    return found


def document_frequency(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the given words is: all documents are read, each task sends one row a word."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(words, 0)
        for batch in parts:
            for text in texts_of(batch["text"]):
                for word in words.intersection(text.encode(errors="surrogatepass").translate(_WORDS).split()):
                    counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return {bytes(r["word"]): r["n"] for r in docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and blocks: the windows that meet a template, by the place of their first word, with label and containment.

    score: 1 with a phrase's place, else the largest containment of a template, 0 below the threshold."""
    ship(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    split = [(phrase.encode().split(), label) for phrase, label in (PHRASES if phrases is None else phrases)]
    rarity = document_frequency(docs, {w for _, text in templates for w in words_of(text)})
    sentences, whole = (build(kind, rarity, threshold) for kind in notices(templates))
    schema = extended(docs.select("doc_id").schema, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<first_word:long,label:string,containment:double>>")

    def rare(index: Index, distinct: set[bytes]) -> bool:
        return any(w in distinct for w, i in index.rank.items() if i in index.prefixes)

    def one(text: str) -> tuple:
        data = text.encode(errors="surrogatepass")
        words = data.translate(_WORDS).split()
        distinct = set(words)
        base = places(words, split) if any(distinct.issuperset(p) for p, _ in split) else []
        blocks = []

        def look(index: Index, part: list[bytes], first: int) -> None:
            for at, window in windows(part, index.longest):
                blocks.extend({"first_word": first + at, "label": index.templates[t][0], "containment": share} for t, share in sorted(met(index, window).items()))

        if rare(sentences, distinct):
            first = 0
            for sentence in _END.split(data):
                part = sentence.translate(_WORDS).split()
                look(sentences, part, first)
                first += len(part)
        if rare(whole, distinct):
            look(whole, words, 0)
        at = [i for i, _ in base]
        labels = {label for _, label in base}
        every = labels | {b["label"] for b in blocks}
        score = 1.0 if base else max((b["containment"] for b in blocks), default=0.0)
        return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, blocks

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])))
        for batch in parts:
            rows = [one(text) for text in texts_of(batch["text"])]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)
