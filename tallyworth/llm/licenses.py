"""Find licence notices in texts by a positional index of their rarest words.

A template is a notice as a list of words. It stands at a place of a text if enough of its words stand there at their
own distance from the place and all its mandatory key phrases lie within its length. Words are weighed by how many
documents hold them. The index lists, of every template, as many of its rarest words as may all be missing, and two
more: at any place where the template stands, at least two of them agree on the place. So a text's rare licence
words propose all places, and the words around each place, and the key phrases, decide. The words of most texts meet no
list at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
# The share of a notice's words that must stand at their place; bytes of a text whose words are listed at a time.
SHARE = 0.7
STRETCH = 1 << 20


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    least: int
    phrases: tuple[tuple[str, ...], ...]
    base: bool


def words_of(text: str) -> list[str]:
    """The words of a short text, A-Z in lower case."""
    return [w.decode() for w in _WORD.findall(text.encode().lower())]


def template(label: str, notice: str, *phrases: str, share: float = SHARE, base: bool = False) -> Template:
    words = tuple(words_of(notice))
    return Template(label, words, max(min(2, len(words)), math.ceil(share * len(words))), tuple(tuple(words_of(p)) for p in phrases), base)


# The base phrases, each of which must stand whole.
BASE = (
    template("gpl", "gnu general public license", share=1, base=True),
    template("apache", "apache license", share=1, base=True),
    template("cc-by", "cc by", share=1, base=True),
    template("mit", "mit license", share=1, base=True),
)
# Notices as their licences word them, with their mandatory phrases.
NOTICES = (
    template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "apache org licenses",
    ),
    template(
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "without warranties or conditions of any kind",
    ),
    template("mit", "Released under the MIT License", "mit license"),
    template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        "permission is hereby granted free of charge",
    ),
    template("gpl-3.0", "licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
        "gnu general public license",
        "free software foundation",
    ),
    template(
        "lgpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation",
        "gnu lesser general public license",
    ),
    template(
        "agpl",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation",
        "gnu affero general public license",
    ),
    template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "for any purpose with or without fee",
    ),
    template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
        "mozilla public license",
    ),
    template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0"),
    template(
        "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "creative commons attribution sharealike",
    ),
    template("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    template("unlicense", "This is free and unencumbered software released into the public domain", "released into the public domain"),
)
TEMPLATES = BASE + NOTICES


def stretches(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a list for each stretch of it; stretches end between words."""
    data = text.encode().lower()
    at = 0
    while at < len(data):
        end = at + STRETCH
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield _WORD.findall(data, at, end)
        at = end


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each word of the templates stands; one number a word comes to the driver."""
    vocabulary = {w.encode() for t in templates for w in t.words}

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                own: set[bytes] = set()
                for words in stretches(text.as_py() or ""):
                    own |= vocabulary.intersection(words)
                found.update(own)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], type=pa.string()), pa.array(list(found.values()), type=pa.int64())], ["word", "docs"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "word string, docs long")
    return {r["word"]: r["docs"] for r in counts.groupBy("word").agg(F.sum("docs").alias("docs")).collect()}


class Index:
    """Postings (template, position) of the rarest words of every template, and how many must agree on a place."""

    def __init__(self, frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.agree = []
        for k, t in enumerate(templates):
            missing = len(t.words) - t.least
            rarest = sorted(range(len(t.words)), key=lambda p: (frequencies.get(t.words[p], 0), p))[: missing + 2]
            self.agree.append(max(1, len(rarest) - missing))
            for p in rarest:
                self.postings[t.words[p].encode()].append((k, p))
        self.rare = frozenset(self.postings)
        self.vocabulary = frozenset(w.encode() for t in templates for w in t.words)
        self.words = [[w.encode() for w in t.words] for t in templates]
        self.phrases = [[[w.encode() for w in p] for p in t.phrases] for t in templates]

    def matches(self, text: str) -> tuple[int, list[tuple[int, int, int]]]:
        """The number of words, and (template, place, agreeing words) of every place where a template stands.

        Only the places of licence words are held. A place may lie before the text's start if a notice is cut there.
        """
        size, near, placed = 0, {}, Counter()
        for words in stretches(text):
            held = self.vocabulary.intersection(words)
            if held:
                for i, w in enumerate(words, size):
                    if w in held:
                        near[i] = w
                        for k, p in self.postings.get(w, ()):
                            placed[k, i - p] += 1
            size += len(words)
        found = []
        for (k, place), agree in placed.items():
            if agree < self.agree[k]:
                continue
            own = self.words[k]
            hits = sum(near.get(place + p) == w for p, w in enumerate(own))
            if hits >= self.templates[k].least and all(_within(near, x, place, place + len(own)) for x in self.phrases[k]):
                found.append((k, place, hits))
        return size, found


def _within(near: dict[int, bytes], phrase: list[bytes], low: int, high: int) -> bool:
    """Whether the words of a phrase stand one after the other between two places."""
    return any(all(near.get(s + i) == w for i, w in enumerate(phrase)) for s in range(low, high - len(phrase) + 1))


def licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Words count from 0. Base places are those where a base template stands; n_base counts all of them, first_word and
    last_word are the smallest and largest (null without any). Labels are distinct, sorted and joined by commas, '' for
    none; score is the largest share of a template's words at a place where it stands, 0 without any. Null text counts as
    empty and gives no words. Rows that share a doc_id or have none are judged each; no rows give no rows; other columns are
    left out. Document frequencies come from all rows, and only order the index: they never change the result.
    """
    index = Index(document_frequencies(docs, templates), templates)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(index, text.as_py() or "") for text in batch.column(1)]
            columns = list(zip(*rows)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, _TYPES))], ["doc_id", *_NAMES])

    numbers = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(judged, f"doc_id {kind}, {numbers}")


_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
_TYPES = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]


def _row(index: Index, text: str) -> tuple:
    size, found = index.matches(text)
    of = index.templates
    base = [(k, place) for k, place, _ in found if of[k].base]
    places = [place for _, place in base]
    base_labels = ",".join(sorted({of[k].label for k, _ in base}))
    labels = ",".join(sorted({of[k].label for k, _, _ in found}))
    score = max((hits / len(of[k].words) for k, _, hits in found), default=0.0)
    return size, len(base), min(places, default=None), max(places, default=None), base_labels, labels, score
