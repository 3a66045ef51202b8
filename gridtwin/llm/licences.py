"""Licence notices found by a positional index of rare words.

Every notice known here is a template: its words, and phrases that must stand
in a file for its label. The index holds, for the words of a template that
the fewest documents contain, where they stand in it. A file's
hits on these words give offsets between file and template; where the hits of one
offset (within a tolerance for words added or left out) carry enough of the
template's weight, the template's key phrases are looked for in that part of the
file. Base phrases and key phrases are found by the hits on their rarest word, whose
neighbours at the phrase's relative positions must be its other words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtwin.llm.arrays import LOWER, run_hashes, same_runs, text_blocks, words

SOLID = np.zeros(256, bool)
SOLID[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

RARE_WORDS = 8
SHARE = 0.6


@dataclass(frozen=True)
class Template:
    """A notice, its label, and phrases without which it does not count."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Phrases of fixed meaning: label, phrase.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Public licence notices, word for word.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("hereby granted free of charge", "merge publish distribute sublicense"),
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    Template(
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        ("agreed to in writing", "warranties or conditions of any kind"),
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("gnu general public license", "free software foundation"),
    ),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License", ("affero general public license",)),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ("unencumbered software released into the public domain",),
    ),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
)


def word_list(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Vocabulary:
    """The words of all notices; numbers the words of a text, -1 for all others."""

    def __init__(self, base, templates):
        texts = [p for _, p in base] + [x for t in templates for x in (t.text, *t.keys)]
        self.words = sorted({w for text in texts for w in word_list(text)})
        self.number = {w: i for i, w in enumerate(self.words)}
        raw = [w.encode() for w in self.words]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array([len(w) for w in raw])
        self.begin = np.cumsum(self.length) - self.length
        hashes = run_hashes(self.flat, self.begin, self.length)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two words of the notices have one hash")

    def numbers(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.full(len(begin), -1, np.int32)
        some = np.flatnonzero(length <= self.length.max())
        hashes = run_hashes(data, begin[some], length[some])
        found = self.order[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)]
        equal = length[some] == self.length[found]
        some, found = some[equal], found[equal]
        same = same_runs(data, begin[some], self.flat, self.begin[found], length[some])
        out[some[same]] = found[same]
        return out

    def list(self, text: str) -> np.ndarray:
        return np.array([self.number[w] for w in word_list(text)])


def file_words(vocabulary: Vocabulary, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary number of every word of a block, and the first word of each document."""
    data = LOWER[raw]
    begin, length, first = words(data, offsets, SOLID[data])
    return vocabulary.numbers(data, begin, length), first


def document_frequencies(docs: DataFrame, base=BASE, templates=TEMPLATES) -> tuple[np.ndarray, int]:
    """In how many documents each word of the notices occurs, and how many documents there are."""
    vocabulary = Vocabulary(base, templates)
    size = len(vocabulary.words)

    def run(batches):
        seen, n = np.zeros(size + 1, np.int64), 0
        for data, offsets, _, rows in text_blocks(batches):
            numbers, first = file_words(vocabulary, data, offsets)
            doc = np.repeat(np.arange(len(rows)), np.diff(first))[numbers >= 0]
            pairs = np.unique(doc * size + numbers[numbers >= 0])
            seen[:size] += np.bincount(pairs % size, minlength=size)
            n += len(rows)
        seen[size] = n
        yield pa.record_batch([pa.array(np.arange(size + 1)), pa.array(seen)], names=["word", "n"])

    totals = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = np.zeros(size + 1, np.int64)
    for r in totals.collect():  # one row a word of the notices
        found[r["word"]] = r["n"]
    return found[:size], int(found[size])


class Index:
    """Postings of the rare words of every template, and the phrases with their rarest word."""

    def __init__(self, vocabulary: Vocabulary, frequencies: np.ndarray, documents: int, base, templates):
        self.idf = np.log((2.0 + documents) / (1.0 + frequencies))
        self.templates = templates
        self.phrases = [vocabulary.list(p) for _, p in base]
        self.base_labels = [label for label, _ in base]
        self.keys: list[list[int]] = []
        postings = []
        self.length, self.total = [], []
        for t, template in enumerate(templates):
            listed = vocabulary.list(template.text)
            distinct = sorted(set(listed.tolist()), key=lambda w: (-self.idf[w], w))
            rare = set(distinct[:RARE_WORDS])
            places = [(int(w), t, place) for place, w in enumerate(listed) if w in rare]
            postings += places
            self.length.append(len(listed))
            self.total.append(sum(self.idf[w] for w, _, _ in places))
            self.keys.append(list(range(len(self.phrases), len(self.phrases) + len(template.keys))))
            self.phrases += [vocabulary.list(key) for key in template.keys]
        postings.sort()
        self.posting = np.array(postings, np.int64).reshape(-1, 3)
        self.first = np.searchsorted(self.posting[:, 0], np.arange(len(vocabulary.words) + 1))
        self.anchor = [int(np.argmax(self.idf[p])) for p in self.phrases]
        self.length, self.total = np.array(self.length), np.array(self.total)
        self.slack = self.length // 8

    def places(self, numbers: np.ndarray, doc: np.ndarray, phrase: int, hits: dict) -> np.ndarray:
        """The word numbers at which a phrase begins, ascending, from the hits on its rarest word."""
        own, anchor = self.phrases[phrase], self.anchor[phrase]
        at = hits.get(int(own[anchor]))
        if at is None:
            return np.zeros(0, np.int64)
        at = at - anchor
        at = at[(at >= 0) & (at + len(own) <= len(numbers))]
        at = at[doc[at] == doc[at + len(own) - 1]]
        for k, w in enumerate(own.tolist()):
            at = at[numbers[at + k] == w]
        return at

    def scan(self, numbers: np.ndarray, first: np.ndarray):
        """Per document: places of base phrases, first and last of them, base labels, all labels, score."""
        docs = len(first) - 1
        doc = np.repeat(np.arange(docs), np.diff(first))
        at = np.flatnonzero(numbers >= 0)
        order = np.argsort(numbers[at], kind="stable")
        at = at[order]
        own, begins = np.unique(numbers[at], return_index=True)
        hits = {w: at[a:b] for w, a, b in zip(own.tolist(), begins.tolist(), [*begins[1:].tolist(), len(at)])}
        places = [self.places(numbers, doc, p, hits) for p in range(len(self.phrases))]
        n_base = np.zeros(docs, np.int64)
        low, high = np.full(docs, len(numbers)), np.full(docs, -1)
        base: list[set] = [set() for _ in range(docs)]
        every: list[set] = [set() for _ in range(docs)]
        score = np.zeros(docs)
        for label, found in zip(self.base_labels, places):
            n_base += np.bincount(doc[found], minlength=docs)
            np.minimum.at(low, doc[found], found)
            np.maximum.at(high, doc[found], found)
            for d in np.unique(doc[found]).tolist():
                base[d].add(label)
                every[d].add(label)
                score[d] = 1.0
        # offsets between the file's hits on rare words and the templates' postings of them
        begins, counts = self.first[numbers[at]], np.diff(self.first)[numbers[at]]
        pick = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        word = np.repeat(at, counts)
        template, offset = self.posting[pick, 1], word - self.posting[pick, 2]
        # a template counts only where each of its key phrases occurs in the file
        possible = np.ones((docs, len(self.templates)), bool)
        for t, keys in enumerate(self.keys):
            for key in keys:
                possible[:, t] &= np.bincount(doc[places[key]], minlength=docs) > 0
        kept = possible[doc[word], template]
        word, template, offset, pick = word[kept], template[kept], offset[kept], pick[kept]
        span = len(numbers) + 2 * int(self.length.max())
        group = (doc[word] * len(self.templates) + template) * (2 * span) + offset + span // 2
        order = np.argsort(group, kind="stable")
        group, template, offset = group[order], template[order], offset[order]
        owner = doc[word[order]]
        weight = np.concatenate([[0.0], np.cumsum(self.idf[self.posting[pick[order], 0]])])
        ends = np.searchsorted(group, group + self.slack[template], "right")
        share = (weight[ends] - weight[:-1]) / self.total[template]
        for e in np.flatnonzero(share >= SHARE).tolist():
            t, d = int(template[e]), int(owner[e])
            begin = max(int(offset[e]), int(first[d]))
            end = min(int(offset[e]) + int(self.length[t] + self.slack[t]), int(first[d + 1]))
            for key in self.keys[t]:
                k = np.searchsorted(places[key], begin)
                if k == len(places[key]) or places[key][k] + len(self.phrases[key]) > end:
                    break
            else:
                every[d].add(self.templates[t].label)
                score[d] = max(score[d], min(1.0, float(share[e])))
        return n_base, low, high, base, every, score


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every whole text.

    Words are runs of digits, a-z and characters beyond ASCII after A-Z are
    lower-cased. ``n_base`` counts the places where a base phrase's words stand
    consecutively, ``first_word`` and ``last_word`` are the smallest and largest of
    their starts (null without any). ``base_labels`` are the labels of these
    phrases, ``labels`` those and the labels of the notices found, both distinct,
    sorted and joined by commas (empty without any). ``score`` is the largest share of a
    notice's rare-word weight found in place; a base phrase stands whole and gives 1.

    Null texts count as empty: no words, no labels, score 0. Rows that repeat a
    doc_id, and null ids, are answered one by one; very long texts are read
    whole; further columns are ignored; an empty table gives no rows. The weights come from all documents.
    """
    frequencies, documents = document_frequencies(docs, base, templates)
    vocabulary = Vocabulary(base, templates)
    index = Index(vocabulary, frequencies, documents, base, templates)

    def run(batches):
        for data, offsets, _, rows in text_blocks(batches):
            numbers, first = file_words(vocabulary, data, offsets)
            n_base, low, high, found, every, score = index.scan(numbers, first)
            none = n_base == 0
            yield pa.record_batch(
                [
                    rows.column(0),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(n_base),
                    pa.array(low - first[:-1], pa.int64(), mask=none),
                    pa.array(high - first[:-1], pa.int64(), mask=none),
                    pa.array([",".join(sorted(x)) for x in found], pa.string()),
                    pa.array([",".join(sorted(x)) for x in every], pa.string()),
                    pa.array(score),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    )
