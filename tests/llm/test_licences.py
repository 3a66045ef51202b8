"""Licence scans against brute force."""

import math
import re

import pytest

from gridtwin.llm import licences
from gridtwin.llm.licences import BASE, SHARE, TEMPLATES

SCHEMA = "doc_id bigint, text string, labels string, score int, n_words string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def starts(words, phrase):
    own = phrase.split()
    return [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]


def brute(rows):
    listed = [words_of(t) for _, t in rows]
    sets = [set(w) for w in listed]
    texts = [words_of(t.text) for t in TEMPLATES]

    def idf(w):
        return math.log((2 + len(rows)) / (1 + sum(w in s for s in sets)))

    weights = {w: idf(w) for t in texts for w in t}
    out = []
    for (doc, _), own in zip(rows, listed):
        found = [(label, i) for label, p in BASE for i in starts(own, p)]
        base = {label for label, _ in found}
        labels, score = set(base), 1.0 if base else 0.0
        for t, text in zip(TEMPLATES, texts):
            rare = sorted(set(text), key=lambda w: (-weights[w], w))[: licences.RARE_WORDS]
            total = sum(weights[w] for w in text if w in rare)
            entries = sorted((i - j, weights[w]) for i, w in enumerate(own) if w in rare for j, v in enumerate(text) if v == w)
            slack = len(text) // 8
            for d, _ in entries:
                share = sum(x for e, x in entries if d <= e <= d + slack) / total
                if share < SHARE - 1e-9:
                    continue
                low, high = max(d, 0), min(d + len(text) + slack, len(own))
                if all(any(i >= low and i + len(k.split()) <= high for i in starts(own, k)) for k in t.keys):
                    labels.add(t.label)
                    score = max(score, min(1.0, share))
        places = [i for _, i in found]
        row = (doc, len(own), len(places), min(places, default=None), max(places, default=None))
        out.append((*row, ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = [(*r[:7], round(r.score, 9)) for r in licences.scan(docs).collect()]
    want = brute(rows)
    assert sorted(got, key=str) == want
    return {r[0]: r for r in want}


def planted():
    whole = {10 + k: f"before it {t.text} and after" for k, t in enumerate(TEMPLATES)}
    mit = TEMPLATES[1].text
    rows = [
        (1, None),
        (2, ""),
        (3, "All Rights\nReserved. all rights, reserved! All rights were reserved"),
        (4, "CC-BY 4.0 or cc_by or ccby or ÇC by or cc by"),
        (5, "All rights"),
        (6, "reserved and general public"),
        (7, mit.replace("obtaining a copy", "who is obtaining one copy")),
        (8, mit.replace("free of charge", "for a fee")),
        (9, "cc " * 3000 + "by all rights reserved " * 700 + "x" * 9000),
        (None, "the GNU General Public License"),
        (5, "all rights reserved"),
        (5, "all rights reserved"),
    ]
    return rows + list(whole.items())


def test_planted_notices(spark):
    rows = planted()
    found = check(spark, rows)
    for k, t in enumerate(TEMPLATES):
        assert t.label in found[10 + k][6].split(",")
    assert found[7][6] == "mit" and found[8][6] == ""
    assert found[4][2] == 2 and found[3][2] == 2


def test_whole_table(spark, small_docs, odd):
    check(spark, [(r.doc_id, r.text) for r in small_docs.union(odd.select(small_docs.columns)).collect()])


def test_no_documents(spark, nothing):
    assert licences.scan(nothing).count() == 0


@pytest.mark.parametrize("word", ["licensed", "licensee", "é", "0"])
def test_only_equal_words_are_numbered(word):
    import numpy as np

    vocabulary = licences.Vocabulary(BASE, TEMPLATES)
    numbers, _ = licences.file_words(vocabulary, np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))
    assert (numbers[0] >= 0) == (word in vocabulary.words)
