"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np

from gridtwin.llm import variants

SCHEMA = "doc_id bigint, text string, word string, n int, key string"


def brute_words(rows):
    """word -> occurrences, by the rule as stated, of rows (doc_id, text)."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def deletions(word):
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and a in deletions(b)


def brute(rows):
    words = brute_words(rows)
    keys = {}  # two near words share a word or a deletion
    for w in words:
        for d in {w, *deletions(w)}:
            keys.setdefault(d, []).append(w)
    found, form = {}, {}
    for w, n in words.items():
        others = {o for d in {w, *deletions(w)} for o in keys[d] if o != w and near(w, o)}
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        found[w] = len(others)
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, found[w], words.get(form[w])))
    return sorted(out)


def check(spark, rows, limit=None):
    docs = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], SCHEMA)
    got = variants.spelling_variants(docs)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def planted():
    base = ["gardens", "garden", "Écoutent", "gärden", "garder", "Überall", "überal", "streets", "strets", "stréets", "y" * 40, "y" * 41, "z" * 300]
    often = [700, 120, 25, 20, 5, 30, 6, 30, 6, 5, 30, 5, 5]
    rows = [(i, " ".join(w for w, n in zip(base, often) if i < n)) for i in range(700)]
    return [*rows, (None, "Garden1GARDEN_garden"), (None, None), (3, ""), (4, "ab, a×b÷c"), (4, "streets " * 50), (4, "streets " * 50)]


def test_planted_variants(spark):
    rows = planted()
    assert any(r[1] and r[2] != r[1] for r in brute(rows))  # a chain of two forms
    assert any("×" in w for w in brute_words([(1, "aaa×bbb " * 5)]))
    check(spark, rows)


def test_whole_table(spark, small_docs, odd):
    check(spark, [(r.doc_id, r.text) for r in small_docs.union(odd.select(small_docs.columns)).select("doc_id", "text").collect()])


def test_no_words(spark, nothing):
    assert variants.spelling_variants(nothing).count() == 0


def test_shards_cut_small(spark, small_docs):
    """Tries of at most 40 words, so that groups are dealt to several tries, give the same."""
    words = spark.createDataFrame([(w, n) for w, n in brute_words([(r.doc_id, r.text) for r in small_docs.collect()]).items()], "word string, n bigint")
    one = sorted(map(tuple, variants.near_words(words).collect()))
    assert one and one == sorted(map(tuple, variants.near_words(words, 40).collect()))


def test_damage_is_the_crc_of_id_and_word():
    texts = ["alphabet", "é" * 70, "x" * 200, "b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    length = np.array([len(t.encode()) for t in texts])
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(4)], np.uint32)
    got = variants.run_crcs(data, np.cumsum(length) - length, length, before)
    assert got.tolist() == [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(texts)]
