"""The language model against counts by hand, numerical gradients and sums of probabilities."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest_words import word_list
from gridtwin.llm import bilinear
from gridtwin.llm.frames import held_out


def marked(docs):
    return docs.select("doc_id", "text", "lang", held_out("doc_id", 7, 2).alias("held_out"))


def compare_base(docs, rows):
    texts = [(r.doc_id, [*word_list(r.text), None]) for r in docs.collect()]
    counts = Counter()
    for doc, tokens in texts:
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            counts.update(tokens)
    n, v = sum(counts.values()), len(counts)
    want = {
        doc: (len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        for doc, t in texts
    }
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert abs(r.base_score - want[r.doc_id][3]) < 1e-6 * max(1, abs(r.base_score))
        assert r.score < 0


def test_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = bilinear.score(marked(docs)).collect()
    compare_base(docs, rows)
    held = [r for r in rows if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.3


def test_odd_rows(spark, odd, nothing):
    compare_base(odd, bilinear.score(marked(odd)).collect())
    assert bilinear.score(marked(nothing)).count() == 0
    twice = bilinear.score(marked(odd.unionAll(odd))).collect()
    assert len(twice) == 2 * odd.count()
    unknown = bilinear.score(odd.select("doc_id", "text", F.lit(True).alias("held_out"))).collect()
    assert all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) for r in unknown)
    null = bilinear.score(spark.createDataFrame([(None, "a b", False)], "doc_id bigint, text string, held_out boolean")).collect()
    assert null[0].doc_id is None and null[0].n_tokens == 3


def small_model():
    tokens, distinct = np.zeros(bilinear.BANDS, np.int64), np.zeros(bilinear.BANDS, np.int64)
    tokens[:3], distinct[:3] = [4, 6, 5], [4, 3, 1]
    vocab = {"count": np.array([30, 20, 9]), "tokens": tokens, "distinct": distinct}
    p = {k: v.astype(np.float64) for k, v in bilinear.start_params(vocab).items()}
    draw = np.random.default_rng(4)
    return {k: v + draw.normal(0, 0.3, v.shape) for k, v in p.items()}


def test_gradients():
    p = small_model()
    n = len(p["bias"])
    draw = np.random.default_rng(5)
    one, two, word = (draw.integers(0, m, 50) for m in (n + 1, n + 1, n))
    noise, log_noise = draw.integers(0, n, 7), draw.normal(0, 1, n)
    _, grads = bilinear.slopes(p, one, two, word, noise, log_noise)
    for key, value in p.items():
        for place in list(np.ndindex(value.shape))[:: max(1, value.size // 25)]:
            moved = []
            for step in (1e-5, -1e-5):
                changed = {k: v.copy() for k, v in p.items()}
                changed[key][place] += step
                moved.append(bilinear.slopes(changed, one, two, word, noise, log_noise)[0])
            assert abs((moved[0] - moved[1]) / 2e-5 - grads[key][place]) < 1e-4


def test_probabilities_of_classes_sum_to_one():
    p = small_model()
    n = len(p["bias"])
    for before in ([], [0], [2, 1], [5, 3, 0]):
        total = 0.0
        for last in range(n):
            labels = np.array([*before, last])
            total += math.exp(bilinear.token_log_probabilities(p, labels, np.array([len(labels)]))[-1])
        assert abs(total - 1) < 1e-9


def test_chunks_keep_numbers():
    for kind in (np.uint16, np.uint32, np.int64):
        values = np.random.default_rng(1).integers(0, 60_000, 1000).astype(kind)
        assert (bilinear.unsqueeze(bilinear.squeeze(values), kind) == values).all()
    assert len(bilinear.unsqueeze(bilinear.squeeze(np.zeros(0, np.uint32)), np.uint32)) == 0
