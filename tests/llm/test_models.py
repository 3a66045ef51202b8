"""Trained models: held-out accuracy, gradients, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from gridtwin.llm import language, quality
from gridtwin.llm.frames import held_out

SF = "/root/testdata/sf0.01"


def test_language_gradients():
    draw = np.random.default_rng(1)
    params = {k: v.astype(np.float64) for k, v in language.start(3, hidden=3).items()}
    codes = draw.integers(97, 100, (5, 4)).astype(np.uint8)
    mask, label = (draw.random((5, 4)) < 0.8).astype(float), np.array([0, 1, 2, 1])
    _, grads = language.gradients(params, codes, mask, label)
    for key in params:
        for place in list(zip(*np.nonzero(np.abs(grads[key]) > 1e-4)))[:6]:
            step = 1e-3
            moved = []
            for sign in (1, -1):
                changed = {k: v.copy() for k, v in params.items()}
                changed[key][place] += sign * step
                moved.append(language.gradients(changed, codes, mask, label)[0])
            assert abs((moved[0] - moved[1]) / (2 * step) - grads[key][place]) < 2e-3


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    params, languages = language.fit(docs.where(~held_out("doc_id", 4, 2)))
    found = language.predict(docs, params, languages).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where(held_out("doc_id", 4, 2)).collect()
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1000))
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd, nothing):
    params, languages = language.fit(odd, 50)
    assert languages == ["en"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, params, languages).collect()}
    assert len(got) == odd.count()
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2)) and got[9][0] == "en" and got[11] == ("en", 1.0)
    params, languages = language.fit(nothing)
    assert {r.lang_pred for r in language.predict(odd, params, languages).collect()} == {"und"}
    assert language.predict(nothing, params, languages).count() == 0


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").alias("label"))
    rows = quality.score(docs, quality.fit(docs, known)).join(labels, "doc_id").where(held_out("doc_id", 5, 0)).collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_votes_equal_a_plain_search(spark, small_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(small_docs, labels)
    got = {r.doc_id: r.score for r in quality.score(small_docs, model).collect()}
    for r in small_docs.collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        at = quality.unit(quality.fold(quality.term_counts(data, np.array([0, len(data)])), model["idf"]).astype(np.float32) @ model["axes"])[0]
        cosine = model["voters"] @ at
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0).astype(float) ** quality.POWER * model["stands"][near]
        assert abs(got[r.doc_id] - (weight * model["label"][near]).sum() / weight.sum()) < 1e-3


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (8, 0), (8, 1), (12, 0), (None, 1), (3, None), (99, 1)], "doc_id bigint, label int")
    model = quality.fit(odd, labels)
    got = quality.score(odd.unionAll(odd), model).collect()
    assert len(got) == 2 * odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id < 2} == {model["prior"]}
    empty = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}
    assert quality.score(nothing, quality.fit(nothing, labels)).count() == 0
