"""The pipeline's stages on a small table."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gridtwin.llm import quality
from gridtwin.session import cut
from test_duplicates import brute_groups, brute_sets
from test_tokens import WORDS, library


def test_stages_keep_the_columns_and_pack_what_is_left(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "packing"]
    kept = corpus_pipeline.distinct_documents(spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    full = {}
    for r in rows:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert max(full.values()) <= 2048


def counted(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages_decide_by_row(spark, small_docs, tmp_path):
    """All four stages against brute force, with null and repeated ids."""
    base = [r for r in small_docs.orderBy("doc_id").limit(80).collect() if r.text]
    texts = [r.text for r in base]
    odd = [(None, texts[0]), (None, texts[1] + " once more"), (None, "a text of its own that nobody else has said before today")]
    odd += [(None, None), (None, "12 34"), (90_001, texts[2]), (90_001, texts[2]), (90_001, "77 + 88 = 165")]
    odd += [(90_002, t) for t in texts[3:30]]  # one id, many texts
    odd += [(90_003, "one more text that stands alone in this small table of texts")] * 3
    odd += [(90_004, texts[5]), (90_004, "and another text of the same name which is no copy of anything here")]
    rows = [tuple(r) for r in base] + [(i, t, "en", "s", len(t or "")) for i, t in odd]
    folder = str(tmp_path)
    spark.createDataFrame(rows, small_docs.schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("doc_id < 90000")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))

    def good(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return quality.vote(model, data, np.array([0, len(data)]))[0] >= quality.ACCEPT

    (_, first), (_, second), (_, third), (_, last) = corpus_pipeline.STAGES
    voted = cut(first(spark, docs, folder), "voted")
    want = [r for r in docs.collect() if good(r.text)]
    assert counted(voted.collect()) == counted(want) and any(r.doc_id is None for r in want)

    spoken = cut(second(spark, voted, folder), "spoken")
    want = [r for r in want if r.text and any(c.isalpha() for c in r.text)]
    assert counted(spoken.collect()) == counted(want)

    single = cut(third(spark, spoken, folder), "single")
    want.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0))
    groups = brute_groups(brute_sets({k: r.text for k, r in enumerate(want)}, 5))
    want = [r for k, r in enumerate(want) if groups[k] == k]
    assert counted(single.collect()) == counted(want) and max(counted(want).values()) == 1

    packed = last(spark, single, folder).collect()
    sizes = [(r.doc_id, len(ids) + 1) for r, ids in zip(want, library(WORDS, [r.text for r in want]))]
    pieces = Counter((i, a, min(2048, n - a)) for i, n in sizes for a in range(0, n, 2048))
    assert Counter((r.doc_id, r.start, r.length) for r in packed) == pieces
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
