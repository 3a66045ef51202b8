"""Byte-pair encoding and decoding by forced-boundary splitting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridtwin.llm.arrays import text_blocks
from gridtwin.llm.fragments import encoder


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the tokenizer's ids of every text, an empty list for null or empty ones."""

    def run(batches):
        coder = encoder(path)
        for data, offsets, _, rows in text_blocks(batches):
            ids, before = coder.encode(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([rows.column(0), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text``: the texts that lists of ids stand for; broken characters become U+FFFD."""

    def run(batches):
        coder = encoder(path)
        for rows in batches:
            lists = rows.column(1).to_numpy(zero_copy_only=False)
            texts = [coder.decode(np.asarray(ids, np.int64)).decode("utf-8", "replace") for ids in lists]
            yield pa.record_batch([rows.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text and return digests of both results.

    ``doc_id, n_tokens, ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256, exact`` (whether decoding gives the text back). Null
    texts count as empty; repeated rows are answered one by one; further
    columns are ignored. Each text is encoded and decoded in the same task, so
    ids never leave it.
    """

    def run(batches):
        coder = encoder(path)
        decimal = [str(i) for i in range(coder.size)]
        for data, offsets, _, rows in text_blocks(batches):
            ids, before = coder.encode(data, offsets)
            listed, raw = ids.tolist(), data.tobytes()
            back = coder.decode(ids)
            sizes = np.concatenate([[0], np.cumsum(coder.spans[ids])])[before]
            counts, digests, decoded, exact = [], [], [], []
            for i in range(len(offsets) - 1):
                own = listed[before[i] : before[i + 1]]
                text = back[sizes[i] : sizes[i + 1]].decode("utf-8", "replace").encode()
                counts.append(len(own))
                digests.append(hashlib.sha256(",".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(text).hexdigest())
                exact.append(text == raw[offsets[i] : offsets[i + 1]])
            yield pa.record_batch(
                [rows.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded), pa.array(exact)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean"
    )
