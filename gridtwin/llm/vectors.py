"""Embedding columns as rows of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """Vectors that can be compared: not null or empty, every component finite, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(column.isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def as_bytes(vectors: DataFrame) -> DataFrame:
    """``vec_id, raw``: the usable vectors as little-endian doubles; -0 becomes 0, so equal vectors have equal bytes."""

    def run(batches):
        for rows in batches:
            lists = rows.column(1)
            flat = np.asarray(lists.flatten().cast(pa.float64())) + 0.0
            ends = np.cumsum(np.asarray(lists.value_lengths())) * 8
            data, begins = flat.astype("<f8").tobytes(), np.concatenate([[0], ends[:-1]])
            raw = [data[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.record_batch([rows.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    good = vectors.where(usable(F.col("embedding"))).select("vec_id", "embedding")
    return good.mapInArrow(run, "vec_id bigint, raw binary")


def matrix(raw) -> np.ndarray:
    """[rows, dimensions] doubles from byte strings."""
    raw = list(raw)
    if not raw:
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def common_width(raws: DataFrame) -> int:
    """Dimensions of most vectors (the smaller on a tie); vectors of other lengths cannot be compared with them."""
    widths = raws.groupBy((F.octet_length("raw") / 8).cast("int").alias("w")).agg(F.count("*").alias("n"))
    top = widths.orderBy(F.desc("n"), "w").first()
    return top["w"] if top else 0


def length(x: np.ndarray) -> np.ndarray:
    """Euclidean length of each row; scaled by the largest component, so that squares neither over- nor underflow."""
    most = np.maximum(np.abs(x).max(axis=1), 5e-324)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 5e-324)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
