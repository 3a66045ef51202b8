"""Shuffled shards by a Feistel permutation of row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtwin.llm.frames import numbered

ROUND_KEYS = (1_204_567, 998_244_353, 402_653_189, 1_610_612_741, 715_827_883, 1_073_676_287)
PRIME = 2_147_483_647
FACTOR = 48_271
MOST_STEPS = 64
SEED = 20_240_229
FILE_ROWS = 10_000
OWN = ("size", "text_crc32", "row_number", "place", "shard", "slot", "_read")


def domain(rows: int) -> tuple[int, int]:
    """Two sides a, b with a * b >= rows and fewer than a numbers to spare."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def round_value(half, key):
    """A number below PRIME from one half; works on columns and on Python integers."""
    first = (half % PRIME * FACTOR + key) % PRIME
    return (first * first + key) % PRIME


def once(x: int, rows: int, seed: int) -> int:
    """One pass of the permutation of 0 .. a*b - 1: halves are added to each other in turn."""
    a, b = domain(rows)
    left, right = divmod(x, b)
    for i, key in enumerate(ROUND_KEYS):
        if i % 2 == 0:
            left = (left + round_value(right, key + seed)) % a
        else:
            right = (right + round_value(left, key + seed)) % b
    return left * b + right


def once_column(x: Column, rows: int, seed: int) -> Column:
    """The same pass as a column expression; two rounds for each pair of keys."""
    a, b = domain(rows)
    pairs = F.array(*[F.struct(F.lit(k + seed).cast("bigint").alias("l"), F.lit(m + seed).cast("bigint").alias("r")) for k, m in zip(ROUND_KEYS[::2], ROUND_KEYS[1::2])])

    def rounds(state: Column, keys: Column) -> Column:
        left = (state["left"] + round_value(state["right"], keys["l"])) % a
        right = (state["right"] + round_value(left, keys["r"])) % b
        return F.struct(left.alias("left"), right.alias("right"))

    start = F.struct(((x - x % b) / b).cast("bigint").alias("left"), (x % b).cast("bigint").alias("right"))
    return F.aggregate(pairs, start, rounds, lambda state: state["left"] * b + state["right"])


def back_once(y: int, rows: int, seed: int) -> int:
    a, b = domain(rows)
    left, right = divmod(y, b)
    for i, key in reversed(list(enumerate(ROUND_KEYS))):
        if i % 2 == 0:
            left = (left - round_value(right, key + seed)) % a
        else:
            right = (right - round_value(left, key + seed)) % b
    return left * b + right


def place_of(row: int, rows: int, seed: int = SEED) -> int:
    """Where row number ``row`` of ``rows`` lands; computable without the table."""
    x = once(row, rows, seed)
    while x >= rows:
        x = once(x, rows, seed)
    return x


def row_of(place: int, rows: int, seed: int = SEED) -> int:
    """The row number that lands at ``place``."""
    x = back_once(place, rows, seed)
    while x >= rows:
        x = back_once(x, rows, seed)
    return x


def permuted(row: Column, rows: int, seed: int = SEED) -> Column:
    """The shuffled place of a row number as a column expression.

    Numbers past the end walk on along their cycle. Fewer than a = sqrt(rows)
    numbers are spare, so a walk of ``MOST_STEPS`` steps ends for certain up to
    MOST_STEPS**2 rows, and beyond that fails with probability below
    rows**-32; it would raise an error, never a wrong place.
    """
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_STEPS)),
        once_column(row, rows, seed),
        lambda x, _: F.when(x < rows, x).otherwise(once_column(x, rows, seed)),
    )
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size`` (16 for a null text) and ``text_crc32`` (of the empty text for a null one)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {"size": (F.octet_length(text) + 16).cast("bigint"), "text_crc32": F.crc32(text.cast("binary"))}
    )


def placed(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """``rows`` with ``row_number, place, shard, slot``."""
    # rows that are alike in all of these are told apart by where they are read, so that no range is one key
    rows = numbered(rows.withColumn("_read", F.monotonically_increasing_id()), ["doc_id", "text_crc32", "size", "_read"], "row_number")
    total = rows.count()
    place = permuted(F.col("row_number"), max(total, 1), seed)
    return rows.drop("_read").withColumn("place", place).withColumns(
        {"shard": (F.col("place") % shards).cast("int"), "slot": F.floor(F.col("place") / shards).cast("bigint")}
    )


def shard(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, row_number, place, shard, slot``: law ``rows``.

    Rows get their global number in order of doc_id (nulls first; equal ids by
    text digest), the permutation turns it into a place, and place p lies in shard
    p mod ``shards`` at slot p div ``shards``: counts differ by one at most and
    slots have no gaps. Null texts have size 16 and the digest of the empty
    text. Equal texts are rows of their own and are spread like any others. An empty table gives no rows.
    """
    return placed(sized(docs.select("doc_id", "text")).drop("text"), shards, seed)


def write_shards(docs: DataFrame, shards: int, path: str, seed: int = SEED) -> DataFrame:
    """Write whole rows to the shards that :func:`shard` gives them, and return them as read from the files.

    One folder per shard, in files of at most ``FILE_ROWS`` rows sorted by slot. A shard is dealt to tasks in stretches of
    as many slots, so a large shard is written by many tasks. Every input row is written once, null and repeated ids included. Input
    columns named like one of ``OWN`` come back as ``input_<name>``.
    """
    taken = {name: f"input_{name}" for name in docs.columns if name.lower() in OWN}
    rows = placed(sized(docs.withColumnsRenamed(taken)), shards, seed).drop("size", "text_crc32", "row_number", "place")
    file = F.floor(F.col("slot") / FILE_ROWS)
    (
        rows.repartition("shard", file)
        .sortWithinPartitions("shard", "slot")
        .write.option("maxRecordsPerFile", FILE_ROWS)
        .option("compression", "zstd")
        .partitionBy("shard")
        .parquet(path)
    )
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
