"""Small Spark helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtwin.session import cut


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows in ascending order of ``keys`` (nulls first) with their global number from 0.

    Rows are dealt by range, so no task holds more than its range; the only
    thing counted up in one place is one number per partition.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(dealt.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    piece = F.shiftright("_place", 33)
    sizes = placed.groupBy(piece.alias("_piece")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_piece", piece)
        .join(F.broadcast(starts), "_piece")  # one row per partition
        .withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_piece", "_place", "_start")
    )


def hash_sample(df: DataFrame, key: str, stratum: str, rows: int) -> DataFrame:
    """About ``rows`` rows of every value of ``stratum`` at most, chosen by a hash of ``key`` alone."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    share = F.lit(float(rows)) / F.col("_n")
    placed = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.join(F.broadcast(sizes), stratum).where(placed < share).drop("_n")
