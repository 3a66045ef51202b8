"""Results recorded once per id, across restarts, in a store of buckets instead of streaming state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

BUCKETS = 16


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def recorded(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """Everything recorded, with ``batch_id`` and ``bucket``."""
    return spark.read.schema(StructType([*schema.fields]).add("batch_id", LongType()).add("bucket", IntegerType())).parquet(store)


def add_new(batch: DataFrame, batch_id: int, store: str, key: str, order: Sequence[str], buckets: int = BUCKETS) -> None:
    """Record the rows of a batch whose id no earlier batch has recorded, the first by ``order`` of each id.

    Of the store only the ids, and only in buckets that the batch touches, are
    read. A batch that is repeated after a failure sees what the batches
    before it left and replaces its own folder, so its result is the same.
    Rows without an id cannot be recognised and are all recorded.
    """
    spark = batch.sparkSession
    named = batch.where(F.col(key).isNotNull())
    first = named.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_row")).select("_row.*")
    placed = first.withColumn("bucket", bucket_of(F.col(key), buckets))
    touched = [row["bucket"] for row in named.select(bucket_of(F.col(key), buckets).alias("bucket")).distinct().collect()]
    seen = (
        recorded(spark, store, batch.schema)
        .where((F.col("batch_id") < batch_id) & F.col("bucket").isin(*touched, -1))
        .select("bucket", key)
    )
    new = placed.join(seen, ["bucket", key], "left_anti").select(*batch.columns, "bucket")
    unnamed = batch.where(F.col(key).isNull()).withColumn("bucket", F.lit(0))
    new.unionByName(unnamed).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch_id={batch_id}")


def record_new(
    results: DataFrame, store: str, checkpoint: str, key: str = "id", order: Sequence[str] = (), buckets: int = BUCKETS, **trigger
) -> StreamingQuery:
    """Record each id of a stream once below ``store`` (see :func:`add_new`); the stream itself keeps no state.

    A folder is written for each batch and bucket, so batches should be large:
    triggers of minutes rather than seconds. ``order`` is by default the key,
    then every other column, which must then be comparable. One stream may write to a store.
    """
    columns = list(order) or [key, *[c for c in results.columns if c != key]]
    spark = results.sparkSession
    # so that the first batch finds a store to read
    nothing = spark.createDataFrame([], results.schema).withColumns({"batch_id": F.lit(-1), "bucket": F.lit(0)})
    nothing.write.mode("append").partitionBy("batch_id", "bucket").parquet(store)

    def add(batch: DataFrame, batch_id: int) -> None:
        add_new(batch, batch_id, store, key, columns, buckets)

    return (
        results.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 minutes"}))
        .start()
    )
