"""Running summaries, resume and response pairing with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridtwin.operators.scoring import rates, summary_counts


def result_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Results appended as JSON lines below ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def running_summary(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Summary of everything that has arrived; state holds one row of counts per group."""
    return rates(results.groupBy(*by).agg(*summary_counts()), by)


def keep_latest(summary: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the current summary below ``path`` after every batch, for :func:`latest`.

    Each batch has a folder of its own, so no reader loses files under it; a
    batch that is repeated after a failure replaces only its own folder.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        summary.writeStream.outputMode("complete")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest summary written by :func:`keep_latest`."""
    summaries = spark.read.parquet(path)
    newest = summaries.agg(F.max("batch_id").alias("batch_id"))
    return summaries.join(F.broadcast(newest), "batch_id", "left_semi").drop("batch_id")  # one row


def first_of_each(results: DataFrame, key: str = "id", ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Drop results whose id was already seen, across restarts with the same checkpoint.

    Without ``ts`` the state keeps every id. With ``ts`` ids are forgotten
    after ``delay``, for sources whose repeats come close together.
    """
    if ts is None:
        return results.dropDuplicates([key])
    return results.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append finished rows to ``path`` as JSON lines, exactly once."""
    return (
        stream.writeStream.outputMode("append")
        .format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def live_responses(
    shown: DataFrame, responses: DataFrame, longest_wait: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """First response to each shown stimulus: ``user_id, trial_id, shown_at, response_id, response, answered_at``.

    ``shown`` has ``user_id, trial_id, shown_at``; ``responses`` has
    ``user_id, trial_id, response_id, response, answered_at``. A response
    later than ``longest_wait`` is none, and rows that arrive more than
    ``delay`` behind are dropped: that bounds the state.
    """
    left = shown.withWatermark("shown_at", delay).alias("s")
    right = responses.withWatermark("answered_at", delay).alias("r")
    joined = left.join(
        right,
        F.expr(
            f"""s.user_id = r.user_id AND s.trial_id = r.trial_id
            AND r.answered_at >= s.shown_at AND r.answered_at <= s.shown_at + INTERVAL {longest_wait}"""
        ),
    ).select("s.user_id", "s.trial_id", "s.shown_at", "r.response_id", "r.response", "r.answered_at")
    first = F.min(F.struct("answered_at", "response_id", "response"))
    return (
        joined.groupBy("user_id", "trial_id", "shown_at")
        .agg(first.alias("first"))
        .select("user_id", "trial_id", "shown_at", "first.response_id", "first.response", "first.answered_at")
    )
