"""From replies to scored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtwin.functions.answers import is_correct, outcome
from gridtwin.operators import scoring


def judge_replies(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Result rows: items with the reply of the same ``id`` (``reply, stop_reason, error`` and token counts)."""
    joined = items.join(replies, "id")
    judged = joined.withColumn("answer", outcome(F.col("reply"), F.col("stop_reason"), F.col("error")))
    return judged.withColumn("correct", is_correct(F.col("answer"), F.col("solvable")))


def report(results: DataFrame) -> DataFrame:
    """All slices of the results in one table."""
    return scoring.slice_report(results)
