"""Shown stimuli and the answers to them in a log of events.

Events are ``user_id, event_id, ts, kind`` with kind ``show``, ``respond`` or
``side``. A trial is a shown stimulus; the first response before the next one
answers it, later ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtwin.operators.ranking import running_total

STRETCH_SECONDS = 6 * 3600


def _stretch(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000))


def paired_responses(events: DataFrame, stretch_seconds: int = STRETCH_SECONDS) -> DataFrame:
    """One row per trial: ``user_id, trial_id, shown_at, response_id, response, rt, side_events``.

    Shows and responses are numbered along each user's log, stretch by
    stretch, so a very active user is spread over many tasks; each number
    with the side events after it is one group, and a trial meets its
    response by joining number n with n+1. ``rt`` is in milliseconds. Users,
    times and event ids must not be null.
    """
    marker = F.col("kind").isin("show", "respond").cast("int")
    numbered = running_total(
        events, ["user_id"], _stretch(F.col("ts"), stretch_seconds), ["ts", "event_id"], marker, "number"
    )
    steps = (
        numbered.where(F.col("number") > 0)
        .groupBy("user_id", "number")
        .agg(
            F.min(F.when(F.col("kind") != "side", F.struct("ts", "event_id", "kind", "event_type"))).alias("m"),
            F.count_if(F.col("kind") == "side").alias("side_events"),
        )
    )
    shown = steps.where(F.col("m.kind") == "show").select(
        "user_id", "number", F.col("m.event_id").alias("trial_id"), F.col("m.ts").alias("shown_at"), "side_events"
    )
    answers = steps.where(F.col("m.kind") == "respond").select(
        "user_id",
        (F.col("number") - 1).alias("number"),
        F.col("m.event_id").alias("response_id"),
        F.col("m.event_type").alias("response"),
        F.col("m.ts").alias("_at"),
    )
    micros = F.unix_micros("_at") - F.unix_micros("shown_at")
    return shown.join(answers, ["user_id", "number"], "left").select(
        "user_id",
        "trial_id",
        "shown_at",
        "response_id",
        "response",
        F.floor((micros + 500) / 1000).cast("bigint").alias("rt"),
        "side_events",
    )


def masked(rt: Column, limit_ms: int) -> Column:
    """Whether the stimulus was already hidden at the response; 0 means it never hides."""
    if not limit_ms:
        return F.lit(0)
    return F.when(F.coalesce(rt, F.lit(0)) > limit_ms, 1).otherwise(0)


def with_progress(trials: DataFrame, stretch_seconds: int = STRETCH_SECONDS) -> DataFrame:
    """Add ``position`` of each trial among the ``trials`` of its user."""
    return running_total(
        trials,
        ["user_id"],
        _stretch(F.col("shown_at"), stretch_seconds),
        ["shown_at", "trial_id"],
        F.lit(1),
        "position",
        "trials",
    )


def block_status(trials: DataFrame) -> DataFrame:
    """Per user: trials, answered ones, and whether the block was completed or broken off."""
    return trials.groupBy("user_id").agg(
        F.count("*").alias("trials"),
        F.count("response_id").alias("answered"),
        F.when(F.max_by(F.col("response_id").isNotNull(), F.struct("shown_at", "trial_id")), "completed")
        .otherwise("aborted")
        .alias("status"),
    )
