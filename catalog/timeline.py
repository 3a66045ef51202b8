"""Trials in the event log, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog import inputs, sqltext as sql
from catalog.registry import query
from catalog.scoring import rounded
from gridtwin.operators import scoring, timeline
from gridtwin.session import scratch_path
from gridtwin.streaming import running, store

LIMIT_MS = 60_000


def log_of(spark, sf_dir):
    kind = (
        F.when(F.col("event_type") == "view", "show")
        .when(F.col("event_type").isin("click", "purchase"), "respond")
        .when(F.col("event_type") == "error", "side")
    )
    events = inputs.table(spark, sf_dir, "events").withColumn("kind", kind).where(F.col("kind").isNotNull())
    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "kind")


LOG = """SELECT user_id, event_id, ts, event_type, event_type = 'view' AS is_show, event_type = 'error' AS is_side,
  count(*) FILTER (event_type <> 'error') OVER w AS number FROM events
  WHERE event_type IN ('view', 'click', 'purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
TRIALS = f"""WITH log AS MATERIALIZED ({LOG})
SELECT s.user_id, s.event_id AS trial_id, s.ts AS shown_at, r.event_id AS response_id, r.event_type AS response,
  ((epoch_us(r.ts) - epoch_us(s.ts) + 500) // 1000)::BIGINT AS rt,
  (SELECT count(*) FROM log e WHERE e.user_id = s.user_id AND e.number = s.number AND e.is_side) AS side_events
FROM log s LEFT JOIN log r ON r.user_id = s.user_id AND r.number = s.number + 1 AND NOT r.is_show AND NOT r.is_side
WHERE s.is_show"""


@query(
    "paired_responses",
    f"SELECT user_id, trial_id, epoch_us(shown_at) AS shown_us, response_id, response, rt, side_events FROM ({TRIALS})",
)
def paired_responses(spark, sf_dir):
    trials = timeline.paired_responses(log_of(spark, sf_dir))
    return trials.withColumn("shown_us", F.unix_micros("shown_at")).drop("shown_at")


@query(
    "masked_responses",
    f"""SELECT trial_id, rt, CASE WHEN rt > {LIMIT_MS} THEN 1 ELSE 0 END AS masked FROM ({TRIALS}) WHERE rt IS NOT NULL""",
)
def masked_responses(spark, sf_dir):
    trials = timeline.paired_responses(log_of(spark, sf_dir)).where(F.col("rt").isNotNull())
    return trials.select("trial_id", "rt", timeline.masked(F.col("rt"), LIMIT_MS).alias("masked"))


@query(
    "trial_progress",
    f"""SELECT user_id, trial_id, row_number() OVER (PARTITION BY user_id ORDER BY shown_at, trial_id) AS position,
    count(*) OVER (PARTITION BY user_id) AS trials FROM ({TRIALS})""",
)
def trial_progress(spark, sf_dir):
    trials = timeline.paired_responses(log_of(spark, sf_dir)).select("user_id", "trial_id", "shown_at")
    return timeline.with_progress(trials).drop("shown_at")


@query(
    "block_status",
    f"""SELECT user_id, count(*) AS trials, count(response_id) AS answered,
    CASE WHEN arg_max(response_id IS NOT NULL, (shown_at, trial_id)) THEN 'completed' ELSE 'aborted' END AS status
    FROM ({TRIALS}) GROUP BY user_id""",
)
def block_status(spark, sf_dir):
    return timeline.block_status(timeline.paired_responses(log_of(spark, sf_dir)))


# --- streams -----------------------------------------------------------------------------

#: The log covers a month; a response may come at its end. State is kept for so long.
LONGEST_WAIT_DAYS = 31
def written_results(spark, sf_dir, repeat=False):
    """Trial results as JSON lines in the shared folder; with ``repeat`` every result arrives twice."""
    path = scratch_path(spark, "results")
    results = inputs.trial_results(spark, sf_dir)
    rows = results.select(
        F.col("event_id").alias("id"), "edit_type", "solvable", "answer", "input_tokens", "output_tokens"
    )
    rows.repartition(4, "id").write.json(path)
    if repeat:
        rows.repartition(3, "id").write.mode("append").json(path)
    return path, rows.schema


@query(
    "running_summary_stream",
    sql.summary(f"SELECT * FROM ({inputs.TRIAL_RESULTS}) WHERE edit_type IS NOT NULL", "edit_type"),
)
def running_summary_stream(spark, sf_dir):
    """All results read as a stream in several batches; the last summary is returned."""
    path, schema = written_results(spark, sf_dir)
    results = running.result_stream(spark, path, schema, 2).where(F.col("edit_type").isNotNull())
    out = scratch_path(spark, "summary")
    stream = running.keep_latest(
        running.running_summary(results, ("edit_type",)), out, scratch_path(spark, "offsets"), availableNow=True
    )
    stream.awaitTermination()
    return rounded(running.latest(spark, out))


@query("running_overall_stream", sql.summary(inputs.TRIAL_RESULTS))
def running_overall_stream(spark, sf_dir):
    """The running summary over all results, those without an edit type included."""
    path, schema = written_results(spark, sf_dir)
    out = scratch_path(spark, "summary")
    summary = running.running_summary(running.result_stream(spark, path, schema, 2))
    running.keep_latest(summary, out, scratch_path(spark, "offsets"), availableNow=True).awaitTermination()
    return rounded(running.latest(spark, out))


@query(
    "summary_after_each_result",
    f"SELECT * EXCLUDE (ts) FROM ({sql.summary_after_each(inputs.TRIAL_RESULTS, 'ts, event_id')})",
)
def summary_after_each_result(spark, sf_dir):
    """One summary a result; the last one is what ``running_overall_stream`` ends with."""
    results = inputs.trial_results(spark, sf_dir)
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    return rounded(scoring.summary_after_each(results, hour, ["ts", "event_id"])).drop("ts")


@query(
    "summary_after_each_result_by_user",
    f"SELECT * EXCLUDE (ts) FROM ({sql.summary_after_each(inputs.TRIAL_RESULTS, 'ts, event_id', 'user_id')})",
)
def summary_after_each_result_by_user(spark, sf_dir):
    results = inputs.trial_results(spark, sf_dir)
    day = F.floor(F.unix_timestamp("ts") / 86400)
    return rounded(scoring.summary_after_each(results, day, ["ts", "event_id"], ["user_id"])).drop("ts")


@query("resumed_stream", f"SELECT event_id AS id, answer FROM ({inputs.TRIAL_RESULTS})")
def resumed_stream(spark, sf_dir):
    """Every result arrives twice, with a restart in between; each id is kept once."""
    path, schema = written_results(spark, sf_dir)
    out, checkpoint = scratch_path(spark, "recorded"), scratch_path(spark, "offsets")
    kept = running.first_of_each(running.result_stream(spark, path, schema, 2))
    running.append_to(kept, out, checkpoint, availableNow=True).awaitTermination()
    spark.read.schema(schema).json(path).write.mode("append").json(path)
    again = running.first_of_each(running.result_stream(spark, path, schema, 2))
    running.append_to(again, out, checkpoint, availableNow=True).awaitTermination()
    return spark.read.schema(schema).json(out).select("id", "answer")


@query("resumed_from_store", f"SELECT event_id AS id, answer FROM ({inputs.TRIAL_RESULTS})")
def resumed_from_store(spark, sf_dir):
    """As ``resumed_stream``, but the ids are looked up in the store and the stream keeps no state."""
    path, schema = written_results(spark, sf_dir)
    store_path, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "offsets")
    for _ in range(2):
        arriving = running.result_stream(spark, path, schema, 2)
        store.record_new(arriving, store_path, checkpoint, order=("id", "answer"), availableNow=True).awaitTermination()
        spark.read.schema(schema).json(path).write.mode("append").json(path)
    return store.recorded(spark, store_path, schema).select("id", "answer")


@query(
    "live_responses_stream",
    f"""SELECT user_id, trial_id, response_id, response FROM ({TRIALS}) WHERE response_id IS NOT NULL""",
)
def live_responses_stream(spark, sf_dir):
    """Shows and responses as two streams; a late row on both closes the last windows.

    The wait covers every gap of the log, so all answered trials come out, as in the batch form.
    """
    from gridtwin.operators.ranking import running_total

    log = log_of(spark, sf_dir).where(F.col("kind") != "side")
    shows = running_total(
        log.withColumn("show_id", F.when(F.col("kind") == "show", F.col("event_id"))),
        ["user_id"], timeline._stretch(F.col("ts"), timeline.STRETCH_SECONDS), ["ts", "event_id"],
        (F.col("kind") == "show").cast("int"), "trial_no",
    )
    named = shows.where("kind = 'show'").select("user_id", "trial_no", F.col("event_id").alias("trial_id"))
    trials = shows.join(named, ["user_id", "trial_no"])
    shown = trials.where("kind = 'show'").select("user_id", "trial_id", F.col("ts").alias("shown_at"))
    answers = trials.where("kind = 'respond'").select(
        "user_id", "trial_id", F.col("event_id").alias("response_id"), F.col("event_type").alias("response"),
        F.col("ts").alias("answered_at"),
    )
    streams = []
    for rows, ts in ((shown, "shown_at"), (answers, "answered_at")):
        path = scratch_path(spark, "log")
        rows.write.parquet(path)
        closing = rows.agg(F.max(ts).alias(ts)).select(
            *[
                (F.col(ts) + F.expr(f"INTERVAL {3 * LONGEST_WAIT_DAYS} DAYS")).alias(ts) if c == ts else F.lit(None if t == "string" else -1).cast(t).alias(c)
                for c, t in rows.dtypes
            ]
        )
        closing.write.mode("append").parquet(path)
        streams.append(spark.readStream.schema(StructType(rows.schema.fields)).parquet(path))
    out = scratch_path(spark, "responses")
    paired = running.live_responses(streams[0], streams[1], f"{LONGEST_WAIT_DAYS} days")
    running.append_to(paired, out, scratch_path(spark, "offsets"), availableNow=True).awaitTermination()
    return spark.read.schema("user_id long, trial_id long, response_id long, response string").json(out).where(
        F.col("user_id") >= 0
    )
