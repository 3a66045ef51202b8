"""Summaries of trial results."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs, sqltext as sql
from catalog.registry import query
from gridtwin.functions.signal import probit
from gridtwin.operators import scoring

ROUNDED = ("accuracy", "hit_rate", "fa_rate", "dprime")


def rounded(df, columns=ROUNDED):
    for column in columns:
        df = df.withColumn(column, F.round(column, 6))
    return df


RESULTS = inputs.TRIAL_RESULTS
DAILY = f"SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM ({RESULTS})"


@query(
    "summary_by_day",
    f"{sql.summary(DAILY, 'day')} UNION ALL {sql.summary(RESULTS, keep=chr(39) + 'all' + chr(39) + ' AS day')}",
)
def summary_by_day(spark, sf_dir):
    """Flagship: signal-detection summary per day and overall, one pass over the results."""
    results = inputs.trial_results(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    counted = results.rollup("day").agg(*scoring.summary_counts()).withColumn("day", F.coalesce("day", F.lit("all")))
    return rounded(scoring.rates(counted, ["day"]))


@query("summary_overall", sql.summary(RESULTS))
def summary_overall(spark, sf_dir):
    return rounded(scoring.summarize(inputs.trial_results(spark, sf_dir)))


LABELLED = """SELECT quality = 1 AS solvable, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS answer,
  0 AS input_tokens, 0 AS output_tokens, source FROM labels JOIN documents USING (doc_id)"""


@query("summary_of_labels_by_source", sql.summary(LABELLED, "source"))
def summary_of_labels_by_source(spark, sf_dir):
    """Quality labels as truth, toxicity labels as the answer."""
    rows = (
        inputs.table(spark, sf_dir, "labels")
        .join(inputs.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
        .select(
            "source",
            (F.col("quality") == 1).alias("solvable"),
            F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("answer"),
        )
    )
    return rounded(scoring.summarize(rows, ["source"]))


@query(
    "inverse_normal",
    f"SELECT event_id, round({sql.probit('u')}, 6) AS z FROM (SELECT event_id, {sql.draw('event_id', '3')} AS u FROM events)",
)
def inverse_normal(spark, sf_dir):
    from gridtwin.functions.rng import draw

    events = inputs.table(spark, sf_dir, "events").select("event_id", draw(F.col("event_id"), 3).alias("u"))
    return events.select("event_id", F.round(probit(F.col("u")), 6).alias("z"))


BANDED = f"""SELECT *, CASE WHEN pocket_frac >= 0 AND pocket_frac < 0.15 THEN 'pocket < 15%'
  WHEN pocket_frac >= 0.15 AND pocket_frac < 0.3 THEN 'pocket 15-30%'
  WHEN pocket_frac >= 0.3 AND pocket_frac < 0.51 THEN 'pocket >= 30%' END AS band FROM ({RESULTS})"""


@query("summary_by_pocket_band", sql.summary(f"SELECT * FROM ({BANDED}) WHERE band IS NOT NULL", "band"))
def summary_by_pocket_band(spark, sf_dir):
    return rounded(scoring.by_pocket(inputs.trial_results(spark, sf_dir)))


@query(
    "summary_by_edit_type",
    sql.summary(f"SELECT * FROM ({RESULTS}) WHERE edit_type IS NOT NULL AND edit_type <> ''", "edit_type"),
)
def summary_by_edit_type(spark, sf_dir):
    return rounded(scoring.by_edit_type(inputs.trial_results(spark, sf_dir)))


TAGGED = f"SELECT * EXCLUDE (tags), unnest(tags) AS tag FROM ({RESULTS})"


@query("summary_by_tag", sql.summary(TAGGED, "tag"))
def summary_by_tag(spark, sf_dir):
    return rounded(scoring.by_tag(inputs.trial_results(spark, sf_dir)))


MEDIAN_PATH = f"""SELECT v AS median_path FROM (SELECT tree_path_length AS v,
  row_number() OVER (ORDER BY tree_path_length) AS r, count(*) OVER () AS n FROM ({RESULTS}))
  WHERE r = n // 2 + 1"""
CLASSED = f"""SELECT *, CASE WHEN tree_path_length <= median_path THEN 'short paths' ELSE 'long paths' END AS path_class
  FROM ({RESULTS}), ({MEDIAN_PATH})"""


@query("summary_by_path_class", sql.summary(CLASSED, "path_class, median_path"))
def summary_by_path_class(spark, sf_dir):
    return rounded(scoring.by_path_length(inputs.trial_results(spark, sf_dir)))


USER_MEDIAN = f"""SELECT user_id, v AS median_path FROM (SELECT user_id, tree_path_length AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY tree_path_length) AS r,
  count(*) OVER (PARTITION BY user_id) AS n FROM ({RESULTS})) WHERE r = n // 2 + 1"""


@query(
    "summary_by_user_and_path_class",
    sql.summary(
        f"""SELECT *, CASE WHEN tree_path_length <= median_path THEN 'short paths' ELSE 'long paths' END AS path_class
        FROM ({RESULTS}) JOIN ({USER_MEDIAN}) USING (user_id)""",
        "user_id, path_class, median_path",
    ),
)
def summary_by_user_and_path_class(spark, sf_dir):
    return rounded(scoring.by_path_length(inputs.trial_results(spark, sf_dir), ["user_id"]))


RIGHT = f"SELECT * FROM ({RESULTS}) WHERE (answer = 'yes' AND solvable) OR (answer = 'no' AND NOT solvable)"


@query(
    "median_response_time",
    f"""SELECT v AS median_rt FROM (SELECT latency AS v, row_number() OVER (ORDER BY latency) AS r,
    count(*) OVER () AS n FROM ({RIGHT})) WHERE r = n // 2 + 1""",
)
def median_response_time(spark, sf_dir):
    """Many distinct values: bracketed before it is sorted."""
    results = inputs.trial_results(spark, sf_dir).withColumnRenamed("latency", "rt")
    return scoring.median_response(results)


@query(
    "median_response_time_by_user",
    f"""SELECT user_id, v AS median_rt FROM (SELECT user_id, latency AS v,
    row_number() OVER (PARTITION BY user_id ORDER BY latency) AS r,
    count(*) OVER (PARTITION BY user_id) AS n FROM ({RIGHT})) WHERE r = n // 2 + 1""",
)
def median_response_time_by_user(spark, sf_dir):
    results = inputs.trial_results(spark, sf_dir).withColumnRenamed("latency", "rt")
    return scoring.median_response(results, ["user_id"])


SLIM = "solvable, answer, input_tokens, output_tokens"


@query(
    "summary_of_every_slice",
    sql.summary(
        f"""SELECT 'overall' AS slice, 'all' AS slice_value, {SLIM} FROM ({RESULTS})
        UNION ALL SELECT 'pocket', band, {SLIM} FROM ({BANDED}) WHERE band IS NOT NULL
        UNION ALL SELECT 'edit_type', edit_type, {SLIM} FROM ({RESULTS}) WHERE edit_type IS NOT NULL
        UNION ALL SELECT 'path', path_class, {SLIM} FROM ({CLASSED})
        UNION ALL SELECT 'tag', tag, {SLIM} FROM ({TAGGED})""",
        "slice, slice_value",
    ),
)
def summary_of_every_slice(spark, sf_dir):
    return rounded(scoring.slice_report(inputs.trial_results(spark, sf_dir)))


@query(
    "token_totals_by_edit_type",
    f"""SELECT edit_type, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens,
    coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM ({RESULTS}) GROUP BY edit_type""",
)
def token_totals_by_edit_type(spark, sf_dir):
    return scoring.token_totals(inputs.trial_results(spark, sf_dir), ["edit_type"])


SPLIT = f"SELECT *, CASE WHEN user_id % 10 < 8 THEN 'train' WHEN user_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM ({RESULTS})"
STATS = """count(*) AS n, count(*) FILTER (solvable) AS solvable, round(avg(tree_path_length), 6) AS mean_path,
  min(tree_path_length) AS min_path, max(tree_path_length) AS max_path,
  round(avg(pocket_frac), 6) AS mean_pocket, min(pocket_frac) AS min_pocket"""


@query(
    "corpus_statistics_by_split",
    f"SELECT coalesce(split, 'all') AS split, {STATS} FROM ({SPLIT}) GROUP BY ROLLUP (split)",
)
def corpus_statistics_by_split(spark, sf_dir):
    digit = F.col("user_id") % 10
    labels = inputs.trial_results(spark, sf_dir).withColumn(
        "split", F.when(digit < 8, "train").when(digit == 8, "val").otherwise("test")
    )
    return rounded(scoring.corpus_statistics(labels), ("mean_path", "mean_pocket"))


@query(
    "maze_trial_rows",
    f"""SELECT event_id AS trial, user_id AS seed, CAST(solvable AS INTEGER) AS solvable, 10 AS width, 8 AS height,
    tree_path_length, round(pocket_frac, 4) AS pocket_frac FROM ({RESULTS})""",
)
def maze_trial_rows(spark, sf_dir):
    trials = inputs.trial_results(spark, sf_dir).select(
        F.col("event_id").alias("trial"),
        F.col("user_id").alias("seed"),
        "solvable",
        F.lit(10).alias("width"),
        F.lit(8).alias("height"),
        "tree_path_length",
        "pocket_frac",
    )
    return scoring.maze_trial_rows(trials)


@query(
    "room_trial_rows",
    f"""SELECT event_id AS trial, 'r' || event_id AS id, 'room' || user_id AS room, 'p' || (event_id // 2) AS pair,
    CAST(solvable AS INTEGER) AS solvable, coalesce(edit_type, '') AS edit_type, array_to_string(tags, '|') AS tags,
    CASE WHEN tree_path_length % 5 <> 0 AND solvable THEN tree_path_length
         WHEN user_id % 3 <> 0 THEN user_id ELSE 0 END::BIGINT AS tree_path_length,
    CASE WHEN solvable THEN tree_path_length - (CASE WHEN tree_path_length % 5 = 0 THEN tree_path_length ELSE 0 END)
      END::BIGINT AS solution_length,
    0.5::DOUBLE AS pocket_frac FROM ({RESULTS})""",
)
def room_trial_rows(spark, sf_dir):
    length = F.col("tree_path_length").cast("bigint")
    trials = inputs.trial_results(spark, sf_dir).select(
        F.col("event_id").alias("trial"),
        F.concat(F.lit("r"), "event_id").alias("id"),
        F.concat(F.lit("room"), "user_id").alias("room"),
        F.concat(F.lit("p"), F.floor(F.col("event_id") / 2)).alias("pair"),
        "solvable",
        "edit_type",
        "tags",
        F.when(F.col("solvable"), F.when(length % 5 == 0, F.lit(0)).otherwise(length)).cast("bigint").alias("moves"),
        F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("base_moves"),
    )
    return scoring.room_trial_rows(trials)


@query(
    "results_view",
    rf"""SELECT conv_id, turn, right(regexp_replace(coalesce(text, ''), '{sql.SPACE}+', ' ', 'g'), 90) AS reply
    FROM conversations WHERE role = 'assistant'""",
)
def results_view(spark, sf_dir):
    replies = inputs.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return scoring.results_view(replies.select("conv_id", "turn", F.col("text").alias("reply")))
