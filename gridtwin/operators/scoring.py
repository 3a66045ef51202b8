"""Signal-detection summaries of trial results, whole and by slice.

Result rows carry ``solvable`` (boolean truth), ``answer`` and whichever of
``input_tokens``, ``output_tokens``, ``pocket_frac``, ``edit_type``, ``tags``,
``tree_path_length``, ``rt`` and ``correct`` a slice needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtwin.functions.answers import answered, is_correct
from gridtwin.functions.signal import sensitivity
from gridtwin.operators.ranking import join_groups, running_totals, upper_median

# Bands of the smaller component's share, lower edge included.
POCKET_BANDS = ((0.0, 0.15, "pocket < 15%"), (0.15, 0.3, "pocket 15-30%"), (0.3, 0.51, "pocket >= 30%"))


def counters() -> dict[str, Column]:
    """What one result adds to each number of a summary."""
    said_yes = F.col("answer") == "yes"
    truth = F.coalesce(F.col("solvable"), F.lit(False))
    replied = answered(F.col("answer"))
    one = lambda condition: F.when(condition, 1).otherwise(0).cast("bigint")
    return {
        "n": F.lit(1).cast("bigint"),
        "answered": one(replied),
        "correct": one(is_correct(F.col("answer"), truth)),
        "positives": one(replied & truth),
        "negatives": one(replied & ~truth),
        "hits": one(replied & truth & said_yes),
        "false_alarms": one(replied & ~truth & said_yes),
        "refused": one(F.col("answer") == "refused"),
        "errors": one(F.col("answer") == "error"),
        "unparsed": one(F.col("answer") == "unparsed"),
        "input_tokens": F.coalesce("input_tokens", F.lit(0)).cast("bigint"),
        "output_tokens": F.coalesce("output_tokens", F.lit(0)).cast("bigint"),
    }


def summary_counts() -> list[Column]:
    """Additive part of a summary: everything here can be combined map-side or on a stream."""
    return [F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in counters().items()]


def rates(counted: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Turn the counts into accuracy, hit and false-alarm rate and d'."""
    def share(part: str, whole: str) -> Column:
        return F.try_divide(F.col(part), F.col(whole))

    return counted.select(
        *keep,
        "n",
        "answered",
        "correct",
        share("correct", "answered").alias("accuracy"),
        share("hits", "positives").alias("hit_rate"),
        share("false_alarms", "negatives").alias("fa_rate"),
        sensitivity(*[F.col(c) for c in ("hits", "positives", "false_alarms", "negatives")]).alias("dprime"),
        "refused",
        "errors",
        "unparsed",
        "input_tokens",
        "output_tokens",
    )


def _with_tokens(results: DataFrame) -> DataFrame:
    for column in ("input_tokens", "output_tokens"):
        if column not in results.columns:
            results = results.withColumn(column, F.lit(0).cast("bigint"))
    return results


def summary_after_each(results: DataFrame, stretch: Column, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The summary of all results so far after each one, in ``order``: one row a result, with ``order`` and ``by``.

    ``stretch`` cuts the results into consecutive pieces (see
    ``ranking.running_total``): pieces are summed, the sums accumulated, and
    only the results of one piece sorted together. The last row of a group is its :func:`summarize`.
    """
    return rates(running_totals(_with_tokens(results), by, stretch, order, counters()), [*by, *order])


def summarize(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One summary per group (one row in all without ``by``)."""
    return rates(_with_tokens(results).groupBy(*by).agg(*summary_counts()), by)


def pocket_band(share: Column) -> Column:
    """Band name, null outside all bands."""
    band = F.lit(None).cast("string")
    for low, high, name in POCKET_BANDS:
        band = F.when((share >= low) & (share < high), F.lit(name)).otherwise(band)
    return band


def by_pocket(results: DataFrame) -> DataFrame:
    banded = results.withColumn("band", pocket_band(F.col("pocket_frac")))
    return summarize(banded.where(F.col("band").isNotNull()), ["band"])


def by_edit_type(results: DataFrame) -> DataFrame:
    return summarize(results.where(F.coalesce(F.col("edit_type"), F.lit("")) != ""), ["edit_type"])


def explode_tags(results: DataFrame) -> DataFrame:
    """One row per distinct tag of each row; rows without tags drop out."""
    return results.withColumn("tag", F.explode(F.array_distinct("tags")))


def by_tag(results: DataFrame) -> DataFrame:
    """A row counts in each of its tags."""
    return summarize(explode_tags(results), ["tag"])


def with_path_class(results: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Split at the upper median path length: up to it short, above it long, null without a length; every row stays."""
    median = upper_median(results, groups, "tree_path_length", "median_path")
    # without groups the right side is one row, or none where no row has a length
    joined = join_groups(results, median, groups, "left") if groups else results.join(F.broadcast(median), F.lit(True), "left")
    longer = F.col("tree_path_length") > F.col("median_path")
    return joined.withColumn("path_class", F.when(longer, F.lit("long paths")).when(~longer, F.lit("short paths")))


def by_path_length(results: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    split = with_path_class(results, groups).where(F.col("path_class").isNotNull())
    return summarize(split, [*groups, "path_class", "median_path"])


def median_response(results: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Upper median response time of correct answers."""
    right = results.where(is_correct(F.col("answer"), F.col("solvable")))
    return upper_median(right, groups, "rt", "median_rt")


def slice_report(results: DataFrame) -> DataFrame:
    """Overall, pocket band, edit type, tag and path-length summaries in one table."""
    tags = F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))

    def labelled(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("slice"), value.alias("slice_value"))

    single = F.array(
        labelled("overall", F.lit("all")),
        labelled("pocket", pocket_band(F.col("pocket_frac"))),
        labelled("edit_type", F.nullif(F.col("edit_type"), F.lit(""))),
        labelled("path", F.col("path_class")),
    )
    placed = F.concat(
        F.filter(single, lambda s: s["slice_value"].isNotNull()),
        F.transform(tags, lambda tag: labelled("tag", tag)),
    )
    rows = (
        with_path_class(_with_tokens(results))
        .withColumn("_slice", F.explode(placed))
        .select("_slice.*", "solvable", "answer", "input_tokens", "output_tokens")
    )
    return summarize(rows, ["slice", "slice_value"])


def token_totals(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*by).agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("output_tokens"),
    )


def corpus_statistics(labels: DataFrame) -> DataFrame:
    """Size, solvable count, path and pocket statistics per split and in all (split ``all``)."""
    return (
        labels.rollup("split")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("solvable")).alias("solvable"),
            F.avg("tree_path_length").alias("mean_path"),
            F.min("tree_path_length").alias("min_path"),
            F.max("tree_path_length").alias("max_path"),
            F.avg("pocket_frac").alias("mean_pocket"),
            F.min("pocket_frac").alias("min_pocket"),
        )
        .withColumn("split", F.coalesce("split", F.lit("all")))
    )


def maze_trial_rows(trials: DataFrame) -> DataFrame:
    """Flat result columns of a maze trial."""
    return trials.select(
        "trial",
        "seed",
        F.col("solvable").cast("int").alias("solvable"),
        "width",
        "height",
        "tree_path_length",
        F.round("pocket_frac", 4).alias("pocket_frac"),
    )


def room_trial_rows(trials: DataFrame) -> DataFrame:
    """Flat result columns of a room trial; rooms have no pocket, so it is fixed at one half."""
    return trials.select(
        "trial",
        "id",
        "room",
        "pair",
        F.col("solvable").cast("int").alias("solvable"),
        F.coalesce("edit_type", F.lit("")).alias("edit_type"),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|").alias("tags"),
        F.coalesce(F.nullif("moves", F.lit(0)), "base_moves", F.lit(0)).alias("tree_path_length"),
        F.col("moves").alias("solution_length"),
        F.lit(0.5).alias("pocket_frac"),
    )


def results_view(results: DataFrame) -> DataFrame:
    """Table shown while a run goes on: the end of each reply on one line."""
    from gridtwin.functions.text import squeeze

    line = squeeze(F.coalesce("reply", F.lit("")))
    return results.withColumn("reply", F.right(line, F.lit(90)))
