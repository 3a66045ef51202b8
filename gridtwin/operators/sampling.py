"""Pairs, exact balance, splits and seeded samples.

Items carry ``id``, ``pair`` and ``solvable``, and where needed ``tags``
(array), ``verified`` (nullable boolean), ``set_id``, ``room``, ``images``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtwin.functions.images import angles_of
from gridtwin.functions.rng import draw, draw_int, trial_seed
from gridtwin.operators.ranking import BUCKETS, lowest_draws, lowest_numbers, row_draw, running_total, seeded_rank


# --- pairs -----------------------------------------------------------------------
def has_tag(tag: str) -> Column:
    return F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), tag)


def with_tag(items: DataFrame, tag: str | None) -> DataFrame:
    """Items carrying ``tag``; no tags at all counts as none."""
    return items.where(has_tag(tag)) if tag else items


def pair_table(items: DataFrame, verified_only: bool = False) -> DataFrame:
    """One row per pair of exactly two members with opposite labels.

    With ``verified_only`` a member that failed verification rules its pair
    out; a missing verification does not.
    """
    checks = [
        F.count("*").alias("_members"),
        F.count_if(F.col("solvable")).alias("_positive"),
        F.count_if(~F.col("solvable")).alias("_negative"),
    ]
    if verified_only:
        checks.append(
            F.bool_and(F.col("verified").isNull() | F.col("verified").eqNullSafe(F.col("solvable"))).alias("_verified")
        )
    pairs = items.groupBy("pair").agg(*checks)
    pairs = pairs.where((F.col("_members") == 2) & (F.col("_positive") == 1) & (F.col("_negative") == 1))
    return (pairs.where("_verified") if verified_only else pairs).select("pair")


def valid_pairs(items: DataFrame, verified_only: bool = False) -> DataFrame:
    """The members of all valid pairs."""
    return items.join(pair_table(items, verified_only), "pair", "left_semi")


def oriented_pairs(items: DataFrame) -> DataFrame:
    """Each valid pair as one row: by label and by id."""
    return valid_pairs(items).groupBy("pair").agg(
        F.max_by("id", "solvable").alias("positive_id"),
        F.min_by("id", "solvable").alias("negative_id"),
        F.min("id").alias("left_id"),
        F.max("id").alias("right_id"),
    )


def twins(items: DataFrame) -> DataFrame:
    """Each item with the other member of its pair.

    In a group of more than two the smallest id is the twin of all others,
    and the largest that of the smallest. Items without id or pair have none.
    """
    member = F.struct("id", "solvable")
    ends = items.where(F.col("id").isNotNull()).groupBy("pair").agg(F.min(member).alias("_low"), F.max(member).alias("_high"))
    twin = F.when(F.col("id") == F.col("_low.id"), F.col("_high")).otherwise(F.col("_low"))
    return (
        items.join(ends.where(F.col("_low.id") != F.col("_high.id")), "pair")
        .where(F.col("id").isNotNull())
        .withColumns({"twin_id": twin["id"], "twin_solvable": twin["solvable"]})
        .drop("_low", "_high")
    )


def pair_sample(items: DataFrame, seed: int, limit: int = 0, verified_only: bool = False) -> DataFrame:
    """Seeded sample of whole pairs, both members, in seeded order (``trial`` from 0).

    ``limit`` counts items: half as many pairs are kept, at least one; 0 keeps all.
    """
    pairs = pair_table(items, verified_only)
    if limit:
        pairs = lowest_draws(pairs, seed, "pair", max(1, limit // 2)).select("pair")
    members = items.join(pairs, "pair", "left_semi")
    return seeded_rank(members, seed + 1, "id", "trial").withColumn("trial", F.col("trial") - 1)


def first_pairs(items: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first pairs of each set by appearance (``position``); sets without a limit stay whole."""
    if not limits:
        return items
    limit = F.lit(None).cast("int")
    for name, most in limits.items():
        limit = F.when(F.col("set_id") == name, F.lit(most)).otherwise(limit)
    limited = F.col("set_id").isin(*limits)
    appeared = items.where(limited).groupBy("set_id", "pair").agg(F.min("position").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("_first", "pair"))
    # the constant bound lets every task drop later pairs before the shuffle
    kept = (
        appeared.withColumn("_rank", rank)
        .where(F.col("_rank") <= max(limits.values()))
        .where(F.col("_rank") <= limit)
        .select("set_id", "pair")
    )
    return items.where(limited).join(kept, ["set_id", "pair"], "left_semi").unionByName(
        items.where(~F.coalesce(limited, F.lit(False)))
    )


# --- balanced draws ----------------------------------------------------------------
def balanced_trials(indexed: DataFrame, session: str, session_seed: int) -> DataFrame:
    """Exactly half of the trials (by ``index``) positive, in seeded order, with a seed per trial."""
    ranked = seeded_rank(indexed, session_seed, "index", "_rank")
    return ranked.select(
        *indexed.columns,
        trial_seed(session, F.col("index")).alias("seed"),
        ((F.col("_rank") - 1) % 2 == 0).alias("solvable"),
    )


def balanced_subset(items: DataFrame, limit: int, seed: int) -> DataFrame:
    """``limit div 2`` seeded items of each label (all for 0), in seeded order (``trial`` from 0)."""
    if limit:
        items = lowest_draws(items, seed, "id", limit // 2, ["solvable"])
    return seeded_rank(items, seed + 1, "id", "trial").withColumn("trial", F.col("trial") - 1)


def split_plan(units: DataFrame, key: str, fractions: tuple[float, float, float], seed: int) -> DataFrame:
    """Exact split sizes and alternating labels over distinct ``key`` values.

    Adds ``split`` (train, val, test) and ``label``: labels alternate inside
    each split, so a split of odd size has one more positive. Sizes round half
    to even, the rest goes to test.
    """
    if len(fractions) != 3 or abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError("splits must be three fractions summing to 1")
    ranked = seeded_rank(units, seed, key, "_rank", total="_n")
    place = F.col("_rank") - 1
    n_train = F.bround(F.lit(fractions[0]) * F.col("_n")).cast("bigint")
    n_val = F.bround(F.lit(fractions[1]) * F.col("_n")).cast("bigint")
    return (
        ranked.withColumn("_train", n_train)
        .withColumn("_val", n_val)
        .withColumn(
            "split",
            F.when(place < F.col("_train"), "train").when(place < F.col("_train") + F.col("_val"), "val").otherwise("test"),
        )
        .withColumn(
            "_start",
            F.when(F.col("split") == "train", F.lit(0))
            .when(F.col("split") == "val", F.col("_train"))
            .otherwise(F.col("_train") + F.col("_val")),
        )
        .withColumn("label", (place - F.col("_start")) % 2 == 0)
        .drop("_rank", "_n", "_train", "_val", "_start")
    )


def first_valid_seeds(pairs: DataFrame, n: int, min_path: int) -> DataFrame:
    """The first ``n`` seeds (ascending) whose tree path is long enough, with ``idx`` from 0."""
    valid = pairs.where(F.col("tree_path_length") >= min_path)
    return lowest_numbers(valid, "seed", n, "idx").withColumn("idx", F.col("idx") - 1)


def skipped_seeds(pairs: DataFrame, n: int, min_path: int) -> DataFrame:
    """How many seeds were passed over before the ``n``-th valid one (all invalid ones where there are fewer)."""
    valid = F.col("tree_path_length") >= min_path
    taken = first_valid_seeds(pairs, n, min_path).agg(F.count("*").alias("chosen"), F.max("seed").alias("last")).first()
    passed = F.lit(True) if taken["chosen"] < n else F.col("seed") < taken["last"]
    return pairs.agg(F.count_if(~valid & passed & (F.lit(n) > 0)).alias("skipped")).select(
        F.lit(taken["chosen"]).cast("bigint").alias("chosen"), "skipped"
    )


def emit_members(plan: DataFrame, members: DataFrame, both: bool) -> DataFrame:
    """Corpus rows with running ids: both members of each pair, or the one with the planned label.

    ``plan`` has ``idx``, ``split``, ``label``; ``members`` has ``idx``,
    ``solvable`` and the payload. Positive members come first.
    """
    rows = members.join(plan, "idx")
    if both:
        number = 2 * F.col("idx") + F.when(F.col("solvable"), 0).otherwise(1)
    else:
        rows = rows.where(F.col("solvable") == F.col("label"))
        number = F.col("idx")
    return rows.withColumn("id", item_id(number)).drop("label")


def item_id(number: Column) -> Column:
    """Running number as at least six digits."""
    return F.format_string("%06d", number.cast("bigint"))


# --- catalogue views ----------------------------------------------------------------
def selection_view(
    items: DataFrame, seed: int, set_id: str = "", tag: str = "", view: str = "mix", angle: str = "mix"
) -> DataFrame:
    """Filtered items in seeded order, several rotations first, each with a view and a rotation.

    ``mix`` takes the overhead view for 40% of the items that have one, and a
    random listed rotation; items without the wanted image drop out.
    """
    rows = with_tag(items, tag)
    if set_id:
        rows = rows.where(F.col("set_id") == set_id)
    rows = (
        rows.withColumn("_angles", angles_of(F.col("images")))
        .withColumn("_draw", row_draw(seed, "id"))
        .withColumn("_top", F.coalesce(F.col("images.top"), F.lit("")) != "")
    )
    # the chunk number keeps the order (angles desc, draw)
    chunk = F.floor(F.col("_draw") * BUCKETS) - F.coalesce(F.size("_angles"), F.lit(0)) * BUCKETS
    picked_view = (
        F.when(F.col("_top") & (draw(seed + 1, F.col("id")) < 0.4), "top").otherwise("perspective")
        if view == "mix"
        else F.lit(view)
    )
    picked_angle = (
        F.element_at("_angles", draw_int(seed + 2, F.col("id"), F.size("_angles")) + 1)
        if angle == "mix"
        else F.lit(int(angle))
    )
    shown = (
        rows.withColumn("_chunk_of", chunk)
        .withColumn("view", picked_view)
        .withColumn("yaw", F.when(F.col("view") == "top", F.lit(0)).otherwise(picked_angle))
        .where((F.col("view") != "top") | F.col("_top"))
        .where((F.col("view") == "top") | F.array_contains("_angles", F.col("yaw")))
    )
    placed = running_total(
        shown, [], F.col("_chunk_of"), [F.size("_angles").desc(), "_draw", "id"], F.lit(1), "position"
    )
    return placed.select("position", "id", "pair", "solvable", "view", "yaw")


def facets(items: DataFrame) -> DataFrame:
    """Per set: known tags (sorted, comma separated), items, valid pairs, their rooms, solvable items."""
    rooms = (
        items.join(pair_table(items), "pair", "left_semi")
        .groupBy("set_id")
        .agg(F.countDistinct("pair").alias("pairs"), F.countDistinct("room").alias("rooms"))
    )
    tags = (
        items.select("set_id", F.explode("tags").alias("tag"))
        .groupBy("set_id")
        .agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    )
    totals = items.groupBy("set_id").agg(
        F.count("*").alias("items"), F.count_if(F.col("solvable")).alias("solvable_items")
    )
    return (
        totals.join(rooms, "set_id", "left")
        .join(tags, "set_id", "left")
        .select(
            "set_id",
            "items",
            "solvable_items",
            F.coalesce("pairs", F.lit(0)).alias("pairs"),
            F.coalesce("rooms", F.lit(0)).alias("rooms"),
            F.coalesce("tags", F.lit("")).alias("tags"),
        )
    )
