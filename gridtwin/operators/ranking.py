"""Running totals, ranks and positional medians that never sort one big group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtwin.functions.rng import draw, fnv1a32
from gridtwin.session import cut, cut_counting

BUCKETS = 1 << 14
AT_ONCE = 4096
STEPS = 1024


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with nulls equal to each other; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_on_{k}" for k in keys])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column | str],
    value: Column,
    name: str,
    total: str | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` in the given order.

    ``chunk`` cuts each group into consecutive pieces: it must never decrease
    along ``order``. Pieces are summed first, the sums are accumulated over
    the few pieces of a group, and only inside one piece rows are sorted, so
    a group holding most of the table still spreads over all tasks. ``total``
    names a column for the sum over the whole group. A null key or chunk is a
    group of its own; every row stays.
    """
    out = running_totals(df, keys, chunk, order, {name: value})
    if not total:
        return out
    whole = df.groupBy(*keys).agg(F.sum(value.cast("bigint")).alias(total))
    return _with_group_row(out, whole, list(keys))


def running_totals(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column | str], values: dict[str, Column]
) -> DataFrame:
    """:func:`running_total` of several values at once: a prefix scan of a vector of counters over stretches of rows."""
    keys = list(keys)
    value = {name: f"_value{i}" for i, name in enumerate(values)}
    tagged = df.withColumn("_chunk", chunk).withColumns({value[name]: v.cast("bigint") for name, v in values.items()})
    pieces = tagged.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(c) for c in value.values()])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *keys, "_chunk", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in value.values()]
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = tagged.withColumns({f"_inside{c}": F.sum(c).over(inside) for c in value.values()})
    out = join_groups(summed, offsets, [*keys, "_chunk"])
    kept = [c for c in df.columns if c not in values]
    return out.select(*kept, *[(F.col(f"_before{c}") + F.col(f"_inside{c}")).alias(name) for name, c in value.items()])


def within_first(df: DataFrame, groups: Sequence[str], chunk: Column, k: int) -> DataFrame:
    """The rows of each group in the first chunks that hold ``k`` rows: all that a rank up to ``k`` can need.

    A histogram of the chunks (bounded by their number) fixes the last one
    before any row is moved, so what follows handles about ``k`` rows a group.
    """
    groups = list(groups)
    tagged = df.withColumn("_chunk", chunk)
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    upto = F.sum("_n").over(group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0))
    counted = tagged.groupBy(*groups, "_chunk").agg(F.count("*").alias("_n")).withColumn("_upto", upto)
    last = counted.groupBy(*groups).agg(F.min(F.when(F.col("_upto") >= k, F.col("_chunk"))).alias("_last"))
    kept = _with_group_row(tagged, last, groups)
    return kept.where(F.col("_last").isNull() | (F.col("_chunk") <= F.col("_last"))).select(*df.columns)


def lowest_draws(df: DataFrame, seed: Column | int, key: str, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows of each group's seeded shuffle, without ranking the others."""
    bucket = F.floor(row_draw(seed, key) * BUCKETS)
    ranked = seeded_rank(within_first(df, groups, bucket, k), seed, key, "_place", groups)
    return ranked.where(F.col("_place") <= k).drop("_place")


def lowest_numbers(df: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """The rows with the ``k`` smallest numbers ``key`` and their 1-based position ``name``."""
    ends = df.agg(F.min(key).alias("_low"), F.max(key).alias("_high")).first()
    low, high = (ends[0] or 0, ends[1] or 0)
    width = max(1, -(-(high - low + 1) // BUCKETS))
    near = within_first(df, (), F.floor((F.col(key) - low) / width), k)
    return number_rank(near, key, max(1, width), name).where(F.col(name) <= k)


def row_draw(seed: Column | int, key: str | Column, is_text: bool = False) -> Column:
    """The number that places a row in a seeded order: the draw counted by its key."""
    key = F.col(key) if isinstance(key, str) else key
    return draw(seed, fnv1a32(key) if is_text else key)


def seeded_rank(
    df: DataFrame,
    seed: Column | int,
    key: str,
    name: str,
    groups: Sequence[str] = (),
    is_text: bool = False,
    total: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """1-based position of each row in the seeded shuffle of its group.

    For few, large groups (or the whole table). The draws are uniform, so
    cutting [0, 1) into equal buckets gives pieces of equal size.
    """
    placed = df.withColumn("_draw", row_draw(seed, key, is_text))
    ranked = running_total(
        placed, groups, F.floor(F.col("_draw") * buckets), ["_draw", key], F.lit(1), name, total
    )
    return ranked.drop("_draw")


def seeded_order(seed: Column | int, key: str, groups: Sequence[str], is_text: bool = False):
    """Window for a seeded order inside many small groups."""
    return Window.partitionBy(*groups).orderBy(row_draw(seed, key, is_text), F.col(key))


def number_rank(
    df: DataFrame,
    key: str,
    width: Column | int,
    name: str,
    groups: Sequence[str] = (),
    total: str | None = None,
) -> DataFrame:
    """1-based position by a unique number, taken in stretches of ``width`` numbers."""
    chunk = F.floor(F.col(key) / width)
    return running_total(df, groups, chunk, [key], F.lit(1), name, total)


def upper_median(df: DataFrame, groups: Sequence[str], value: str, name: str, at_once: int = AT_ONCE) -> DataFrame:
    """Exact upper median ``sorted[n div 2]`` of ``value`` per group, nulls ignored.

    Equal values are counted first. A group with more than ``at_once``
    different values is then narrowed, all such groups together: its values
    are counted in buckets (first by power of two, then in equal steps between
    the smallest and largest value left) and only the bucket of the median goes
    on. So at most ``at_once`` values, or one pass's buckets, of a group are ever sorted together.
    """
    groups = list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    histogram = cut(rows.groupBy(*groups, "_v").agg(F.count("*").alias("_n")), "histogram")
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    left = histogram.groupBy(*groups).agg(
        F.floor(F.sum("_n") / 2).alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_m")
    )
    left, wide = cut_counting(left, F.col("_m") > at_once, "median")
    bucket = _binade(F.col("_v"))
    while wide:
        inside = _with_group_row(histogram, left.where(F.col("_m") > at_once), groups)
        inside = inside.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counted = inside.groupBy(*groups, "_k", bucket.alias("_bucket")).agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_m")
        )
        upto = F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
        narrowed = _holding(counted.withColumn("_upto", upto))
        narrowed = narrowed.select(*groups, (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_k"), "_lo", "_hi", "_m")
        left, wide = cut_counting(left.where(F.col("_m") <= at_once).unionByName(narrowed), F.col("_m") > at_once, "median")
        bucket = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * STEPS)
    upto = F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rest = _with_group_row(histogram, left, groups).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    return _holding(rest.withColumn("_upto", upto)).select(*groups, F.col("_v").alias(name))


def _binade(value: Column) -> Column:
    """A number that never decreases along ``value``: its sign and power of two; infinities and NaN lie outside."""
    number = value.cast("double")
    size = F.abs(number)
    power = F.floor(F.log2(size)) + 1100
    most = 9999
    power = F.when(size == 0, 0).when(F.isnan(number), most + 1).when(size == float("inf"), most).otherwise(power)
    return F.when(number < 0, -power).otherwise(power)


def _holding(counted: DataFrame) -> DataFrame:
    """Of consecutive rows with ``_n`` each and ``_upto`` so far, those that hold position ``_k``."""
    return counted.where((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_n") <= F.col("_k")))


def _with_group_row(rows: DataFrame, per_group: DataFrame, groups: list[str]) -> DataFrame:
    """Attach a table of one row per group; without groups it is exactly one row."""
    if groups:
        return join_groups(rows, per_group, groups)
    return rows.join(F.broadcast(per_group), F.lit(True))
