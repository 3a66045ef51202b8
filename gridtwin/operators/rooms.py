"""Rooms as level text, as cells and as statistics, and results known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtwin.functions import cells as C

# What each token stands for. Numbered boxes are listed as M,
# slopes of all directions as S.
TOKEN_TYPES = (
    (".", "terrain", "floor"),
    ("#", "terrain", "wall"),
    ("i", "terrain", "ice"),
    ("S", "terrain", "ice_slope"),
    ("l", "terrain", "player_lift"),
    ("L", "terrain", "player_lift"),
    ("O", "terrain", "orange_wall"),
    ("o", "terrain", "orange_button"),
    ("p", "actor", "player"),
    ("G", "actor", "gem"),
    ("M", "actor", "box"),
    ("b", "actor", "box"),
    ("f", "actor", "floating_floor"),
)
# The tag a room gets for each type; other types give none.
TYPE_TAGS = {
    "ice": "ice",
    "ice_slope": "slope",
    "player_lift": "lift",
    "orange_wall": "orange",
    "orange_button": "orange",
    "box": "box",
    "floating_floor": "floating_floor",
}


def level_cells(levels: DataFrame) -> DataFrame:
    """Level text to one row per cell: ``room_id, width, height, x, y, cell``. No shuffle."""
    return (
        levels.select("room_id", C.level_grid(F.col("text")).alias("_grid"))
        .select("room_id", F.size("_grid").alias("height"), F.posexplode("_grid").alias("y", "_row"))
        .select("room_id", F.size("_row").alias("width"), "height", "y", F.posexplode("_row").alias("x", "cell"))
        .select("room_id", "width", "height", "x", "y", "cell")
    )


def cells_level(cells: DataFrame) -> DataFrame:
    """Cells back to level text: ``room_id, text``."""
    row = F.array_sort(F.collect_list(F.struct("x", "cell")))["cell"]
    lines = cells.groupBy("room_id", "y").agg(F.array_join(row, " ").alias("line"))
    grid = F.array_sort(F.collect_list(F.struct("y", "line")))["line"]
    return lines.groupBy("room_id").agg(F.concat(F.array_join(grid, "\n"), F.lit("\n")).alias("text"))


def token_types(spark: SparkSession) -> DataFrame:
    """Default meaning of tokens; pass a longer table to :func:`room_statistics` to extend it."""
    return spark.createDataFrame(list(TOKEN_TYPES), "token string, class string, type string")


def token_kind(token: Column) -> Column:
    """Token without box number or slope direction, as listed in the token table."""
    return F.when(token.rlike("^M[0-9]+$"), "M").when(token.rlike(C.SLOPE_TOKEN), "S").otherwise(token)


def type_counts(cells: DataFrame, types: DataFrame) -> DataFrame:
    """``room_id, class, type, n``; tokens missing from the table count as type unknown."""
    tokens = cells.select("room_id", F.explode(C.split_cell(F.col("cell"))).alias("_t")).where(F.col("_t") != "")
    return (
        tokens.select("room_id", token_kind(F.col("_t")).alias("token"))
        .groupBy("room_id", "token")
        .agg(F.count("*").alias("_n"))
        .join(types, "token", "left")
        .groupBy(
            "room_id",
            F.coalesce("class", F.lit("unknown")).alias("class"),
            F.coalesce("type", F.lit("unknown")).alias("type"),
        )
        .agg(F.sum("_n").alias("n"))
    )


def room_statistics(cells: DataFrame, types: DataFrame) -> DataFrame:
    """One row per room: size, used and air cells, tallest stack, counts per type, sorted tags."""
    tag = F.lit(None).cast("string")
    for name, value in TYPE_TAGS.items():
        tag = F.when(F.col("type") == name, F.lit(value)).otherwise(tag)

    def counts(kind: str) -> Column:
        entries = F.collect_list(F.when(F.col("class") == kind, F.struct("type", "n")))
        return F.map_from_entries(F.array_sort(entries))

    def number(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("n"))), F.lit(0))

    typed = type_counts(cells, types).groupBy("room_id").agg(
        counts("actor").alias("actors"),
        counts("terrain").alias("terrain"),
        number("gem").alias("gems"),
        number("player").alias("players"),
        number("unknown").alias("unknown"),
        F.collect_set(tag).alias("_tags"),
    )
    tokens = C.split_cell(F.col("cell"))
    air = C.is_air(F.col("_tokens"))
    shaped = (
        cells.withColumn("_tokens", tokens)
        .groupBy("room_id")
        .agg(
            F.max("width").alias("width"),
            F.max("height").alias("height"),
            F.count_if(air).alias("air"),
            F.count_if(~air).alias("cells_used"),
            F.coalesce(F.max(F.when(~air, F.size("_tokens"))), F.lit(0)).alias("max_stack"),
        )
    )
    nothing = F.array().cast("array<string>")
    tags = F.concat(
        F.coalesce("_tags", nothing),
        F.when(F.col("air") > 0, F.array(F.lit("holes"))).otherwise(nothing),
        F.when(F.col("max_stack") > 2, F.array(F.lit("elevation"))).otherwise(nothing),
    )
    return shaped.join(typed, "room_id", "left").select(
        "room_id",
        "width",
        "height",
        "cells_used",
        "air",
        "max_stack",
        F.coalesce("gems", F.lit(0)).alias("gems"),
        F.coalesce("players", F.lit(0)).alias("players"),
        F.coalesce("unknown", F.lit(0)).alias("unknown"),
        "actors",
        "terrain",
        F.array_sort(F.array_distinct(tags)).alias("tags"),
    )


def level_zoom(levels: DataFrame) -> DataFrame:
    """Tallest stack (air counts as one) and camera zoom of each level. No shuffle."""
    heights = F.transform(
        F.flatten(C.level_grid(F.col("text"))), lambda cell: F.size(C.split_cell(cell))
    )
    return levels.select("room_id", F.coalesce(F.array_max(heights), F.lit(1)).alias("max_stack")).withColumn(
        "zoom", C.zoom_of(F.col("max_stack"))
    )


# --- known results --------------------------------------------------------------------
def status_counts(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return results.groupBy(*by, "status").agg(F.count("*").alias("n"))


def not_recorded(rooms: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rooms without a result yet."""
    return rooms.join(recorded.select("room_id"), "room_id", "left_anti")


def usable_rooms(
    rooms: DataFrame, results: DataFrame, only: list[str] | None = None, limit: int = 0
) -> DataFrame:
    """Rooms without a result or solved, with their result; optionally only some, or the first ``limit`` by file."""
    if only is not None:
        rooms = rooms.where(F.col("room_id").isin(only))
    known = results.select("room_id", "status", "moves")
    kept = rooms.join(known, "room_id", "left").where(F.col("status").isNull() | (F.col("status") == "solved"))
    return kept.orderBy("file").limit(limit) if limit else kept


def skipped_rooms(rooms: DataFrame, results: DataFrame) -> DataFrame:
    """``room_id, reason`` of the rooms no pairs are made from: the status that is not solved, or ``no result``."""
    known = results.select("room_id", "status")
    reason = F.coalesce("status", F.lit("no result"))
    return rooms.select("room_id").join(known, "room_id", "left").select("room_id", reason.alias("reason")).where("reason <> 'solved'")


def verification_audit(variants: DataFrame) -> DataFrame:
    """Labels compared with a second verdict: null is capped, a differing one is a mismatch."""
    return variants.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("solvable")).alias("solvable"),
        F.count_if(F.col("verified").isNull()).alias("capped"),
        F.count_if(F.coalesce(F.col("verified") != F.col("solvable"), F.lit(False))).alias("mismatches"),
    )
