"""From levels to one-edit pairs, around a verdict table made elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtwin.operators import edits, rooms
from gridtwin.session import cut


def plan_tries(levels: DataFrame, seed: int, per_type: int = 8, path_cells: DataFrame | None = None) -> DataFrame:
    """Seeded edits of each level in the order they should be judged: write this out for the solver."""
    if path_cells is None:
        near = edits.enumerate_edits(levels).withColumn("near", F.lit(None).cast("boolean"))
    else:
        near = edits.touching(edits.enumerate_edits(edits.with_paths(levels, path_cells), ["visited"]))
    return edits.try_order(edits.sample_edits(near, seed, per_type))


def pairs_from_verdicts(
    levels: DataFrame, tries: DataFrame, verdicts: DataFrame, base: DataFrame, pairs_per_room: int = 2
) -> DataFrame:
    """Variant records of the matched pairs.

    ``verdicts(edit_id, status, moves)`` judges the tries; ``base(room_id,
    world, status, moves)`` holds what is known of the unedited rooms. Only
    rooms solved unedited give pairs; ``rooms.skipped_rooms`` names the others.
    """
    base = base.where("status = 'solved'")
    tries = tries.join(base.select("room_id"), "room_id", "left_semi")
    judged = edits.until_enough(edits.with_status(tries, verdicts), pairs_per_room)
    matched = cut(edits.match_pairs(cut(judged, "judged"), pairs_per_room), "matched")
    stats = rooms.room_statistics(rooms.level_cells(levels), rooms.token_types(levels.sparkSession))
    facts = stats.select("room_id", "tags", "gems").join(
        base.select("room_id", "world", F.col("moves").alias("base_moves")), "room_id"
    )
    return edits.pair_records(matched, facts, levels)
