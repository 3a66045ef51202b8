"""Whole rooms: a maze or an open field as ground plan, with one kind of mechanic written into the level.

A maze becomes a room by drawing it in blocks; from then on it is a table
like a field's, so every mechanic of :mod:`gridtwin.operators.fields` works on both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtwin.functions.rng import draw, draw_int
from gridtwin.operators import boards, fields, minimal_pairs
from gridtwin.operators.rooms import cells_level
from gridtwin.session import cut

# Kinds of rooms in order of the tries, their share of fields, loops of a maze.
TYPES = ("maze", "ice", "boxes", "holes", "orange")
PUSHING = ("boxes", "holes", "orange")
FIELD_SHARE, FIELD_SHARE_PUSHING = 0.4, 0.75
FEWEST_LOOPS, LOOP_NUMBERS = 2, 3

# Draws of one seed are numbered; these blocks are used by neither pairs nor fields.
LOOPS, LAYOUT = (block << 20 for block in (8, 9))

PARTS = ("rooms", "boards", "ends", "paths")


def planned_rooms(tries: DataFrame) -> DataFrame:
    """``room_id, seed, type, layout`` of the tries ``(room_id, seed, attempt)``.

    Kinds follow each other in order of ``attempt`` (null counts as 0); rooms to push things in are
    more often fields. Rows without id or seed are left out: nothing can be drawn for them.
    """
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(F.coalesce("attempt", F.lit(0)), F.lit(len(TYPES))) + 1).cast("int"))
    share = F.when(F.col("type").isin(*PUSHING), FIELD_SHARE_PUSHING).otherwise(FIELD_SHARE)
    return (
        tries.where(F.col("room_id").isNotNull() & F.col("seed").isNotNull())
        .select("room_id", "seed", kind.alias("type"))
        .withColumn("layout", F.when(draw(F.col("seed"), LAYOUT) < share, "field").otherwise("maze"))
    )


def _block(cell: Column, side: int, size: int) -> Column:
    """The room's node on which a cell of the maze is drawn."""
    return ((2 * F.floor(cell / side) + 1) * size + 2 * (cell % side) + 1).cast("int")


def maze_layouts(rooms: DataFrame, size: int = 16) -> dict[str, DataFrame]:
    """Solvable seeded mazes drawn as rooms: the tables of :func:`fields.obstacle_fields` but ``rejected``.

    Every cell of the maze and every passage is one open cell of the room, all
    else is wall. The solution lists the maze's cells only, numbered along the shortest path.
    """
    side = (size - 1) // 2
    seed = F.col("seed")
    params = rooms.select(
        F.col("room_id").alias("graph_id"),
        F.lit(side).alias("width"),
        F.lit(side).alias("height"),
        "seed",
        F.lit("far").alias("placement"),
        F.lit("balanced").alias("cut_mode"),
        F.lit(None).cast("double").alias("cut_pos"),
        (draw_int(seed, LOOPS, LOOP_NUMBERS) + FEWEST_LOOPS).alias("loops"),
        F.lit(max(2, -(-side // 2))).alias("min_distance"),
    )
    pairs = minimal_pairs.build_pairs(params)
    edges = minimal_pairs.members(pairs["passages"]).where("solvable").select("graph_id", "a", "b")
    ends = pairs["ends"].select("graph_id", "start", "goal")
    drawn = boards.with_flood(boards.boards_of_edges(pairs["params"], edges).join(ends, "graph_id"), F.col("start"))
    path = boards.path_to(F.col("flood"), F.col("goal"), F.col("right"), F.col("down"), F.col("width"))
    paths = drawn.select(
        F.col("graph_id").alias("room_id"), F.transform(path, lambda cell: _block(cell, side, size)).alias("path")
    ).where(F.col("path").isNotNull())
    # a passage lies behind its first cell, to the right or below
    passage = _block(F.col("a"), side, size) + F.when(F.col("b") == F.col("a") + 1, 1).otherwise(size)
    passages = edges.groupBy("graph_id").agg(F.collect_set(passage).alias("_passages"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.cast("int"))
    cells = sum(1 << (2 * x + 1) for x in range(side))

    def row(y: Column) -> Column:
        own = F.when((y % 2 == 1) & (y < 2 * side), F.lit(cells).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        here = F.filter("_passages", lambda node: F.floor(node / size) == y)
        return F.aggregate(here, own, lambda word, node: word.bitwiseOR(bit(node % size)))

    open_ = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), row)
    boards_ = passages.select(F.col("graph_id").alias("room_id"), open_.alias("open"))
    return {
        "rooms": rooms.select("room_id", "seed"),
        "boards": boards_,
        "cells": fields.cells_of_boards(boards_, size),
        "ends": ends.select(
            F.col("graph_id").alias("room_id"), _block(F.col("start"), side, size).alias("start"), _block(F.col("goal"), side, size).alias("goal")
        ),
        "paths": paths,
        "solution": fields.steps_of_paths(paths),
    }


def mechanics(layout: dict[str, DataFrame], kind: str, size: int = 16) -> DataFrame:
    """Cells ``room_id, node, cell`` that a kind of room changes: ice, boxes, pits with floating floors, or a held wall with box and button."""

    def written(placed: DataFrame, cell: Column, node: str = "node") -> DataFrame:
        return placed.where(F.col(node).isNotNull()).select("room_id", F.col(node).alias("node"), cell.alias("cell"))

    if kind == "ice":
        return written(fields.frozen_cells(layout, size), F.lit("i"))
    if kind == "boxes":
        return written(fields.placed_boxes(layout, size), F.concat(F.lit(".+M"), F.col("i").cast("string")))
    if kind == "holes":
        holes = cut(fields.placed_holes(layout, size), "holes")
        # two pits may have the same spot as the nearest one; it holds one floor
        fillers = fields.hole_fillers(layout, holes, size).select("room_id", "filler").distinct()
        return written(holes, F.lit("+")).unionAll(written(fillers, F.lit(".+f"), "filler"))
    if kind == "orange":
        line = cut(fields.button_lines(layout, size), "lines")
        cells = {"wall": ".+O", "box": ".+M0", "button": ".+o"}
        return reduce(DataFrame.unionAll, [written(line, F.lit(cell), node) for node, cell in cells.items()])
    raise ValueError(f"rooms of type {kind!r} have no mechanics")


def generated_rooms(tries: DataFrame, size: int = 16) -> DataFrame:
    """``room_id, name, seed, type, layout, text`` of all tries (see :func:`planned_rooms`)."""
    plan = cut(planned_rooms(tries), "plan")
    field = fields.obstacle_fields(plan.where("layout = 'field'"), size)
    maze = maze_layouts(plan.where("layout = 'maze'"), size)
    layout = {part: cut(field[part].unionByName(maze[part]), part) for part in PARTS}
    changes = []
    for kind in TYPES[1:]:
        ids = plan.where(F.col("type") == kind).select("room_id")
        changes.append(mechanics({part: table.join(ids, "room_id", "left_semi") for part, table in layout.items()}, kind, size))
    levels = cells_level(fields.field_levels(layout, cut(reduce(DataFrame.unionAll, changes), "changes"), size))
    name = F.concat_ws("-", F.lit("gen"), "type", "layout", F.col("seed").cast("string"))
    return plan.join(levels, "room_id").select("room_id", name.alias("name"), "seed", "type", "layout", "text")
