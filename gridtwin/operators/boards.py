"""Grids as bit boards: distances, paths and components of each row, without a shuffle.

A board is an array of longs with a bit per cell: each row of a grid takes
``ceil(width / 50)`` words of 50 cells. ``right`` and ``down`` hold the open
passages of each cell to its neighbours. Floods and connected parts are made by the
kernels of :mod:`gridtwin.operators.lattice`, on many rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from gridtwin.operators.drawings import WORD, boards_of_words
from gridtwin.operators.grids import cell_x, cell_y
from gridtwin.operators.lattice import cells_of_rows, floods, parts, with_column
from gridtwin.session import spread


def _left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits.cast("int"))


def _and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_words(width: Column) -> Column:
    """Words a row of cells takes."""
    return F.ceil(width / WORD).cast("int")


def word_of(node: Column, width: Column) -> Column:
    return (cell_y(node, width) * row_words(width) + F.floor(cell_x(node, width) / WORD)).cast("int")


def bit_of(node: Column, width: Column) -> Column:
    """The bit of a cell within its word."""
    return _left(_long(1), cell_x(node, width) % WORD)


def holds(board: Column, node: Column, width: Column) -> Column:
    """Whether a cell is on a board; false for cells outside the grid."""
    return F.coalesce(_and(F.get(board, word_of(node, width)), bit_of(node, width)) != 0, F.lit(False))


def number_at(cells: Column, node: Column) -> Column:
    """What an array with an entry per cell holds for ``node``."""
    return F.get(cells, node.cast("int"))


def distance_to(flooded: Column, node: Column, width: Column) -> Column:
    """Steps to a cell, -1 if it was not reached."""
    return F.coalesce(number_at(flooded, node), F.lit(-1))


def path_to(flooded: Column, node: Column, right: Column, down: Column, width: Column) -> Column:
    """Cells of a shortest path to ``node``, the smallest previous cell first among equals; null if it was not reached."""

    def back(path: Column, k: Column) -> Column:
        def before(here: Column) -> Column:
            def fits(cell: Column, passages: Column, owner: Column) -> Column:
                return F.coalesce(number_at(flooded, cell) == k, F.lit(False)) & holds(passages, owner, width)

            up, left = here - width, here - 1
            return (
                F.when(fits(up, down, up), up)
                .when(fits(left, right, left), left)
                .when(fits(here + 1, right, here), here + 1)
                .otherwise(here + width)
                .cast("int")
            )

        return F.concat(path, F.array(let(F.element_at(path, -1), before)))

    def walk(far: Column) -> Column:
        steps = F.when(far > 0, F.sequence(far - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        cells = F.aggregate(steps, F.array(node.cast("int")), back)
        return F.when(far >= 0, F.reverse(cells))

    return let(distance_to(flooded, node, width), walk)


def farthest_cell(flooded: Column, width: Column) -> Column:
    """The smallest of the cells at the largest distance."""
    return (F.array_position(flooded, F.array_max(flooded)) - 1).cast("int")


# --- tables ---------------------------------------------------------------------------
def boards_of_edges(grids: DataFrame, edges: DataFrame, *carry: str) -> DataFrame:
    """``graph_id, width, height, words, right, down`` of each grid (and ``carry``), from its edges (graph_id, a, b).

    Edges join neighbouring cells, a < b; repeated ones count once. Grids
    without edges have empty boards. The words of a grid (a few hundred at
    most) meet in one row; edges meet by word of 50 cells first, so no task holds all edges
    of a group and no edge meets its grid's size. A kernel makes the boards of many grids.
    """
    a, b = F.col("a").cast("bigint"), F.col("b").cast("bigint")
    bit = F.call_function("shiftleft", _long(1), (a % WORD).cast("int"))
    to_right = b == a + 1
    words = (
        edges.where(a >= 0)
        .groupBy("graph_id", F.floor(a / WORD).cast("int").alias("_word"))
        .agg(
            F.bit_or(F.when(to_right, bit).otherwise(_long(0))).alias("r"),
            F.bit_or(F.when(~to_right, bit).otherwise(_long(0))).alias("d"),
        )
    )
    listed = words.groupBy("graph_id").agg(F.collect_list(F.struct("_word", "r", "d")).alias("_words"))
    rows = spread(grids.select("graph_id", "width", "height", *carry).join(listed.hint("merge"), "graph_id", "left"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("words int, right array<bigint>, down array<bigint>")])
    return rows.mapInArrow(boards_of_words, schema)


def boards_of_open(open_: Column) -> tuple[Column, Column]:
    """``right`` and ``down`` boards between neighbouring open cells (rows of one word)."""
    right = F.transform(open_, lambda w: w.bitwiseAND(F.shiftright(w, 1)))
    down = F.transform(open_, lambda w, i: w.bitwiseAND(F.coalesce(F.get(open_, i + 1), _long(0))))
    return right, down


def with_flood(boards: DataFrame, start: Column) -> DataFrame:
    """The boards with ``flood``: the steps from each one's start cell to every cell, -1 where there is no way; null without a start."""
    made = with_column(
        boards.withColumn("_start", start), "flood", ArrayType(IntegerType()), lambda block: floods(block, "_start", WORD), cells_of_rows
    )
    return made.drop("_start")


def _each_cell(boards: DataFrame, values: Column, *keys: str) -> DataFrame:
    """``keys, node, number`` of all cells."""
    return boards.select(*keys, F.posexplode(values).alias("node", "number"))


def distances(flooded: DataFrame, *keys: str) -> DataFrame:
    """``keys, node, dist`` of all cells reached."""
    return all_distances(flooded, *keys).where(F.col("dist") >= 0)


def all_distances(flooded: DataFrame, *keys: str) -> DataFrame:
    """``keys, node, dist`` of all cells, -1 for those not reached; null in grids without a start."""
    unknown = F.array_repeat(F.lit(None).cast("int"), F.col("width") * F.col("height"))
    return _each_cell(flooded, F.coalesce("flood", unknown), *keys).withColumnRenamed("number", "dist")


def with_parts(boards: DataFrame) -> DataFrame:
    """The boards with ``_parts``: the connected parts, numbered in order of their smallest cell.

    ``number`` of each cell's part, ``sizes`` and ``lows`` (the smallest cell) of the parts.
    """
    whole = ArrayType(IntegerType())
    kind = StructType([StructField("number", whole), StructField("sizes", whole), StructField("lows", whole)])
    return with_column(boards, "_parts", kind, lambda block: parts(block, WORD), cells_of_rows)


def solve(boards: DataFrame) -> DataFrame:
    """Solvability between ``start`` and ``goal`` of each board, all within the row.

    solvable, path_length and path (null when unsolvable), component_sizes in
    order of the first cell, and the part (numbered in that order) of both ends.
    """
    width = F.col("width")
    path = path_to(F.col("flood"), F.col("goal"), F.col("right"), F.col("down"), width)
    return (
        with_parts(with_flood(boards, F.col("start")))
        .select(
            "graph_id",
            F.col("_parts.sizes").alias("component_sizes"),
            number_at(F.col("_parts.number"), F.col("start")).alias("start_component"),
            number_at(F.col("_parts.number"), F.col("goal")).alias("goal_component"),
            path.alias("path"),
        )
        .withColumns(
            {"path_length": F.size("path") - 1, "solvable": F.col("start_component") == F.col("goal_component")}
        )
        .withColumn("path_length", F.when(F.col("path").isNotNull(), F.col("path_length")))
    )


def components(boards: DataFrame) -> DataFrame:
    """``graph_id, node, component``: the smallest cell connected to each cell of each board."""
    found = with_parts(boards).select("graph_id", F.col("_parts.lows").alias("_lows"), F.col("_parts.number").alias("_number"))
    return _each_cell(found, F.col("_number"), "graph_id", "_lows").select(
        "graph_id", "node", F.get("_lows", F.col("number")).alias("component")
    )


def component_sizes(boards: DataFrame) -> DataFrame:
    """``graph_id, component, size`` of each board's parts, without its cells."""
    part = F.arrays_zip(F.col("_parts.lows").alias("component"), F.col("_parts.sizes").alias("size"))
    return with_parts(boards).select("graph_id", F.explode_outer(part).alias("_part")).select("graph_id", "_part.component", "_part.size")
