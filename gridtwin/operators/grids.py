"""Grid graphs as tables: cells, edges, passage rows, walls and text drawings.

A corpus of graphs is ``nodes(graph_id, node)`` and ``edges(graph_id, a, b)``
with a < b. Cell ``node`` of a grid of ``width`` lies at
(node mod width, node div width).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from gridtwin.operators.drawings import WORD, drawn
from gridtwin.session import spread


def cell_x(node: Column, width: Column) -> Column:
    return F.pmod(node, width)


def cell_y(node: Column, width: Column) -> Column:
    return F.floor(node / width).cast("int")


def manhattan(a: Column, b: Column, width: Column) -> Column:
    return F.abs(cell_x(a, width) - cell_x(b, width)) + F.abs(cell_y(a, width) - cell_y(b, width))


def grid_nodes(params: DataFrame, *carry: str) -> DataFrame:
    """All cells of each grid (``graph_id, width, height`` and carried columns).

    A grid is one small row with many cells, so the rows are dealt to all cores first.
    """
    cells = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    dealt = spread(params.select("graph_id", "width", "height", *carry))
    return dealt.select("graph_id", "width", "height", *carry, cells.alias("node"))


def grid_edges(params: DataFrame, *carry: str) -> DataFrame:
    """Every pair of neighbouring cells once; ``edge_no`` numbers them within the grid."""
    node, width, height = F.col("node"), F.col("width"), F.col("height")
    steps = F.array(
        F.when(cell_x(node, width) < width - 1, F.struct((node + 1).alias("b"), (node * 2).alias("edge_no"))),
        F.when(cell_y(node, width) < height - 1, F.struct((node + width).alias("b"), (node * 2 + 1).alias("edge_no"))),
    )
    return (
        grid_nodes(params, *carry)
        .withColumn("step", F.explode(steps))
        .where(F.col("step").isNotNull())
        .select("graph_id", *carry, node.alias("a"), "step.b", "step.edge_no")
    )


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge as ``(graph_id, u, v)``."""
    both = F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    return edges.select("graph_id", F.explode(both).alias("arc")).select("graph_id", "arc.u", "arc.v")


def edges_from_rows(grids: DataFrame) -> DataFrame:
    """Edges out of the passage rows ``right[y][x]`` and ``down[y][x]``."""
    kinds = F.array(
        F.struct(F.lit(1).alias("step"), F.col("right").alias("rows")),
        F.struct(F.col("width").alias("step"), F.col("down").alias("rows")),
    )
    return (
        grids.select("graph_id", "width", F.explode(kinds).alias("kind"))
        .select("graph_id", "width", "kind.step", F.posexplode("kind.rows").alias("y", "row"))
        .select("graph_id", "width", "step", "y", F.posexplode("row").alias("x", "open"))
        .where(F.col("open") == 1)
        .withColumn("a", F.col("y") * F.col("width") + F.col("x"))
        .select("graph_id", "a", (F.col("a") + F.col("step")).alias("b"))
    )


def edge_words(edges: DataFrame) -> DataFrame:
    """Edges as bits: ``graph_id, step, _word, bits``, one row for those from 50 cells that lead ``step`` = b - a on."""
    a, b = F.col("a").cast("bigint"), F.col("b").cast("bigint")
    return (
        edges.where((a >= 0) & b.isNotNull())
        .groupBy("graph_id", (b - a).alias("step"), F.floor(a / WORD).cast("int").alias("_word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (a % WORD).cast("int"))).alias("bits"))
    )


def _with_sides(params: DataFrame, edges: DataFrame) -> DataFrame:
    """``params`` with ``_right`` and ``_down``: the open sides of each grid's cells, as arrays of words of 50 cells.

    Edges become bits before they are shuffled: a task sends a word per 50
    cells, not a row per edge, and the words of a grid meet in its row.
    """
    width = F.col("width")
    a, b = F.col("a"), F.col("b")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (a % WORD).cast("int"))
    side = lambda there: F.bit_or(F.when(there, bit).otherwise(F.lit(0).cast("bigint")))
    widths = params.select("graph_id", "width").distinct()
    words = (
        edges.join(widths, "graph_id")
        .where(a >= 0)
        .groupBy("graph_id", "width", F.floor(a / WORD).cast("int").alias("_word"))
        .agg(side(b == a + 1).alias("r"), side(b == a + width).alias("d"))
    )
    listed = words.groupBy("graph_id", "width").agg(F.collect_list(F.struct("_word", "r", "d")).alias("_words"))
    every = F.sequence(F.lit(0), F.floor((width * F.col("height") - 1) / WORD).cast("int"))
    none = F.array().cast("array<struct<_word: int, r: bigint, d: bigint>>")

    def filled(kind: str) -> Column:
        held = F.map_from_entries(F.transform(F.coalesce("_words", none), lambda w: F.struct(w["_word"], w[kind])))
        made = F.transform(F.array(held), lambda m: F.transform(every, lambda w: F.coalesce(F.try_element_at(m, w), F.lit(0).cast("bigint"))))
        return F.get(made, F.lit(0))

    joined = spread(params.join(listed, ["graph_id", "width"], "left"))
    return joined.withColumn("_right", filled("r")).withColumn("_down", filled("d")).drop("_words")


def _open(words: str, node: Column) -> Column:
    """1 where the cell's bit is set."""
    word = F.get(F.col(words), F.floor(node / WORD).cast("int"))
    return F.call_function("shiftright", word, (node % WORD).cast("int")).bitwiseAND(F.lit(1)).cast("int")


def open_sides(params: DataFrame, edges: DataFrame, *carry: str) -> DataFrame:
    """Each cell with ``right`` and ``down``: 1 where the passage to that side is open."""
    node, width = F.col("node"), F.col("width")
    sides = _with_sides(params.select("graph_id", "width", "height", *carry), edges)
    cells = F.explode(F.sequence(F.lit(0), width * F.col("height") - 1))
    return sides.withColumn("node", cells).select(
        "graph_id",
        "node",
        "width",
        "height",
        *carry,
        _open("_right", node).alias("right"),
        _open("_down", node).alias("down"),
        cell_x(node, width).alias("x"),
        cell_y(node, width).alias("y"),
    )


def rows_from_edges(params: DataFrame, edges: DataFrame) -> DataFrame:
    """Passage rows of each graph, the inverse of :func:`edges_from_rows`; cells of repeated rows are repeated in place."""
    width, height = F.col("width"), F.col("height")
    once = params.groupBy("graph_id", "width", "height").agg(F.count("*").cast("int").alias("_times"))

    def rows(words: str) -> Column:
        def cell(y: Column, x: Column) -> Column:
            return F.array_repeat(_open(words, y * width + x), F.col("_times"))

        across = F.sequence(F.lit(0), width - 1)
        return F.transform(
            F.sequence(F.lit(0), height - 1),
            lambda y: F.when(F.col("_times") == 1, F.transform(across, lambda x: _open(words, y * width + x))).otherwise(
                F.flatten(F.transform(across, lambda x: cell(y, x)))
            ),
        )

    return _with_sides(once, edges).select(
        "graph_id", "width", "height", rows("_right").alias("right"), rows("_down").alias("down")
    )


def count_passages(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id").agg(F.count("*").alias("passages"))


def wall_segments(params: DataFrame, edges: DataFrame) -> DataFrame:
    """Walls of each maze: ``h`` above cell (x, y), ``v`` left of it, borders included.

    Row ``height`` and column ``width`` are the lower and right border.
    """
    x, y = F.col("x"), F.col("y")
    slots = F.array(
        F.when(y == 0, F.struct(F.lit("h").alias("kind"), x.alias("x"), y.alias("y"))),
        F.when(x == 0, F.struct(F.lit("v").alias("kind"), x.alias("x"), y.alias("y"))),
        F.when(F.col("down") == 0, F.struct(F.lit("h").alias("kind"), x.alias("x"), (y + 1).alias("y"))),
        F.when(F.col("right") == 0, F.struct(F.lit("v").alias("kind"), (x + 1).alias("x"), y.alias("y"))),
    )
    return (
        open_sides(params, edges)
        .select("graph_id", F.explode(F.filter(slots, lambda s: s.isNotNull())).alias("slot"))
        .select("graph_id", "slot.*")
    )


def text_rows(
    params: DataFrame,
    edges: DataFrame,
    path: DataFrame | None = None,
    wall: str = "#",
    floor: str = ".",
    start: str = "S",
    goal: str = "G",
    mark: str = "*",
) -> DataFrame:
    """Block drawing, (2h+1) lines of (2w+1) characters: ``graph_id, line, text``.

    ``params`` also has ``start`` and ``goal`` cells. ``path(graph_id, k,
    node)`` is drawn over floor and passages with ``mark``. Grid, passages and
    path of a graph meet as one row and are drawn by a kernel; no cell is listed.
    """
    grid = F.struct("width", "height", "start", "goal")
    every = params.groupBy("graph_id").agg(F.collect_list(grid).alias("_all"))
    words = edge_words(edges).groupBy("graph_id").agg(F.collect_list(F.struct("step", "_word", "bits")).alias("_words"))
    steps = F.lit(None).cast("array<struct<k: bigint, node: bigint>>")
    met = every.join(words.hint("merge"), "graph_id", "left")
    if path is not None:
        number = lambda c: F.col(c).cast("bigint").alias(c)
        ways = path.groupBy("graph_id").agg(F.collect_list(F.struct(number("k"), number("node"))).alias("_path"))
        met = met.join(ways.hint("merge"), "graph_id", "left")
        steps = F.col("_path")
    rows = met.select(
        "graph_id",
        F.get("_all", F.lit(0)).alias("_one"),
        F.when(F.size("_all") > 1, F.col("_all")).alias("_others"),
        "_words",
        steps.alias("_path"),
    ).select("graph_id", "_one.*", "_others", "_words", "_path")
    signs = (floor, wall, start, goal, mark)
    schema = StructType([rows.schema["graph_id"], *StructType.fromDDL("line int, text string")])
    return spread(rows).mapInArrow(drawn(signs), schema)


def whole_text(rows: DataFrame) -> DataFrame:
    """Join the lines of each drawing."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    return rows.groupBy("graph_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"))
