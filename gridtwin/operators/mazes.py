"""Whole maze objects: one row per member of a pair, with parameters, passage rows and metadata.

Field names, and the order of coordinates (x, y), are those of the exchanged files
(``schemas.MAZE``). An object holds at most 100x100 cells, so its lists are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtwin import VERSION
from gridtwin.operators import boards, minimal_pairs
from gridtwin.operators.grids import cell_x, cell_y

# corpus columns that go with an object
PLACED = ("id", "split", "idx")


def point(cell: Column, width: Column) -> Column:
    return F.when(cell.isNotNull(), F.array(cell_x(cell, width).cast("int"), cell_y(cell, width).cast("int")))


def points(cells: Column, width: Column) -> Column:
    return F.transform(cells, lambda cell: point(cell, width))


def _edge(edge: Column, width: Column) -> Column:
    return F.when(edge.isNotNull(), F.array(point(edge["a"], width), point(edge["b"], width)))


def _rows(board: Column, closed: Column, opened: Column) -> Column:
    """A board as rows of 0 and 1, with one cell's passage closed and one opened (null: none)."""
    width, height = F.col("width"), F.col("height")

    def cell(node: Column) -> Column:
        open_ = F.when(node.eqNullSafe(closed), F.lit(False)).when(node.eqNullSafe(opened), F.lit(True))
        return open_.otherwise(boards.holds(board, node, width)).cast("int")

    across = F.sequence(F.lit(0), width - 1)
    return F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.transform(across, lambda x: cell(y * width + x)))


def params_object(algorithm: Column) -> Column:
    """Parameters as they are written; ``cut`` is a word or a number, as a VARIANT."""
    mode = F.col("cut_mode")
    word_or_number = F.when(mode == "fixed", F.col("cut_pos").cast("variant")).otherwise(mode.cast("variant"))
    return F.struct(
        "width",
        "height",
        F.col("seed").cast("bigint").alias("seed"),
        algorithm.alias("algorithm"),
        "placement",
        F.col("min_distance").alias("minDistance"),
        word_or_number.alias("cut"),
        F.col("loops").cast("int").alias("loops"),
    )


def maze_objects(pairs: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """The members ``wanted(graph_id, solvable, ...)`` of ``pairs`` (see ``build_pairs``) as whole objects.

    Columns of ``wanted`` named in ``PLACED`` stay, others are dropped.
    ``params`` of the pairs may lack ``algorithm``, which is the default one then.

    Each pair is flooded once, on the boards of its solvable member; the
    unsolvable one has the same boards but for the cut and the opened edge.
    Loop edges are in order of their cells, the tree path from start to goal.
    """
    width, height = F.col("width"), F.col("height")
    pairs = {
        name: table.join(wanted.select("graph_id"), "graph_id", "left_semi")
        for name, table in pairs.items()
        if name in ("params", "ends", "path", "chosen", "passages")
    }
    params = pairs["params"]
    algorithm = F.col("algorithm") if "algorithm" in params.columns else F.lit(minimal_pairs.DEFAULTS["algorithm"])
    params = params.select("graph_id", "seed", "width", "height", params_object(algorithm).alias("params"))
    tree_path = pairs["path"].groupBy("graph_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda step: step["node"]).alias("_way")
    )
    edge = F.struct("a", "b")
    of_kind = lambda kind: F.when(F.col("kind") == kind, edge)
    kinds = pairs["passages"].groupBy("graph_id").agg(
        F.array_sort(F.collect_list(of_kind("loop"))).alias("_loops"),
        F.max(of_kind("cut")).alias("_cut"),
        F.max(of_kind("opened")).alias("_opened"),
        F.count_if(F.col("kind") != "opened").alias("_passages"),
    )
    chosen = pairs["chosen"].select(
        "graph_id",
        F.col("k").cast("int").alias("_k"),
        F.struct(F.col("near").alias("a"), F.col("far").alias("b")).alias("_cut_way"),
        F.array(F.col("start_side").cast("int"), F.col("goal_side").cast("int")).alias("_sides"),
    )
    solved = minimal_pairs.members(pairs["passages"]).where("solvable").select("graph_id", "a", "b")
    facts = (
        params.join(pairs["ends"].select("graph_id", "start", "goal"), "graph_id")
        .join(tree_path, "graph_id")
        .join(kinds, "graph_id")
        .join(chosen, "graph_id")
    )
    carried = [c for c in facts.columns if c not in ("graph_id", "width", "height")]
    flooded = boards.with_flood(boards.boards_of_edges(facts, solved, *carried), F.col("start"))
    solution = boards.path_to(F.col("flood"), F.col("goal"), F.col("right"), F.col("down"), width)
    each = flooded.withColumn("_solution", solution).drop("flood").join(
        wanted.select("graph_id", "solvable", *[c for c in PLACED if c in wanted.columns]), "graph_id"
    )

    solvable, cut, opened = F.col("solvable"), F.col("_cut"), F.col("_opened")
    walls_balanced = opened.isNotNull()

    def rows(side: str, step: Column) -> Column:
        moved = lambda e: F.when(~solvable & (e["b"] - e["a"] == step), e["a"])
        return _rows(F.col(side), moved(cut), moved(opened))

    unsolvable_passages = F.col("_passages") - 1 + walls_balanced.cast("int")
    meta = F.struct(
        F.col("params.algorithm").alias("algorithm"),
        F.col("params.placement").alias("placement"),
        F.col("params.cut").alias("cut"),
        F.col("params.loops").alias("loopsRequested"),
        F.size("_loops").alias("loops"),
        (F.size("_way") - 1).alias("treePathLength"),
        points(F.col("_way"), width).alias("treePath"),
        _edge(F.col("_cut_way"), width).alias("cutEdge"),
        F.col("_k").alias("cutIndex"),
        _edge(opened, width).alias("openedEdge"),
        F.transform("_loops", lambda e: _edge(e, width)).alias("loopEdges"),
        F.col("_sides").alias("componentSizes"),
        (F.array_min("_sides") / (width * height)).alias("pocketFrac"),
        F.when(solvable, F.col("_passages")).otherwise(unsolvable_passages).cast("int").alias("passages"),
        walls_balanced.alias("wallsBalanced"),
        F.when(solvable, F.size("_solution") - 1).alias("solutionLength"),
        F.when(solvable, points(F.col("_solution"), width)).alias("solution"),
    )
    return each.select(
        *[c for c in PLACED if c in wanted.columns],
        F.lit(VERSION).alias("version"),
        "width",
        "height",
        F.col("seed").cast("bigint").alias("seed"),
        "params",
        "solvable",
        point(F.col("start"), width).alias("start"),
        point(F.col("goal"), width).alias("goal"),
        rows("right", F.lit(1)).alias("right"),
        rows("down", width).alias("down"),
        meta.alias("meta"),
    )


def label_rows(objects: DataFrame) -> DataFrame:
    """The label table of placed objects, in the column order of ``schemas.LABEL``."""
    at = lambda name, i: F.get(F.col(name), F.lit(i))
    return objects.select(
        "id",
        "seed",
        F.col("solvable").cast("int").alias("solvable"),
        "split",
        F.col("idx").alias("pair"),
        "width",
        "height",
        F.col("meta.treePathLength").alias("tree_path_length"),
        F.col("meta.solutionLength").alias("solution_length"),
        F.bround("meta.pocketFrac", 4).alias("pocket_frac"),
        F.array_min("meta.componentSizes").alias("component_min"),
        F.col("meta.loops").alias("loops"),
        F.col("meta.cutIndex").alias("cut_index"),
        at("start", 0).alias("start_x"),
        at("start", 1).alias("start_y"),
        at("goal", 0).alias("goal_x"),
        at("goal", 1).alias("goal_y"),
    )
