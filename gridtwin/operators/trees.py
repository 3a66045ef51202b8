"""Rooted trees of many graphs in a logarithmic number of rounds.

A tree is walked once around (every edge in both directions), the walk is
ranked by pointer doubling, and every tree question becomes a comparison of
positions on that walk: no round per tree level, however deep the trees are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtwin.operators import lattice
from gridtwin.operators.grids import symmetric
from gridtwin.session import cut_counting


def _arc(u: Column, v: Column) -> Column:
    return F.shiftleft(u.cast("bigint"), 32).bitwiseOR(v.cast("bigint"))


def rooted(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Each node of each tree with parent, enter, leave, depth and subtree size.

    ``roots(graph_id, root)``. ``enter`` and ``leave`` are the positions on
    the walk where the node's subtree begins and ends, so u is an ancestor of
    v (or v itself) if u.enter <= v.enter and u.leave >= v.leave. Nodes are
    numbers below 2^31; the neighbours of one node are sorted together, so
    the degree should be small, as on grids. Where every tree is small and has one
    root, a tree is walked inside a task and only shuffled once.
    """
    if lattice.all_small(tree) and roots.groupBy("graph_id").count().where((F.col("count") > 1) | F.col("graph_id").isNull()).isEmpty():
        rows = tree.select("graph_id", "a", "b").join(roots.select("graph_id", "root").where(F.col("root").isNotNull()), "graph_id")
        return lattice.in_order(rows).mapInArrow(
            lattice.walks, "graph_id bigint, node int, parent int, enter bigint, leave bigint, depth bigint, size bigint"
        )
    at_node = Window.partitionBy("graph_id", "v").orderBy("u")
    around = Window.partitionBy("graph_id", "v")
    arcs = (
        symmetric(tree)
        .withColumn("_following", F.lead("u").over(at_node))
        .withColumn("_first", F.min("u").over(around))
        .join(roots.select("graph_id", "root"), "graph_id")
        .withColumn("_turn", F.coalesce("_following", F.when(F.col("v") != F.col("root"), F.col("_first"))))
        .select(
            "graph_id",
            "u",
            "v",
            _arc(F.col("u"), F.col("v")).alias("arc"),
            F.when(F.col("_turn").isNotNull(), _arc(F.col("v"), F.col("_turn"))).alias("next"),
        )
        .withColumn("left", F.col("next").isNotNull().cast("bigint"))
    )
    ranked, open_ends = cut_counting(arcs, F.col("next").isNotNull(), "walk")
    while open_ends:
        # each round triples the distance looked ahead
        onward = ranked.select(
            "graph_id", F.col("arc").alias("next"), F.col("next").alias("_second"), F.col("left").alias("_left2")
        )
        beyond = ranked.select(
            "graph_id", F.col("arc").alias("_second"), F.col("next").alias("_third"), F.col("left").alias("_left3")
        )
        looked = (
            ranked.join(onward, ["graph_id", "next"], "left")
            .join(beyond, ["graph_id", "_second"], "left")
            .select(
                "graph_id",
                "u",
                "v",
                "arc",
                F.col("_third").alias("next"),
                (F.col("left") + F.coalesce("_left2", F.lit(0)) + F.coalesce("_left3", F.lit(0))).alias("left"),
            )
        )
        ranked, open_ends = cut_counting(looked, F.col("next").isNotNull(), "walk")
    # a node is entered and left over the same edge: both passes of an edge meet in one group
    low, high = F.least("u", "v"), F.greatest("u", "v")
    passes = ranked.groupBy("graph_id", low.alias("_low"), high.alias("_high")).agg(
        F.max(F.struct("left", "u", "v")).alias("_in"), F.min("left").alias("_out")
    )
    below = passes.select(
        "graph_id",
        F.col("_in.v").alias("node"),
        F.col("_in.u").alias("parent"),
        F.col("_in.left").alias("_in_left"),
        F.col("_out").alias("_out_left"),
    )
    whole = ranked.groupBy("graph_id").agg(F.count("*").alias("_arcs"))
    in_order = Window.partitionBy("graph_id").orderBy("enter")
    children = below.join(whole, "graph_id").select(
        "graph_id",
        "node",
        "parent",
        (F.col("_arcs") - F.col("_in_left")).alias("enter"),
        (F.col("_arcs") - F.col("_out_left")).alias("leave"),
    )
    # of the first ``enter`` passes, those that go down number one per node entered so far
    children = children.withColumn("depth", 2 * F.row_number().over(in_order) - F.col("enter")).withColumn(
        "size", ((F.col("leave") - F.col("enter") + 1) / 2).cast("bigint")
    )
    tops = roots.join(whole, "graph_id").select(
        "graph_id",
        F.col("root").alias("node"),
        F.lit(None).cast("int").alias("parent"),
        F.lit(0).cast("bigint").alias("enter"),
        (F.col("_arcs") + 1).alias("leave"),
        F.lit(0).cast("bigint").alias("depth"),
        (F.col("_arcs") / 2 + 1).cast("bigint").alias("size"),
    )
    return children.select(*tops.columns).unionAll(tops)


def tree_paths(nodes: DataFrame, goals: DataFrame) -> DataFrame:
    """The way from the root to the goal of each tree: ``graph_id, k, node, parent, enter, leave, size``.

    ``nodes`` comes from :func:`rooted`, ``goals(graph_id, goal)``.
    """
    # nodes may be listed from short rows, and Spark would think them few
    at_goal = (
        nodes.join(goals.select("graph_id", F.col("goal").alias("node")).hint("merge"), ["graph_id", "node"])
        .select("graph_id", F.col("enter").alias("_enter"), F.col("leave").alias("_leave"))
    )
    return (
        nodes.join(at_goal.hint("merge"), "graph_id")
        .where((F.col("enter") <= F.col("_enter")) & (F.col("leave") >= F.col("_leave")))
        .select("graph_id", F.col("depth").alias("k"), "node", "parent", "enter", "leave", "size")
    )


def cut_sizes(path: DataFrame) -> DataFrame:
    """Every cut of the tree path: edge k joins path cells k and k+1.

    ``start_side`` and ``goal_side`` are the component sizes after removing it.
    """
    whole = Window.partitionBy("graph_id")
    return (
        path.withColumn("_cells", F.max("size").over(whole))
        .withColumn("path_length", F.max("k").over(whole))
        .where(F.col("k") > 0)
        .select(
            "graph_id",
            (F.col("k") - 1).alias("k"),
            F.col("parent").alias("near"),
            F.col("node").alias("far"),
            (F.col("_cells") - F.col("size")).alias("start_side"),
            F.col("size").alias("goal_side"),
            "enter",
            "leave",
            "path_length",
        )
    )
