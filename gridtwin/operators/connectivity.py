"""Spanning forests, components, distances and paths of many graphs at once.

All graphs of a corpus go through the same rounds of joins; nothing loops over
graphs. Every round ends in a written table, so lineage stays short and a lost
executor costs one round at most.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtwin.operators import lattice
from gridtwin.operators.grids import symmetric
from gridtwin.session import cut, cut_counting, cut_observing

SHRINK_EVERY = 12

#: Edges a node from which the forest of a sample is worth its rounds, and the steps of the sample's share.
DENSE = 8
DRAWS = 1 << 30


def _roots(pointers: DataFrame) -> tuple[DataFrame, int]:
    """Follow ``(graph_id, c) -> p`` to the end, tripling the stride each round; roots point at themselves.

    Only pointers that have not come to a root go into the next round; the others
    are looked up there, but never moved or written again. Also returns the number
    of pointers.
    """
    pointers, count = cut_counting(pointers, label="pointers")
    here = F.col("p") == F.col("c")
    finished, active = [pointers.where(here)], pointers.where(~here)
    left = count
    while left:
        target = reduce(DataFrame.unionAll, [*finished, active])
        second = target.select("graph_id", F.col("c").alias("p"), F.col("p").alias("_second"))
        third = target.select("graph_id", F.col("c").alias("_second"), F.col("p").alias("_third"))
        onward = (
            active.join(second, ["graph_id", "p"])
            .join(third, ["graph_id", "_second"])
            .select("graph_id", "c", F.col("_third").alias("p"), (F.col("_third") != F.col("p")).alias("moved"))
        )
        written, left = cut_counting(onward, F.col("moved"), "pointers")
        finished.append(written.where(~F.col("moved")).select("graph_id", "c", "p"))
        active = written.where("moved").select("graph_id", "c", "p")
    return reduce(DataFrame.unionAll, finished), count


def _relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Replace both end labels and drop edges inside one component."""
    at_a = roots.select("graph_id", F.col("c").alias("ca"), F.col("p").alias("_pa"))
    at_b = roots.select("graph_id", F.col("c").alias("cb"), F.col("p").alias("_pb"))
    kept = [c for c in edges.columns if c not in ("graph_id", "ca", "cb")]
    return (
        edges.join(at_a, ["graph_id", "ca"])
        .join(at_b, ["graph_id", "cb"])
        .where(F.col("_pa") != F.col("_pb"))
        .select("graph_id", F.col("_pa").alias("ca"), F.col("_pb").alias("cb"), *kept)
    )


def _ends(edges: DataFrame, *kept: str) -> DataFrame:
    both = F.array(
        F.struct(F.col("ca").alias("c"), F.col("cb").alias("other")),
        F.struct(F.col("cb").alias("c"), F.col("ca").alias("other")),
    )
    return edges.select("graph_id", *kept, F.explode(both).alias("end")).select("graph_id", *kept, "end.c", "end.other")


def spanning_forest(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Minimum spanning forest of every graph (ties by a, then b).

    Each round every component takes its lightest outgoing edge, and the
    components joined that way become one, so the number of components at
    least halves and only edges between components go on. With many more edges than
    nodes most edges never enter the rounds: edges dealt by one end are looked at in
    blocks, whose forests rule out all others where a block has fewer nodes than
    edges. If many are left, the forest of a sample of the edges
    rules out each edge that is heavier than the sample's whole way between its
    ends, which leaves few more edges than the sample has.

    Where every graph is small the rounds are done inside the tasks: the edges are
    shuffled once, and no round is written.
    """
    whole = ["graph_id", "a", "b"]
    kinds = {edges.schema[c].dataType.typeName() for c in whole}
    if kinds <= {"integer", "long"} and lattice.all_small(edges):
        return lattice.in_order(edges.select(*whole, weight)).mapInArrow(lattice.forests, edges.select(*whole).schema)
    columns = ["graph_id", F.col("a").alias("ca"), F.col("b").alias("cb"), weight, "a", "b"]
    at_a, at_b = F.xxhash64("graph_id", "ca"), F.xxhash64("graph_id", "cb")
    live, seen = cut_observing(
        edges.select(*columns),
        "edges",
        edges=F.count("*"),
        at_a=F.approx_count_distinct(at_a),
        at_b=F.approx_count_distinct(at_b),
        nulls=F.count_if(reduce(Column.__or__, [F.col(c).isNull() for c in (*whole, weight)])),
    )
    count, nodes = seen["edges"], seen["at_a"] + seen["at_b"]
    exact = kinds <= {"integer", "long"} and edges.schema[weight].dataType.typeName() in ("double", "float", "integer")
    if count > DENSE * nodes and exact and not seen["nulls"]:
        live, count = _thinned(live, count, seen["at_a"], seen["at_b"])
    if count > DENSE * nodes:
        share = math.sqrt(nodes / count)
        drawn = F.pmod(F.xxhash64("graph_id", "a", "b", F.lit("sample")), F.lit(DRAWS)) < int(share * DRAWS)
        ways = _ways(_contract(live.where(drawn), weight))
        live = cut(_without_heaviest(live, ways, weight), "edges")
    taken = [level.select("graph_id", "a", "b").distinct() for level, _ in _contract(live, weight)]
    if not taken:
        return edges.select("graph_id", "a", "b").limit(0)
    return reduce(DataFrame.unionAll, taken)


def _thinned(live: DataFrame, count: int, at_a: int, at_b: int) -> tuple[DataFrame, int]:
    """Edges in the forest of their block, and their number; all of them where blocks would have too many nodes to rule out half.

    They are dealt by the end with more nodes, so a block meets few of those and at most all nodes of the other end.
    """
    tasks = max(-(-count // lattice.BLOCK_EDGES), 2 * live.sparkSession.sparkContext.defaultParallelism)
    if 2 * (max(at_a, at_b) + tasks * min(at_a, at_b)) > count:
        return live, count
    dealt = live.repartition(tasks, "graph_id", "ca" if at_a > at_b else "cb")
    return cut_counting(dealt.mapInArrow(lattice.thinned, live.schema), label="edges")


def _contract(live: DataFrame, weight: str) -> list[tuple[DataFrame, DataFrame]]:
    """Per round, the lightest edge of each component, and the component each went into."""
    levels = []
    while True:
        lightest = _ends(live, weight, "a", "b").where(F.col("c") != F.col("other")).groupBy("graph_id", "c").agg(
            F.min(F.struct(weight, "a", "b", F.col("other").alias("p"))).alias("best")
        )
        lightest, found = cut_counting(
            lightest.select("graph_id", "c", "best.a", "best.b", "best.p", F.col(f"best.{weight}").alias("weight")), label="lightest"
        )
        if not found:
            return levels
        # two components may take the same edge; the smaller one becomes the root
        mates = lightest.select("graph_id", F.col("c").alias("p"), F.col("p").alias("_pp"))
        pointers = lightest.join(mates, ["graph_id", "p"]).select(
            "graph_id",
            "c",
            F.when((F.col("_pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"),
        )
        roots = _roots(pointers)[0]
        levels.append((lightest, roots))
        live = cut(_relabel(live, roots), "edges")


def _ways(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame | None:
    """``graph_id, c, way`` of each node: round by round its new component and the edge its old one took to get there."""
    ways = None
    for lightest, roots in reversed(levels):
        step = roots.join(lightest.select("graph_id", "c", F.struct("weight", "a", "b").alias("edge")), ["graph_id", "c"])
        step = step.select("graph_id", "c", "p", F.array(F.struct("p", "edge")).alias("way"))
        if ways is not None:
            later = ways.select("graph_id", F.col("c").alias("p"), F.col("way").alias("_later"))
            step = step.join(later, ["graph_id", "p"], "left").withColumn(
                "way", F.when(F.col("_later").isNull(), F.col("way")).otherwise(F.concat("way", "_later"))
            )
        ways = step.select("graph_id", "c", "way")
    return None if ways is None else cut(ways, "ways")


def _without_heaviest(live: DataFrame, ways: DataFrame | None, weight: str) -> DataFrame:
    """Edges not heavier than every edge of the forest's path between their ends, or between parts it does not connect.

    The heaviest edge of a path in a forest is the heaviest one that the components
    of its two ends took until they were one, so two short lists decide on an edge.
    """
    if ways is None:
        return live
    at_a = ways.select("graph_id", F.col("c").alias("ca"), F.col("way").alias("_wa"))
    at_b = ways.select("graph_id", F.col("c").alias("cb"), F.col("way").alias("_wb"))
    rounds = F.least(F.size("_wa"), F.size("_wb"))
    met = F.array_position(F.transform(F.arrays_zip("_wa", "_wb"), lambda s: s["_wa"]["p"] == s["_wb"]["p"]), True)
    path = F.concat(F.slice("_wa", 1, met.cast("int")), F.slice("_wb", 1, met.cast("int")))
    heaviest = F.array_max(F.transform(path, lambda s: s["edge"]))
    apart = F.coalesce((met == 0) | (rounds <= 0), F.lit(True))
    own = F.struct(F.col(weight).alias("weight"), "a", "b")
    return (
        live.join(at_a, ["graph_id", "ca"], "left")
        .join(at_b, ["graph_id", "cb"], "left")
        .where((F.col("ca") != F.col("cb")) & (apart | (own <= heaviest)))
        .select(live.columns)
    )


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``graph_id, node, component``: the smallest node connected to each node.

    Each round every component points at its smallest neighbour if that is
    smaller than itself; the graph of components shrinks until no edge is left.
    """
    live = cut(
        edges.where(F.col("a") != F.col("b"))
        .select("graph_id", F.col("a").alias("ca"), F.col("b").alias("cb"))
        .distinct(),
        "edges",
    )
    rounds: list[DataFrame] = []
    while True:
        pointers = _ends(live).groupBy("graph_id", "c").agg(F.min("other").alias("p")).select(
            "graph_id", "c", F.least("c", "p").alias("p")
        )
        roots, count = _roots(pointers)
        if not count:
            break
        rounds.append(roots)
        live = cut(_relabel(live, roots).distinct(), "edges")
    labels = None
    for roots in reversed(rounds):
        if labels is None:
            labels = roots
        else:
            later = labels.select("graph_id", F.col("c").alias("p"), F.col("p").alias("_later"))
            labels = roots.join(later, ["graph_id", "p"], "left").select(
                "graph_id", "c", F.coalesce("_later", "p").alias("p")
            )
    if labels is None:
        return nodes.select("graph_id", "node", F.col("node").alias("component"))
    found = labels.select("graph_id", F.col("c").alias("node"), F.col("p").alias("component"))
    return nodes.select("graph_id", "node").join(found, ["graph_id", "node"], "left").select(
        "graph_id", "node", F.coalesce("component", "node").alias("component")
    )


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("graph_id", "component").agg(F.count("*").alias("size"))


def distances(edges: DataFrame, sources: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Steps from the source of each graph, level by level: ``graph_id, node, dist``.

    A neighbour of level d lies in level d-1, d or d+1, so a round only looks
    at the last two levels, never at all visited nodes. With ``nodes`` the
    unreachable ones are reported as -1.
    """
    arcs = cut(symmetric(edges), "arcs")

    def neighbours(level: DataFrame, before: DataFrame, depth: int) -> DataFrame:
        seen = level.unionAll(before).select("graph_id", "node")
        return (
            level.select("graph_id", F.col("node").alias("u"))
            .join(arcs, ["graph_id", "u"])
            .select("graph_id", F.col("v").alias("node"))
            .distinct()
            .join(seen, ["graph_id", "node"], "left_anti")
            .withColumn("dist", F.lit(depth))
        )

    level = cut(sources.select("graph_id", "node", F.lit(0).alias("dist")), "level")
    before = level.limit(0)
    finished: list[DataFrame] = []
    recent, done = [level], []
    depth = 0
    reached = 1
    while reached:
        depth += 1
        following, reached = cut_counting(neighbours(level, before, depth), label="level")
        before, level = level, following
        recent.append(level)
        done.append(before)
        if len(done) == SHRINK_EVERY:
            # arcs out of finished levels are never followed again
            left = reduce(DataFrame.unionAll, done).select("graph_id", F.col("node").alias("u"))
            arcs = cut(arcs.join(left, ["graph_id", "u"], "left_anti"), "arcs")
            done = []
        if len(recent) == 64:
            finished.append(cut(reduce(DataFrame.unionAll, recent), "levels"))
            recent = []
    found = cut(reduce(DataFrame.unionAll, finished + recent), "distances")
    if nodes is None:
        return found
    return nodes.select("graph_id", "node").join(found, ["graph_id", "node"], "left").fillna(-1, ["dist"])


def shortest_paths(edges: DataFrame, dist: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells of a shortest path to the target of each graph: ``graph_id, k, node``.

    Among equally short ways the smallest previous cell is taken. Previous
    cells are composed by doubling, so a path of length L takes log L rounds.
    """
    reached = dist.where(F.col("dist") >= 0)
    here = reached.select("graph_id", F.col("node").alias("u"), F.col("dist").alias("_du"))
    there = reached.select("graph_id", F.col("node").alias("v"), F.col("dist").alias("_dv"))
    back = cut(
        symmetric(edges)
        .join(here, ["graph_id", "u"])
        .join(there, ["graph_id", "v"])
        .where(F.col("_dv") == F.col("_du") - 1)
        .groupBy("graph_id", F.col("u").alias("node"))
        .agg(F.min("v").alias("back")),
        "back",
    )
    on_path = cut(
        targets.select("graph_id", "node").join(reached, ["graph_id", "node"]).select("graph_id", "node", F.col("dist").alias("k")),
        "path",
    )
    longest = on_path.agg(F.max("k")).first()[0] or 0
    stride = 1
    while stride <= longest:
        jumped = on_path.join(back, ["graph_id", "node"]).select(
            "graph_id", F.col("back").alias("node"), (F.col("k") - stride).alias("k")
        )
        on_path = cut(on_path.unionByName(jumped), "path")
        stride *= 2
        if stride <= longest:
            onward = back.select("graph_id", F.col("node").alias("back"), F.col("back").alias("_next"))
            back = cut(
                back.join(onward, ["graph_id", "back"]).select("graph_id", "node", F.col("_next").alias("back")), "back"
            )
    return on_path.select("graph_id", "k", "node")


def farthest(dist: DataFrame) -> DataFrame:
    """The node with the largest distance of each graph, the lowest one among equals."""
    return dist.groupBy("graph_id").agg(
        F.max(F.struct("dist", (-F.col("node")).alias("_minus"), "node")).alias("_far")
    ).select("graph_id", "_far.node", "_far.dist")


def solve(edges: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Solvability of each graph between ``start`` and ``goal`` of ``ends``.

    One row per graph: solvable, path_length and path (null when unsolvable),
    component_sizes in order of the first cell, and the component (numbered
    in that order) of both ends.
    """
    labels = cut(components(edges, nodes), "labels")
    order = Window.partitionBy("graph_id").orderBy("component")
    sizes = component_sizes(labels).withColumn("number", F.row_number().over(order) - 1)
    listed = sizes.groupBy("graph_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "size")))["size"].alias("component_sizes")
    )
    numbered = labels.join(sizes, ["graph_id", "component"]).select("graph_id", "node", "number")
    start = ends.select("graph_id", F.col("start").alias("node"))
    goal = ends.select("graph_id", F.col("goal").alias("node"))
    at_start = numbered.join(start, ["graph_id", "node"]).select("graph_id", F.col("number").alias("start_component"))
    at_goal = numbered.join(goal, ["graph_id", "node"]).select("graph_id", F.col("number").alias("goal_component"))
    path = shortest_paths(edges, distances(edges, start), goal)
    cells = path.groupBy("graph_id").agg(
        F.max("k").alias("path_length"), F.array_sort(F.collect_list(F.struct("k", "node")))["node"].alias("path")
    )
    return (
        ends.select("graph_id")
        .join(listed, "graph_id")
        .join(at_start, "graph_id")
        .join(at_goal, "graph_id")
        .join(cells, "graph_id", "left")
        .withColumn("solvable", F.col("start_component") == F.col("goal_component"))
    )
