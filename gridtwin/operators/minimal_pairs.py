"""Seeded maze grids in minimal pairs: same size, same ends, one passage moved.

A spanning tree is drawn, one edge of the start-goal path is cut, and extra
passages are opened only inside the two parts. The solvable member keeps the
cut edge; the unsolvable one opens another passage instead, so both have the
same number of passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gridtwin.functions.rng import draw, draw_int, seed_from_text
from gridtwin.functions.text import strip
from gridtwin.operators import boards, connectivity, lattice, trees
from gridtwin.operators.grids import grid_edges, manhattan
from gridtwin.operators.pair_rows import NODE, PAIR, pairs_of_rows, walks_of_parents
from gridtwin.session import cut, spread

# Parameter defaults and difficulty presets.
DEFAULTS = {"width": 10, "height": 10, "algorithm": "backtracker", "placement": "random", "cut": "balanced", "loops": 3}
PRESETS = {
    "easy": {"width": 6, "height": 6, "algorithm": "backtracker", "placement": "random", "cut": "random", "loops": 1},
    "medium": {"width": 10, "height": 10, "algorithm": "backtracker", "placement": "random", "cut": "balanced", "loops": 3},
    "hard": {"width": 16, "height": 16, "algorithm": "backtracker", "placement": "far", "cut": "balanced", "loops": 6},
    "extreme": {"width": 24, "height": 24, "algorithm": "backtracker", "placement": "far", "cut": "balanced", "loops": 12},
}
ALGORITHMS = ("backtracker", "kruskal", "prim")
PLACEMENTS = ("random", "border", "corners", "far")
SMALLEST, LARGEST = 3, 100
ATTEMPTS = 10000

# Draws of one seed are numbered; each use has its own block of a million numbers.
TREE, ENDS, CUT, EXTRA, COIN = (block << 20 for block in range(5))


# --- parameters ---------------------------------------------------------------------
def resolve_params(requests: DataFrame) -> DataFrame:
    """Presets, overrides and defaults made explicit, with ``reason`` set where they are invalid.

    ``requests`` has ``graph_id, preset, seed_text`` and the nullable
    overrides ``width, height, algorithm, placement, cut, loops,
    min_distance``. ``cut`` is a word or a number in text form; it becomes
    ``cut_mode`` and ``cut_pos``.
    """
    def resolved(key: str) -> Column:
        value = F.lit(DEFAULTS[key])
        for name, preset in PRESETS.items():
            value = F.when(F.col("preset") == name, F.lit(preset[key])).otherwise(value)
        return F.coalesce(F.col(key), value)

    rows = requests.select("graph_id", "preset", "seed_text", "min_distance", *[resolved(k).alias(k) for k in DEFAULTS])
    number = F.col("cut").try_cast("double")
    longest = F.greatest("width", "height")
    inside = lambda side: F.col(side).between(SMALLEST, LARGEST)
    reason = (
        F.when(F.col("preset").isNotNull() & ~F.col("preset").isin(*PRESETS), "unknown preset")
        .when(~(inside("width") & inside("height")), "width and height must be between 3 and 100")
        .when(~F.col("algorithm").isin(*ALGORITHMS), "unknown algorithm")
        .when(~F.col("placement").isin(*PLACEMENTS), "unknown placement")
        .when(F.col("cut").isin("balanced", "random"), F.lit(None))
        .when(number.isNull() | F.isnan(number), "unknown cut")
        .when(~number.between(0.0, 1.0), "numeric cut must lie in [0, 1]")
    )
    return rows.select(
        "graph_id",
        "width",
        "height",
        seed_from_text(F.col("seed_text")).alias("seed"),
        "algorithm",
        "placement",
        F.when(F.col("cut").isin("balanced", "random"), F.col("cut")).otherwise("fixed").alias("cut_mode"),
        F.when(~F.col("cut").isin("balanced", "random"), number).alias("cut_pos"),
        F.greatest("loops", F.lit(0)).alias("loops"),
        F.coalesce("min_distance", F.greatest(F.lit(2), F.ceil(longest / 2)).cast("int")).alias("min_distance"),
        reason.alias("reason"),
    )


def accepted(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("reason").isNull()).drop("reason")


def rejected(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("reason").isNotNull()).select("graph_id", "reason")


# --- tree and ends ------------------------------------------------------------------
def weighted_grid(params: DataFrame) -> DataFrame:
    """Grid edges with a seeded weight each."""
    edges = grid_edges(params, "seed")
    return edges.withColumn("w", draw(F.col("seed"), TREE + F.col("edge_no")))


def _random_ends(params: DataFrame) -> DataFrame:
    """First accepted seeded pair of cells at least ``min_distance`` apart, or no row."""
    placed = None
    waiting = params
    first = 0
    for last in (63, 1023, ATTEMPTS - 1):
        attempt = F.col("attempt")
        tries = waiting.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last))))
        cells = F.col("width") * F.col("height")
        tries = tries.withColumn("s", draw_int(F.col("seed"), ENDS + attempt * 2, cells)).withColumn(
            "t", draw_int(F.col("seed"), ENDS + attempt * 2 + 1, cells)
        )
        good = (F.col("s") != F.col("t")) & (
            manhattan(F.col("s"), F.col("t"), F.col("width")) >= F.col("min_distance")
        )
        found = cut(
            # a condition inside the minimum, as a filter would repeat the draws in every comparison
            tries.groupBy("graph_id")
            .agg(F.min(F.when(good, F.struct("attempt", "s", "t"))).alias("_ends"))
            .where(F.col("_ends").isNotNull())
            .select("graph_id", F.col("_ends.s").alias("start"), F.col("_ends.t").alias("goal")),
            "ends",
        )
        placed = found if placed is None else placed.unionAll(found)
        waiting = waiting.join(found, "graph_id", "left_anti")
        first = last + 1
        if waiting.isEmpty():
            break
    return placed


def fixed_ends(params: DataFrame) -> DataFrame:
    """Start and goal of each graph; the goal stays null where it needs the tree (``far``)."""
    seed, width, height = F.col("seed"), F.col("width"), F.col("height")
    side = draw_int(seed, ENDS, 4)
    span = F.when(F.col("_side") < 2, height).otherwise(width)
    a, b = draw_int(seed, ENDS + 1, F.col("_span")), draw_int(seed, ENDS + 2, F.col("_span"))
    border = params.where("placement = 'border'").withColumn("_side", side).withColumn("_span", span)
    border = border.withColumn("_a", a).withColumn("_b", b)
    left, right = lambda c: F.col(c) * width, lambda c: F.col(c) * width + width - 1
    top, bottom = lambda c: F.col(c), lambda c: (height - 1) * width + F.col(c)

    def by_side(*ends: Column) -> Column:
        value = ends[3]
        for number in (2, 1, 0):
            value = F.when(F.col("_side") == number, ends[number]).otherwise(value)
        return value.cast("int")

    border = border.select(
        "graph_id",
        by_side(left("_a"), right("_a"), top("_a"), bottom("_a")).alias("start"),
        by_side(right("_b"), left("_b"), bottom("_b"), top("_b")).alias("goal"),
    )
    corners = params.where("placement = 'corners'").select(
        "graph_id", F.lit(0).alias("start"), (width * height - 1).cast("int").alias("goal")
    )
    far = params.where("placement = 'far'").select(
        "graph_id", draw_int(seed, ENDS, width * height).alias("start"), F.lit(None).cast("int").alias("goal")
    )
    return border.unionAll(corners).unionAll(far).unionAll(_random_ends(params.where("placement = 'random'")))


def unplaced(params: DataFrame, ends: DataFrame) -> DataFrame:
    """Graphs for which no pair of ends was accepted."""
    return params.join(ends, "graph_id", "left_anti").select("graph_id", F.lit("could not place ends").alias("reason"))


def far_goals(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Fill missing goals with the cell farthest from the start on the tree."""
    needed = ends.where(F.col("goal").isNull()).select("graph_id", "start")
    depths = nodes.join(needed, "graph_id", "left_semi").select("graph_id", "node", F.col("depth").alias("dist"))
    farthest = connectivity.farthest(depths).select("graph_id", F.col("node").alias("goal"))
    return ends.where(F.col("goal").isNotNull()).unionByName(needed.join(farthest, "graph_id"))


# --- cut and extra passages -----------------------------------------------------------
def choose_cuts(cuts: DataFrame, params: DataFrame) -> DataFrame:
    """One cut per graph: random, at a fixed fraction, or one of the three most balanced."""
    smaller = F.least("start_side", "goal_side")
    ranked = cuts.join(params.select("graph_id", "seed", "cut_mode", "cut_pos").hint("merge"), "graph_id").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(smaller.desc(), "k"))
    )
    length = F.col("path_length")
    at_fraction = F.greatest(F.lit(0), F.least(length - 1, F.floor(F.col("cut_pos") * length)))
    wanted = (
        F.when(F.col("cut_mode") == "random", F.col("k") == draw_int(F.col("seed"), CUT, length))
        .when(F.col("cut_mode") == "fixed", F.col("k") == at_fraction)
        .otherwise(F.col("_rank") - 1 == draw_int(F.col("seed"), CUT, F.least(F.lit(3), length)))
    )
    return ranked.where(wanted).select(*cuts.columns)


def sides(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each cell with ``goal_part``: whether it lies beyond the cut edge."""
    beyond = chosen.select("graph_id", F.col("enter").alias("_enter"), F.col("leave").alias("_leave"))
    return nodes.join(beyond, "graph_id").select(
        "graph_id",
        "node",
        ((F.col("enter") >= F.col("_enter")) & (F.col("leave") <= F.col("_leave"))).alias("goal_part"),
    )


def candidate_passages(grid: DataFrame, tree: DataFrame, parts: DataFrame) -> DataFrame:
    """Closed grid edges whose two cells lie on the same side of the cut."""
    at_a = parts.select("graph_id", F.col("node").alias("a"), F.col("goal_part").alias("_part_a"))
    at_b = parts.select("graph_id", F.col("node").alias("b"), F.col("goal_part").alias("_part_b"))
    return (
        grid.join(tree, ["graph_id", "a", "b"], "left_anti")
        .join(at_a, ["graph_id", "a"])
        .join(at_b, ["graph_id", "b"])
        .where(F.col("_part_a") == F.col("_part_b"))
        .drop("_part_a", "_part_b")
    )


def extra_passages(candidates: DataFrame, params: DataFrame) -> DataFrame:
    """Seeded choice per graph: ``loop`` passages for both members and one ``opened`` for the unsolvable one."""
    place = draw(F.col("seed"), EXTRA + F.col("edge_no"))
    whole = Window.partitionBy("graph_id")
    ranked = (
        candidates.join(params.select("graph_id", "loops").hint("merge"), "graph_id")
        .withColumn("_rank", F.row_number().over(whole.orderBy(place, "edge_no")))
        .withColumn("_loops", F.least("loops", F.count("*").over(whole) - 1))
    )
    return ranked.where(F.col("_rank") <= F.col("_loops") + 1).select(
        "graph_id",
        "a",
        "b",
        F.when(F.col("_rank") <= F.col("_loops"), "loop").otherwise("opened").alias("kind"),
    )


# --- pairs ------------------------------------------------------------------------------
def build_pairs(params: DataFrame) -> dict[str, DataFrame]:
    """All tables of the pairs of ``params`` (see :func:`accepted`).

    ``passages(graph_id, a, b, kind)`` holds both members: kind ``cut`` only in
    the solvable one, ``opened`` only in the unsolvable one, ``tree`` and
    ``loop`` in both. Also ``ends``, ``tree``, ``nodes``, ``path``, ``cuts``,
    ``chosen``, ``candidates`` and ``unplaced``.

    Where every graph has one row without nulls that matter, all is chosen inside that row
    (:mod:`gridtwin.operators.pair_rows`) and only short lists are written; the tables are read from them.
    """
    params = cut(params, "params")
    if _one_row_each(params):
        return _pairs_in_rows(params)
    grid = cut(weighted_grid(params), "grid")
    tree = cut(connectivity.spanning_forest(grid), "tree")
    ends = cut(fixed_ends(params), "ends")
    nodes = cut(trees.rooted(tree, ends.select("graph_id", F.col("start").alias("root"))), "nodes")
    ends_all = cut(far_goals(nodes, ends), "ends")
    path = cut(trees.tree_paths(nodes, ends_all), "path")
    cuts = trees.cut_sizes(path)
    chosen = cut(choose_cuts(cuts, params), "chosen")
    candidates = cut(candidate_passages(grid, tree, sides(nodes, chosen)), "candidates")
    extra = extra_passages(candidates, params)
    cut_edges = chosen.select(
        "graph_id", F.least("near", "far").alias("a"), F.greatest("near", "far").alias("b"), F.lit("cut").alias("_kind")
    )
    passages = (
        tree.join(cut_edges, ["graph_id", "a", "b"], "left")
        .join(ends_all.select("graph_id"), "graph_id", "left_semi")
        .select("graph_id", "a", "b", F.coalesce("_kind", F.lit("tree")).alias("kind"))
    )
    return {
        "params": params,
        "grid": grid,
        "tree": tree,
        "ends": ends_all,
        "nodes": nodes,
        "path": path,
        "cuts": cuts,
        "chosen": chosen,
        "candidates": candidates,
        "passages": cut(passages.unionAll(extra), "passages"),
        "unplaced": unplaced(params, ends),
    }


def _one_row_each(params: DataFrame) -> bool:
    """Whether no graph comes twice and each can be built in its row: whole numbers without nulls, a grid of some cells that one block holds."""
    cells = F.col("width").cast("bigint") * F.col("height")
    fits = F.col("seed").isNotNull() & F.col("loops").isNotNull() & (F.col("width") > 0) & cells.between(2, lattice.MOST_CELLS)
    whole = all(kind in ("tinyint", "smallint", "int", "bigint") for name, kind in params.dtypes if name in ("graph_id", "width", "height", "seed", "loops"))
    if not whole or params.where(F.col("graph_id").isNull() | ~F.coalesce(fits, F.lit(False))).limit(1).count():
        return False
    return params.groupBy("graph_id").count().where("count > 1").limit(1).count() == 0


def _pairs_in_rows(params: DataFrame) -> dict[str, DataFrame]:
    """The tables of :func:`build_pairs` from one written row for each graph."""
    ends = cut(fixed_ends(params), "ends")
    placed = spread(params.join(ends.hint("merge"), "graph_id", "left"))
    schema = StructType([params.schema["graph_id"], *StructType.fromDDL(PAIR)])
    rows = placed.mapInArrow(pairs_of_rows(TREE, CUT, EXTRA), schema)
    # what the tables are listed from goes with the row, so that no list meets its parameters again
    rows = cut(spread(params.select("graph_id", "seed", "width").join(rows.hint("merge"), "graph_id")), "pairs")
    ended = rows.where(F.col("start").isNotNull())
    chosen = rows.where(F.col("k").isNotNull())
    key = params.schema["graph_id"]

    def walked(on_way: bool) -> DataFrame:
        kept = ended.select("graph_id", "start", "goal", "parents")
        return kept.mapInArrow(walks_of_parents(on_way), StructType([key, *StructType.fromDDL(NODE).fields[1:]]))

    # edge 2n leads from cell n to its right, 2n + 1 below
    a = F.floor(F.col("edge_no") / 2).cast("int")
    b = (a + F.when(F.col("edge_no") % 2 == 0, 1).otherwise(F.col("width"))).cast("int")
    at = F.struct(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    links = rows.select("graph_id", "start", "near", "far", F.posexplode("parents").alias("node", "parent")).where("parent >= 0")
    links = links.select("graph_id", "start", at.alias("_at"), "near", "far")
    is_cut = (F.col("_at.a") == F.least("near", "far")) & (F.col("_at.b") == F.greatest("near", "far"))
    kept = links.where(F.col("start").isNotNull()).select(
        "graph_id", "_at.a", "_at.b", F.when(is_cut, "cut").otherwise("tree").alias("kind")
    )
    # the first of the extra passages are loops, one more is opened
    extra = rows.select("graph_id", "width", "loop_count", F.posexplode("extra").alias("_place", "edge_no"))
    extra = extra.select("graph_id", a.alias("a"), b.alias("b"), F.when(F.col("_place") < F.col("loop_count"), "loop").otherwise("opened").alias("kind"))
    cuts = ("graph_id", "k", "near", "far", "start_side", "goal_side", "enter", "leave", "path_length")
    path = walked(True).select("graph_id", F.col("depth").alias("k"), "node", "parent", "enter", "leave", "size")
    closed = rows.select("graph_id", "seed", "width", F.explode("candidates").alias("edge_no"))
    return {
        "params": params,
        "grid": weighted_grid(params),
        "tree": links.select("graph_id", "_at.a", "_at.b"),
        "ends": ended.select("graph_id", "start", "goal"),
        "nodes": walked(False),
        "path": path,
        "cuts": trees.cut_sizes(path),
        "chosen": chosen.select(*cuts),
        "candidates": closed.select(
            "graph_id", b.alias("b"), a.alias("a"), "seed", "edge_no", draw(F.col("seed"), TREE + F.col("edge_no")).alias("w")
        ),
        "passages": kept.unionAll(extra),
        "unplaced": unplaced(params, ends),
    }


def members(passages: DataFrame) -> DataFrame:
    """Edges of both members: ``graph_id, solvable, a, b``."""
    in_members = (
        F.when(F.col("kind") == "cut", F.array(F.lit(True)))
        .when(F.col("kind") == "opened", F.array(F.lit(False)))
        .otherwise(F.array(F.lit(True), F.lit(False)))
    )
    return passages.select("graph_id", F.explode(in_members).alias("solvable"), "a", "b")


def labelled_members(passages: DataFrame, labels: DataFrame) -> DataFrame:
    """One member per graph: the one with the label of ``labels(graph_id, seed, label)``.

    ``label`` is text; true, 1 and yes mean solvable, null or empty leaves it
    to the seed's fair coin.
    """
    text = strip(F.lower("label"))
    wanted = F.when(
        F.coalesce(text, F.lit("")) == "", draw(F.col("seed"), COIN) < 0.5
    ).otherwise(text.isin("true", "1", "yes"))
    chosen = labels.select("graph_id", wanted.alias("solvable"))
    return members(passages).join(chosen.hint("merge"), ["graph_id", "solvable"])


def pair_metadata(pairs: dict[str, DataFrame]) -> DataFrame:
    """Facts about each pair, one row per graph."""
    passages = pairs["passages"]
    counted = passages.groupBy("graph_id").agg(
        F.count_if(F.col("kind") == "loop").alias("loops"),
        F.count_if(F.col("kind") == "opened").alias("_opened"),
        F.count_if(F.col("kind") != "opened").alias("passages"),
        F.max(F.when(F.col("kind") == "opened", F.struct("a", "b"))).alias("_edge"),
    )
    positive = members(passages).where("solvable").select("graph_id", "a", "b")
    ends = pairs["ends"].select("graph_id", "start", "goal")
    made = boards.with_flood(boards.boards_of_edges(pairs["params"], positive).join(ends, "graph_id"), F.col("start"))
    solution = made.select("graph_id", boards.distance_to(F.col("flood"), F.col("goal"), F.col("width")).alias("dist"))
    chosen = pairs["chosen"].select(
        "graph_id",
        "path_length",
        F.col("k").alias("cut_index"),
        F.col("near").alias("cut_near"),
        F.col("far").alias("cut_far"),
        "start_side",
        "goal_side",
    )
    return (
        pairs["params"]
        .select("graph_id", "seed", "width", "height", F.col("loops").alias("loops_requested"))
        .join(pairs["ends"].select("graph_id", "start", "goal"), "graph_id")
        .join(chosen, "graph_id")
        .join(counted, "graph_id")
        .join(solution.select("graph_id", F.col("dist").alias("solution_length")), "graph_id")
        .select(
            "graph_id",
            "seed",
            "width",
            "height",
            "start",
            "goal",
            "loops_requested",
            "loops",
            F.col("path_length").alias("tree_path_length"),
            "cut_index",
            "cut_near",
            "cut_far",
            F.col("_edge.a").alias("opened_a"),
            F.col("_edge.b").alias("opened_b"),
            "start_side",
            "goal_side",
            (F.least("start_side", "goal_side") / (F.col("width") * F.col("height"))).alias("pocket_frac"),
            "passages",
            (F.col("passages") - 1 + F.col("_opened")).alias("negative_passages"),
            (F.col("_opened") == 1).alias("walls_balanced"),
            "solution_length",
        )
    )


# --- audits -----------------------------------------------------------------------------
def pair_differences(edges: DataFrame) -> DataFrame:
    """Per pair, how many edges only one member has, and one of each: ``edges`` as of :func:`members`."""
    # an edge that lacks a name equals no other
    unnamed = F.col("graph_id").isNull() | F.col("a").isNull() | F.col("b").isNull()
    sides = edges.groupBy("graph_id", "a", "b").agg(
        F.count_if("solvable").alias("_yes"), F.count_if(~F.col("solvable")).alias("_no")
    )
    only = lambda side, other: F.when((F.col(other) == 0) | unnamed, F.col(side)).otherwise(0)
    sides = sides.where((F.col("_yes") > 0) | (F.col("_no") > 0)).select(
        "graph_id", F.struct("a", "b").alias("_at"), only("_yes", "_no").alias("_yes"), only("_no", "_yes").alias("_no")
    )
    return sides.groupBy("graph_id").agg(
        F.sum("_yes").alias("only_solvable"),
        F.sum("_no").alias("only_unsolvable"),
        F.max(F.when(F.col("_yes") > 0, F.col("_at"))).alias("_cut"),
        F.max(F.when(F.col("_no") > 0, F.col("_at"))).alias("_opened"),
    )


def minimality_violations(edges: DataFrame, chosen: DataFrame, passages: DataFrame) -> DataFrame:
    """Pairs whose members differ in anything but the cut edge and the opened one."""
    differing = pair_differences(edges)
    recorded = chosen.select(
        "graph_id", F.struct(F.least("near", "far").alias("a"), F.greatest("near", "far").alias("b")).alias("_want_cut")
    )
    opened = passages.where("kind = 'opened'").select("graph_id", F.struct("a", "b").alias("_want_opened"))
    return (
        differing.join(recorded, "graph_id")
        .join(opened, "graph_id", "left")
        .where(
            (F.col("only_solvable") != 1)
            | (F.col("only_unsolvable") != F.col("_want_opened").isNotNull().cast("int"))
            | ~F.col("_cut").eqNullSafe(F.col("_want_cut"))
            | ~F.col("_opened").eqNullSafe(F.col("_want_opened"))
        )
        .select("graph_id", "only_solvable", "only_unsolvable")
    )


def label_audit(pairs: dict[str, DataFrame]) -> DataFrame:
    """Both members of each pair checked by their connected parts: one row per member with what was found.

    ``agrees`` is true if connectivity matches the label, the unsolvable
    member has exactly the two recorded parts, and the number of loops is what
    the candidate pool allows.
    """
    keyed = (F.col("graph_id") * 2 + F.col("solvable").cast("int")).alias("graph_id")
    edges = members(pairs["passages"]).select(keyed, "a", "b")
    both = pairs["params"].select("graph_id", "width", "height").join(pairs["ends"].select("graph_id", "start", "goal"), "graph_id")
    both = both.withColumn("solvable", F.explode(F.array(F.lit(True), F.lit(False))))
    both = both.select(keyed, F.col("graph_id").alias("pair_id"), "solvable", "width", "height", "start", "goal")
    made = boards.boards_of_edges(both, edges, "pair_id", "solvable", "start", "goal")
    part_of = lambda end: boards.number_at(F.col("_parts.number"), F.col(end))
    shape = boards.with_parts(made).select(
        "pair_id",
        "solvable",
        F.size("_parts.sizes").cast("bigint").alias("parts"),
        F.array_min("_parts.sizes").cast("bigint").alias("smallest"),
        F.array_max("_parts.sizes").cast("bigint").alias("largest"),
        part_of("start").alias("start_part"),
        part_of("goal").alias("goal_part"),
    )
    pool = pairs["candidates"].groupBy("graph_id").agg(F.count("*").alias("pool"))
    extra = pairs["passages"].groupBy("graph_id").agg(
        F.count_if(F.col("kind") == "loop").alias("loops"), F.count_if(F.col("kind") == "opened").alias("opened")
    )
    facts = (
        pairs["chosen"]
        .select("graph_id", "start_side", "goal_side")
        .join(pairs["params"].select("graph_id", F.col("loops").alias("asked")), "graph_id")
        .join(pool, "graph_id", "left")
        .join(extra, "graph_id")
        .withColumn("pool", F.coalesce("pool", F.lit(0)))
        .withColumnRenamed("graph_id", "pair_id")
    )
    pool_fits = (F.col("loops") == F.greatest(F.lit(0), F.least("asked", F.col("pool") - 1))) & (
        F.col("opened") == (F.col("pool") >= 1).cast("int")
    )
    parts_fit = F.when(F.col("solvable"), F.col("parts") == 1).otherwise(
        (F.col("parts") == 2)
        & (F.col("smallest") == F.least("start_side", "goal_side"))
        & (F.col("largest") == F.greatest("start_side", "goal_side"))
    )
    return (
        shape.join(facts, "pair_id")
        .select(
            F.col("pair_id").alias("graph_id"),
            "solvable",
            "parts",
            "smallest",
            "largest",
            (((F.col("start_part") == F.col("goal_part")) == F.col("solvable")) & parts_fit & pool_fits).alias("agrees"),
        )
    )
