"""Graphs against union-find, breadth-first search and sorting by weight in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from catalog import graphs as queries
from gridtwin.operators import connectivity, grids, minimal_pairs, trees
from tests.conftest import SMALL


class Sets:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


@pytest.fixture(scope="module")
def mixed(spark):
    """A long path, a star, random edges and lone nodes, as four graphs."""
    rng = random.Random(4)
    edges = [(0, i, i + 1) for i in range(140)]
    edges += [(1, 0, i) for i in range(1, 400)]
    edges += [(2, min(a, b), max(a, b)) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(280)) if a != b]
    edges = sorted(set(edges))
    nodes = [(0, i) for i in range(141)] + [(1, i) for i in range(400)] + [(2, i) for i in range(300)] + [(3, 5), (3, 9)]
    weights = [(g, a, b, rng.randrange(50) / 50) for g, a, b in edges]
    return (
        edges,
        nodes,
        weights,
        spark.createDataFrame(weights, "graph_id int, a int, b int, w double"),
        spark.createDataFrame(nodes, "graph_id int, node int"),
    )


def test_components(mixed):
    edges, nodes, _, edge_table, node_table = mixed
    sets = Sets()
    for g, a, b in edges:
        sets.join((g, a), (g, b))
    got = {(r.graph_id, r.node): r.component for r in connectivity.components(edge_table, node_table).collect()}
    assert got == {n: sets.find(n)[1] for n in nodes}


def test_spanning_forest_with_equal_weights(mixed):
    _, _, weights, edge_table, _ = mixed
    sets, expected = Sets(), set()
    for g, a, b, _w in sorted(weights, key=lambda e: (e[0], e[3], e[1], e[2])):
        if sets.join((g, a), (g, b)):
            expected.add((g, a, b))
    assert {tuple(r) for r in connectivity.spanning_forest(edge_table).collect()} == expected


def test_distances_and_paths(spark, mixed):
    edges, nodes, _, edge_table, node_table = mixed
    near = {}
    for g, a, b in edges:
        near.setdefault((g, a), []).append(b)
        near.setdefault((g, b), []).append(a)
    expected = {}
    for g in range(4):
        level, seen = [9 if g == 3 else 0], {}
        seen[level[0]] = 0
        while level:
            level = [v for u in level for v in near.get((g, u), []) if v not in seen and not seen.update({v: seen[u] + 1})]
        expected.update({(g, n): d for n, d in seen.items()})
    sources = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 9)], "graph_id int, node int")
    dist = connectivity.distances(edge_table, sources, node_table)
    assert {(r.graph_id, r.node): r.dist for r in dist.collect()} == {n: expected.get(n, -1) for n in nodes}
    targets = spark.createDataFrame([(0, 140), (1, 17), (3, 5)], "graph_id int, node int")
    path = {}
    for r in connectivity.shortest_paths(edge_table, dist, targets).collect():
        path.setdefault(r.graph_id, {})[r.k] = r.node
    assert path == {0: {i: i for i in range(141)}, 1: {0: 0, 1: 17}}


def test_walk_around_trees(spark):
    rng = random.Random(1)
    parents = {(g, i): rng.randrange(max(0, i - 3), i) for g in range(3) for i in range(1, 60)}
    tree = spark.createDataFrame([(g, p, i) for (g, i), p in parents.items()], "graph_id int, a int, b int")
    roots = spark.createDataFrame([(g, 0) for g in range(3)], "graph_id int, root int")
    size, depth = {}, {}
    for g in range(3):
        depth[(g, 0)] = 0
        for i in range(1, 60):
            depth[(g, i)] = depth[(g, parents[(g, i)])] + 1
        for i in range(59, -1, -1):
            size[(g, i)] = size.get((g, i), 0) + 1
            if i:
                size[(g, parents[(g, i)])] = size.get((g, parents[(g, i)]), 0) + size[(g, i)]
    rows = trees.rooted(tree, roots).collect()
    assert {(r.graph_id, r.node): (r.parent, r.depth, r.size) for r in rows} == {
        k: (parents.get(k), depth[k], size[k]) for k in depth
    }


def test_forest_of_dense_graphs(spark, monkeypatch):
    """The forest of a sample rules edges out: ties, a second graph, loops and repeated edges change nothing."""
    rng = random.Random(8)
    weights = [(g, a, b, rng.randrange(12) / 12) for g, n in ((0, 60), (1, 25)) for a in range(n) for b in range(a + 1, n)]
    weights += [(2, 4, 4, 0.1), (2, 4, 9, 0.5), (3, 7, 8, 0.2)]
    table = spark.createDataFrame(weights + weights[:40], "graph_id int, a int, b int, w double")
    sets, expected = Sets(), set()
    for g, a, b, _ in sorted(weights, key=lambda r: (r[3], r[1], r[2])):
        if sets.join((g, a), (g, b)):
            expected.add((g, a, b))
    entered = []
    contract = connectivity._contract
    monkeypatch.setattr(connectivity, "_contract", lambda live, weight: entered.append(live.count()) or contract(live, weight))
    assert {tuple(r) for r in connectivity.spanning_forest(table).collect()} == expected
    # sample first, then what it leaves, of some 2,000 edges
    assert len(entered) == 2 and max(entered) < len(weights) / 2


def test_pointers_reach_their_roots(spark):
    rows = [(0, 0, 0)] + [(0, i, i - 1) for i in range(1, 200)] + [(1, 5, 5), (1, 6, 5), (1, 7, 6)]
    roots, count = connectivity._roots(spark.createDataFrame(rows, "graph_id int, c int, p int"))
    assert count == len(rows)
    assert sorted(map(tuple, roots.collect())) == [(0, i, 0) for i in range(200)] + [(1, 5, 5), (1, 6, 5), (1, 7, 5)]


def test_forest_of_all_line_items(spark):
    from gridtwin.functions.rng import draw
    from catalog import inputs

    rows = inputs.part_supplier_edges(spark, SMALL).withColumn("w", draw(-F.col("a"), F.col("b"))).collect()
    sets, expected = Sets(), set()
    for r in sorted(rows, key=lambda r: (r.w, r.a, r.b)):
        if sets.join(r.a, r.b):
            expected.add((r.a, r.b))
    got = {tuple(r) for r in queries.spanning_forest_of_suppliers_and_parts(spark, SMALL).collect()}
    assert got == expected


# --- minimal pairs -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def pairs(spark):
    grid = [
        (w, h, placement, mode, pos, loops)
        for w, h in ((3, 3), (4, 7), (10, 10))
        for placement in minimal_pairs.PLACEMENTS
        for mode, pos in (("balanced", None), ("random", None), ("fixed", 0.0), ("fixed", 0.5), ("fixed", 1.0))
        for loops in (0, 3, 10)
    ]
    rows = [(i, w, h, 100 + i, p, m, c, k, max(2, -(-max(w, h) // 2))) for i, (w, h, p, m, c, k) in enumerate(grid)]
    schema = "graph_id int, width int, height int, seed bigint, placement string, cut_mode string, cut_pos double, loops int, min_distance int"
    return minimal_pairs.build_pairs(spark.createDataFrame(rows, schema))


def test_members_agree_with_union_find(pairs):
    sizes = {r.graph_id: r.width * r.height for r in pairs["params"].collect()}
    ends = {r.graph_id: (r.start, r.goal) for r in pairs["ends"].collect()}
    assert set(ends) == set(sizes)
    chosen = {r.graph_id: r for r in pairs["chosen"].collect()}
    sets, passages = {}, {}
    for r in minimal_pairs.members(pairs["passages"]).collect():
        sets.setdefault((r.graph_id, r.solvable), Sets()).join(r.a, r.b)
        passages[(r.graph_id, r.solvable)] = passages.get((r.graph_id, r.solvable), 0) + 1
    opened = {r.graph_id for r in pairs["passages"].where("kind = 'opened'").collect()}
    for g, (start, goal) in ends.items():
        yes, no = sets[(g, True)], sets[(g, False)]
        assert yes.find(start) == yes.find(goal) and no.find(start) != no.find(goal)
        parts = {}
        for cell in range(sizes[g]):
            parts[no.find(cell)] = parts.get(no.find(cell), 0) + 1
        assert sorted(parts.values()) == sorted((chosen[g].start_side, chosen[g].goal_side))
        assert passages[(g, True)] - passages[(g, False)] == (0 if g in opened else 1)


def test_audits_find_nothing(pairs):
    edges = minimal_pairs.members(pairs["passages"])
    assert minimal_pairs.minimality_violations(edges, pairs["chosen"], pairs["passages"]).isEmpty()
    assert minimal_pairs.label_audit(pairs).where(~F.col("agrees")).isEmpty()
    broken = pairs["passages"].where("NOT (graph_id = 5 AND kind = 'cut')")
    found = minimal_pairs.minimality_violations(minimal_pairs.members(broken), pairs["chosen"], broken)
    assert [r.graph_id for r in found.collect()] == [5]


def test_cut_positions_and_ends(pairs):
    facts = pairs["params"].join(pairs["chosen"], "graph_id").join(pairs["ends"], "graph_id")
    for r in facts.collect():
        if r.cut_mode == "fixed":
            assert r.k == {0.0: 0, 0.5: r.path_length // 2, 1.0: r.path_length - 1}[r.cut_pos]
        sx, sy, gx, gy = r.start % r.width, r.start // r.width, r.goal % r.width, r.goal // r.width
        if r.placement == "corners":
            assert (r.start, r.goal) == (0, r.width * r.height - 1)
        if r.placement == "random":
            assert abs(sx - gx) + abs(sy - gy) >= r.min_distance
        if r.placement == "border":
            assert {sx, gx} == {0, r.width - 1} or {sy, gy} == {0, r.height - 1}
    deepest = pairs["nodes"].groupBy("graph_id").agg(F.max("depth").alias("deepest"))
    far = facts.where("placement = 'far'").join(deepest, "graph_id")
    assert far.where(F.col("path_length") != F.col("deepest")).isEmpty()


def test_metadata(pairs):
    rows = minimal_pairs.pair_metadata(pairs).collect()
    assert len(rows) == pairs["params"].count()
    for r in rows:
        assert r.loops <= r.loops_requested and r.passages == r.width * r.height - 1 + r.loops
        assert r.solution_length <= r.tree_path_length and r.start_side + r.goal_side == r.width * r.height
        assert r.pocket_frac == min(r.start_side, r.goal_side) / (r.width * r.height)


def test_text_drawing(pairs):
    params = pairs["params"].join(pairs["ends"], "graph_id")
    edges = minimal_pairs.members(pairs["passages"]).where("solvable")
    drawn = {r.graph_id: r.text.split("\n") for r in grids.whole_text(grids.text_rows(params, edges, pairs["path"])).collect()}
    opened = {(r.graph_id, r.a, r.b) for r in edges.collect()}
    for r in params.collect():
        rows = drawn[r.graph_id]
        assert len(rows) == 2 * r.height + 1 and {len(row) for row in rows} == {2 * r.width + 1}
        for n in range(r.width * r.height):
            x, y = n % r.width, n // r.width
            if x < r.width - 1:
                assert (rows[2 * y + 1][2 * x + 2] != "#") == ((r.graph_id, n, n + 1) in opened)
            if y < r.height - 1:
                assert (rows[2 * y + 2][2 * x + 1] != "#") == ((r.graph_id, n, n + r.width) in opened)
        assert rows[2 * (r.start // r.width) + 1][2 * (r.start % r.width) + 1] == "S"
        assert rows[2 * (r.goal // r.width) + 1][2 * (r.goal % r.width) + 1] == "G"
        assert "*" in "".join(rows)


def test_balanced_cuts_leave_larger_pockets(spark):
    rows = [(i, 14, 14, i, "far", mode, None, 3, 7) for i, mode in enumerate(["balanced", "random"] * 30)]
    schema = "graph_id int, width int, height int, seed bigint, placement string, cut_mode string, cut_pos double, loops int, min_distance int"
    built = minimal_pairs.build_pairs(spark.createDataFrame(rows, schema))
    pocket = F.avg(F.least("start_side", "goal_side"))
    means = {r[0]: r[1] for r in built["chosen"].join(built["params"], "graph_id").groupBy("cut_mode").agg(pocket).collect()}
    assert means["balanced"] > means["random"]


def test_unplaceable_ends_are_reported(spark):
    schema = "graph_id int, width int, height int, seed bigint, placement string, cut_mode string, cut_pos double, loops int, min_distance int"
    params = spark.createDataFrame([(1, 4, 4, 9, "random", "random", None, 0, 50), (2, 4, 4, 9, "random", "random", None, 0, 6)], schema)
    ends = minimal_pairs.fixed_ends(params)
    assert [r.graph_id for r in minimal_pairs.unplaced(params, ends).collect()] == [1]
    # only opposite corners are six steps apart
    assert {(r.start, r.goal) for r in ends.collect()} <= {(0, 15), (15, 0), (3, 12), (12, 3)}


def test_parameters(spark):
    schema = (
        "graph_id int, preset string, seed_text string, width int, height int, algorithm string, placement string, "
        "cut string, loops int, min_distance int"
    )
    none = (None,) * 7
    rows = [
        (0, "hard", "hello", *none),
        (1, None, "1", 2, 5, None, None, None, None, None),
        (2, None, "1", 9, 6, None, None, "0.25", -3, None),
        (3, None, "1", None, None, "wilson", None, None, None, None),
        (4, None, "1", None, None, None, "middle", None, None, None),
        (5, None, "1", None, None, None, None, "1.5", None, None),
        (6, "odd", "1", *none),
    ]
    resolved = minimal_pairs.resolve_params(spark.createDataFrame(rows, schema))
    good = {r.graph_id: r for r in minimal_pairs.accepted(resolved).collect()}
    assert set(good) == {0, 2}
    assert (good[0].width, good[0].placement, good[0].loops, good[0].seed, good[0].min_distance) == (16, "far", 6, 1335831723, 8)
    assert (good[2].cut_mode, good[2].cut_pos, good[2].loops, good[2].min_distance) == ("fixed", 0.25, 0, 5)
    assert {r.graph_id for r in minimal_pairs.rejected(resolved).collect()} == {1, 3, 4, 5, 6}


def test_pairs_are_chosen_in_the_rows_of_their_grids(spark, monkeypatch):
    """Tables read from one row for each graph equal those that were joined from edges; no edge is shuffled or written on the way."""
    places, modes = ("random", "border", "corners", "far", "nowhere"), ("balanced", "random", "fixed")
    rows = [(7 + 3 * k, 3 + k % 5, 3 + k % 4, k * 2654435761, places[k % 5], modes[k % 3], (None, 0.0, 0.4, 1.0)[k % 4], k % 4, 2 + 90 * (k == 25)) for k in range(60)]
    schema = "graph_id long, width int, height int, seed long, placement string, cut_mode string, cut_pos double, loops int, min_distance int"
    table = spark.createDataFrame(rows, schema)
    written = []
    monkeypatch.setattr(minimal_pairs, "cut", lambda df, label="cut", cut=minimal_pairs.cut: written.append(label) or cut(df, label))
    inside = minimal_pairs.build_pairs(table)
    assert set(written) <= {"params", "ends", "pairs"}
    plan = inside["passages"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(minimal_pairs, "_one_row_each", lambda _: False)
    joined = minimal_pairs.build_pairs(table)
    assert inside.keys() == joined.keys()
    for name, wanted in joined.items():
        assert inside[name].dtypes == wanted.dtypes, name
        assert sorted(map(repr, inside[name].collect())) == sorted(map(repr, wanted.collect())), name


def test_graphs_that_come_twice_are_not_built_in_rows(spark):
    schema = "graph_id long, width int, height int, seed long, loops int"
    fits = lambda *rows: minimal_pairs._one_row_each(spark.createDataFrame(rows, schema))
    assert fits((1, 3, 3, 1, 0), (2, 3, 3, 1, 0))
    for row in ((1, 3, 3, 1, 0), (None, 3, 3, 1, 0), (2, 3, 3, None, 0), (2, None, 3, 1, 0), (2, 1, 1, 1, 0), (2, 1000, 1000, 1, 0)):
        assert not fits((1, 3, 3, 1, 0), row)


def test_differences_count_every_unmatched_edge(spark):
    rows = [
        (1, True, 0, 1), (1, False, 0, 1), (1, True, 0, 2), (1, True, 0, 2), (1, False, 3, 4), (1, True, 1, 2), (1, False, 1, 2), (1, False, 1, 2),
        (2, True, None, 1), (2, False, None, 1), (None, True, 0, 1), (None, False, 0, 1), (3, None, 0, 1), (4, True, 5, 6), (4, False, 5, 6),
    ]
    found = minimal_pairs.pair_differences(spark.createDataFrame(rows, "graph_id long, solvable boolean, a int, b int"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.graph_id: (r.only_solvable, r.only_unsolvable, r._cut and tuple(r._cut), r._opened and tuple(r._opened)) for r in found.collect()} == {
        1: (2, 1, (0, 2), (3, 4)), 2: (1, 1, (None, 1), (None, 1)), None: (1, 1, (0, 1), (0, 1)), 4: (0, 0, None, None),
    }
