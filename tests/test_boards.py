"""Bit boards against plain floods."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from gridtwin.functions.rng import draw, draw_inside
from gridtwin.operators import boards
from gridtwin.operators import grids as drawing

GRIDS = "graph_id long, width int, height int, start int, goal int"
EDGES = "graph_id long, a int, b int"


def drawn(number, width, height, share, draw_):
    edges = []
    for n in range(width * height):
        if n % width < width - 1 and draw_.random() < share:
            edges.append((number, n, n + 1))
        if n // width < height - 1 and draw_.random() < share:
            edges.append((number, n, n + width))
    return (number, width, height, draw_.randrange(width * height), draw_.randrange(width * height)), edges


def corridor(number, side):
    order = [(x if y % 2 == 0 else side - 1 - x) + y * side for y in range(side) for x in range(side)]
    return (number, side, side, order[0], order[-1]), [(number, min(a, b), max(a, b)) for a, b in zip(order, order[1:])]


def plain(grid, edges):
    number, width, height, start, goal = grid
    near = {n: [] for n in range(width * height)}
    for _, a, b in edges:
        near[a].append(b)
        near[b].append(a)

    def flood(source):
        dist, todo = {source: 0}, deque([source])
        while todo:
            n = todo.popleft()
            for m in near[n]:
                if m not in dist:
                    dist[m] = dist[n] + 1
                    todo.append(m)
        return dist

    dist, part = flood(start), {}
    for n in near:
        if n not in part:
            part.update(dict.fromkeys(flood(n), n))
    path = None
    if goal in dist:
        path = [goal]
        while path[-1] != start:
            path.append(min(m for m in near[path[-1]] if dist[m] == dist[path[-1]] - 1))
        path.reverse()
    return dist, part, path


@pytest.fixture(scope="module")
def grids(spark):
    draw_ = random.Random(5)
    made = [drawn(k, *size, share, draw_) for k, (size, share) in enumerate([((3, 3), 0.5), ((7, 4), 0.6), ((50, 3), 0.8), ((51, 4), 0.8), ((100, 6), 0.7), ((4, 60), 0.75), ((24, 24), 0.62), ((5, 5), 0.0)])]
    made.append(corridor(8, 60))
    edges = [e for _, es in made for e in es]
    table = spark.createDataFrame([g for g, _ in made], GRIDS)
    edges_table = spark.createDataFrame(edges + edges[:20], EDGES)  # some edges said twice
    return made, boards.boards_of_edges(table, edges_table, "start", "goal").cache()


def test_distances_paths_and_farthest_cells(grids):
    made, table = grids
    flooded = boards.with_flood(table, F.col("start"))
    every = {}
    for r in boards.all_distances(flooded, "graph_id").collect():
        every.setdefault(r.graph_id, {})[r.node] = r.dist
    reached = {}
    for r in boards.distances(flooded, "graph_id").collect():
        reached.setdefault(r.graph_id, {})[r.node] = r.dist
    far = flooded.select("graph_id", boards.farthest_cell(F.col("flood"), F.col("width")).alias("node"))
    far = {r.graph_id: r.node for r in far.collect()}
    for grid, edges in made:
        dist, _, _ = plain(grid, edges)
        assert reached[grid[0]] == dist
        assert every[grid[0]] == {n: dist.get(n, -1) for n in range(grid[1] * grid[2])}
        assert far[grid[0]] == min(n for n in dist if dist[n] == max(dist.values()))


def test_solutions_and_parts(grids):
    made, table = grids
    solved = {r.graph_id: r for r in boards.solve(table).collect()}
    labels = {}
    for r in boards.components(table).collect():
        labels.setdefault(r.graph_id, {})[r.node] = r.component
    sizes = {}
    for r in boards.component_sizes(table).collect():
        sizes.setdefault(r.graph_id, {})[r.component] = r["size"]
    for grid, edges in made:
        _, part, path = plain(grid, edges)
        assert labels[grid[0]] == part
        lows = sorted(set(part.values()))
        counted = {low: sum(p == low for p in part.values()) for low in lows}
        assert sizes[grid[0]] == counted
        r = solved[grid[0]]
        assert r.component_sizes == [counted[low] for low in lows]
        assert (r.solvable, r.path) == (path is not None, path)
        assert r.path_length == (len(path) - 1 if path else None)
        assert (lows[r.start_component], lows[r.goal_component]) == (part[grid[3]], part[grid[4]])


def test_no_grids_and_no_start(spark):
    none = boards.boards_of_edges(spark.createDataFrame([], GRIDS), spark.createDataFrame([], EDGES), "start", "goal")
    assert boards.solve(none).count() == 0 and boards.components(none).count() == 0
    one = boards.boards_of_edges(spark.createDataFrame([(1, 3, 3, None, 4)], GRIDS), spark.createDataFrame([], EDGES), "start", "goal")
    r = boards.solve(one).collect()[0]
    assert (r.path, r.path_length, r.component_sizes, r.goal_component) == (None, None, [1] * 9, 4)
    assert boards.distances(boards.with_flood(one, F.col("start")), "graph_id").count() == 0


def test_draws_inside_are_the_same_draws(spark):
    rows = spark.range(50).select((F.col("id") * 7919 - 100).alias("s"), (F.col("id") * 1_000_003).alias("k"))
    got = rows.select(draw(F.col("s"), F.col("k")).alias("a"), draw_inside(F.col("s"), F.col("k")).alias("b"))
    assert all(r.a == r.b for r in got.collect())


def test_drawings_meet_their_path_as_one_row(spark):
    """No cell is listed or joined, nothing is sent to every task; a repeated graph draws its cells beside each other."""
    rows = [(1, 2, 2, 0, 3), (2, 2, 2, 0, 3), (2, 2, 2, 0, 3), (3, 2, 1, None, 1), (None, 1, 1, 0, 0)]
    table = spark.createDataFrame(rows, "graph_id long, width int, height int, start int, goal int")
    edges = spark.createDataFrame([(g, a, b) for g in (1, 2) for a, b in ((0, 1), (1, 3))] + [(3, None, 1), (9, 0, 1)], "graph_id long, a int, b int")
    path = spark.createDataFrame([(g, k, n) for g in (1, 2) for k, n in enumerate((0, 1, 3))] + [(3, 0, None), (3, 0, 0), (3, None, 1)], "graph_id long, k int, node int")
    found = drawing.text_rows(table, edges, path)
    texts = {r.graph_id: r.text.split("\n") for r in drawing.whole_text(found).collect()}
    assert texts == {
        1: ["#####", "#S**#", "###*#", "#.#G#", "#####"],
        2: ["#####", "#S*S**#*#", "#####*#*#", "#.#.#G#G#", "#########"],
        3: ["#####", "#*#G#", "#####"],
        None: ["###", "#G#", "###"],
    }
    plain = {r.graph_id: r.text for r in drawing.whole_text(drawing.text_rows(table, edges, floor="__", wall="é")).collect()}
    assert plain[1] == "ééééé\néS____é\nééé__é\né__éGé\nééééé"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
    wide = spark.createDataFrame([(1, 70, 2), (2, 3, 1)], "graph_id long, width int, height int")
    over = spark.createDataFrame([(1, 49, 50), (1, 50, 120), (1, 69, 139), (1, 200, 201), (2, 1, 2)], "graph_id long, a int, b int")
    made = boards.boards_of_edges(wide, over)
    assert {r.graph_id: (r.words, r.right, r.down) for r in made.collect()} == {1: (2, [1 << 49, 0, 0, 0], [0, 1 | 1 << 19, 0, 0]), 2: (1, [2], [0])}
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
