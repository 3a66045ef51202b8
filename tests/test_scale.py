"""Work of few small rows is dealt to all cores, and stays small on its way."""


import random
import time

import numpy as np
from pyspark.sql import functions as F

from catalog import files, inputs
from gridtwin.functions import rng
from gridtwin.operators import connectivity, fields, grids, lattice, trees
from gridtwin.operators.rooms import cells_level
from gridtwin.session import cut

SMALL = "/root/testdata/sf0.001"


def params(spark, rows):
    return spark.createDataFrame(rows, "graph_id long, width int, height int").coalesce(1)


def test_cells_of_one_file_are_made_by_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    one_file = params(spark, [(k, 6, 6) for k in range(100)])
    for made in (grids.grid_nodes(one_file), grids.grid_edges(one_file), inputs.room_cells(spark, SMALL)):
        assert made.rdd.getNumPartitions() >= cores


def test_open_sides_of_wide_grids_repeated_rows_and_no_edges(spark):
    table = params(spark, [(1, 70, 2), (2, 3, 3), (2, 3, 3), (3, 4, 1), (None, 2, 2)])
    edges = spark.createDataFrame([(1, 49, 50), (1, 50, 120), (2, 0, 3), (2, 0, 3), (2, 4, 5), (9, 0, 1)], "graph_id long, a int, b int")
    found = grids.open_sides(table, edges).collect()
    right = sorted((r.graph_id, r.node) for r in found if r.right)
    down = sorted((r.graph_id, r.node) for r in found if r.down)
    assert right == [(1, 49), (2, 4), (2, 4)] and down == [(1, 50), (2, 0), (2, 0)]
    assert len(found) == 140 + 18 + 4 + 4
    rows = {r.graph_id: r for r in grids.rows_from_edges(table, edges).collect()}
    assert rows[2].right[1] == [0, 0, 1, 1, 0, 0] and rows[3].down == [[0] * 4]
    once = grids.rows_from_edges(table.where("graph_id = 1"), edges)
    assert {tuple(r) for r in grids.edges_from_rows(once).collect()} == {(1, 49, 50), (1, 50, 120)}


def test_small_graphs_take_no_written_rounds(spark, monkeypatch):
    """Forests and walks inside tasks equal those of the rounds, and write nothing on the way."""
    draw_ = random.Random(3)
    edges = [(g, a, b, draw_.choice([0.25, 0.5, draw_.random()])) for g in range(40) for a, b in {tuple(sorted(draw_.sample(range(-3, 9), 2))) for _ in range(14)}]
    table = spark.createDataFrame(edges, "graph_id long, a int, b int, w double").repartition(3)
    grid = spark.createDataFrame([(k, 3 + k % 5, 4) for k in range(20)], "graph_id long, width int, height int")
    weighted = grids.grid_edges(grid).withColumn("w", F.xxhash64("graph_id", "edge_no").cast("double"))
    roots = grid.select("graph_id", (F.col("graph_id") % 7).cast("int").alias("root"))

    def results():
        tree = connectivity.spanning_forest(weighted)
        found = connectivity.spanning_forest(table), tree, trees.rooted(tree, roots)
        return [(part.schema.simpleString(), {tuple(r) for r in part.collect()}) for part in found]

    def no_rounds(*_, **__):
        raise AssertionError("a round was written")

    with monkeypatch.context() as patched:
        for module, name in ((connectivity, "cut"), (connectivity, "cut_counting"), (connectivity, "cut_observing"), (trees, "cut_counting")):
            patched.setattr(module, name, no_rounds)
        inside = results()
    monkeypatch.setattr(lattice, "MOST_EDGES", 0)
    assert inside == results()


def test_listed_cells_are_not_joined(spark):
    """Cells of a field are listed after their rooms met: no join reads them, whatever their size is thought to be."""
    rooms = spark.createDataFrame([(k, k) for k in range(5)], "room_id long, seed long")
    field = fields.obstacle_fields(rooms)
    plan = fields.with_open_neighbours(fields.free_cells(field, 16))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and plan.count("Join") == 1
    assert {r.text for r in fields.field_texts(field).collect()} == {r.text for r in cells_level(fields.field_levels(field)).collect()}


def test_files_of_one_table_are_written_by_many_tasks(spark, tmp_path):
    texts = spark.createDataFrame([(f"line {k}", k) for k in [*range(64), 7]], "value string, key int").coalesce(1)
    files.files_of(texts, "key", f"{tmp_path}/sidecars")
    names = [path.name for path in tmp_path.glob("sidecars/key=*/*.txt")]
    assert len(names) == 64  # the repeated key has one file of two lines
    assert len({name.split("-")[1] for name in names}) >= spark.sparkContext.defaultParallelism
    assert next(tmp_path.glob("sidecars/key=7/*.txt")).read_text() == "line 7\nline 7\n"


def test_edges_that_a_block_rules_out_do_not_enter_the_rounds(spark, monkeypatch):
    draw = random.Random(5)
    pairs = sorted({(-1 - draw.randrange(12), draw.randrange(300)) for _ in range(6000)})
    rows = [(0, a, b, float(draw.randrange(9))) for a, b in pairs]
    edges = spark.createDataFrame(rows, "graph_id int, a long, b long, w double")
    monkeypatch.setattr(lattice, "MOST_EDGES", 100)  # not small: the forest is made in rounds
    seen = []
    rounds = connectivity._contract
    monkeypatch.setattr(connectivity, "_contract", lambda live, weight: seen.append(live.count()) or rounds(live, weight))
    found = {(r.a, r.b) for r in connectivity.spanning_forest(edges).collect()}
    parent = {n: n for _, a, b, _ in rows for n in (a, b)}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    wanted = set()
    for _, a, b, _ in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if top(a) != top(b):
            parent[top(a)] = top(b)
            wanted.add((a, b))
    assert found == wanted
    assert len(seen) == 1 and seen[0] < len(rows) / 2


def test_shuffle_files_of_a_written_cut_are_removed(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}
    before = files()
    written = cut(spark.range(1000, numPartitions=8).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(20):
        left = files() - before
        if not left:
            break
        time.sleep(0.5)
    assert not left
    assert sorted(written.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


def joins_listed_cells(df):
    """Whether a join stands above rows that were listed from arrays."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "Generate " in line:
            above = depth(line)
            for other in reversed(lines[:at]):
                if depth(other) < above:
                    above = depth(other)
                    if "Join " in other:
                        return True
    return False


def mechanics_of(spark):
    return fields.obstacle_fields(spark.createDataFrame([(k, 3 * k) for k in range(12)], "room_id long, seed long"))


def test_frozen_cells_are_listed_after_their_rooms_met_the_seeds(spark):
    field = mechanics_of(spark)
    frozen = fields.frozen_cells(field, 16)
    assert not joins_listed_cells(frozen)
    free = {(r.room_id, r.node) for r in fields.free_cells(field, 16).collect()}
    u = lambda room, k: rng.draws(np.array([3 * room]), fields.ICE + k)[0]
    wanted = {(r, n) for r, n in free if u(r, 1 + n) < fields.ICE_SHARE + u(r, 0) * fields.ICE_SPREAD}
    assert wanted and {(r.room_id, r.node) for r in frozen.collect()} == wanted
    assert all(r.node == r.y * 16 + r.x for r in frozen.collect())


def test_pits_meet_the_spots_of_their_room_in_one_row(spark):
    field = mechanics_of(spark)
    pits = [(r.room_id, i, r.node, r.node % 16, r.node // 16) for r in fields.free_cells(field, 16).where("node % 50 = 4").collect() for i in (0, 1)]
    holes = spark.createDataFrame(pits, "room_id long, i int, node int, x int, y int")
    fillers = fields.hole_fillers(field, holes, 16)
    assert not joins_listed_cells(fillers)
    taken = {(room, node) for room, _, node, _, _ in pits}
    free = {(r.room_id, r.node): r for r in fields.free_cells(field, 16).collect() if (r.room_id, r.node) not in taken}
    around = lambda room, n: sum((room, n + step) in free for step in (1, -1, 16, -16))
    spots = {}
    for (room, n), r in free.items():
        if around(room, n) >= 2 and abs(r.x - r.start_x) + abs(r.y - r.start_y) > 1:
            spots.setdefault(room, []).append((rng.draws(np.array([3 * room]), fields.SPOT + n)[0], n))
    wanted = []
    for room, i, node, x, y in pits:
        ranked = sorted(spots.get(room, []))
        near = [n for _, n in ranked if 2 <= abs(n % 16 - x) + abs(n // 16 - y) <= 5]
        wanted += [(room, node, n) for n in (near or [n for _, n in ranked[i : i + 1]])[:1]]
    assert sorted((r.room_id, r.hole, r.filler) for r in fillers.collect()) == sorted(wanted)


def test_button_lines_are_found_without_listing_cells(spark):
    field = mechanics_of(spark)
    lines = fields.button_lines(field, 16)
    assert "Generate" not in lines._jdf.queryExecution().optimizedPlan().toString()
    rows = {}
    for r in fields.free_cells(field, 16).collect():
        rows.setdefault(r.room_id, {})[r.node] = r
    paths = {r.room_id: r.path for r in field["paths"].collect()}
    wanted = set()
    for room, free in rows.items():
        u = lambda k: rng.draws(np.array([3 * room]), k)[0]  # noqa: B023, E731
        apart = lambda r, x, y: abs(r.x - x) + abs(r.y - y) > 1
        away = {n for n, r in free.items() if apart(r, r.start_x, r.start_y) and apart(r, r.goal_x, r.goal_y)}
        walls = sorted((u(fields.PLACE + n), n) for n in away & set(paths[room]))
        if not walls:
            continue
        wall = walls[0][1]
        standing = set(free) - {wall}
        tries = [
            (u(fields.SPOT + n), n, u(fields.TURN + 4 * n + way), n + step)
            for n in away & standing
            if apart(free[n], wall % 16, wall // 16)
            for way, step in enumerate((1, -1, 16, -16))
            if n + step in standing and n - step in standing
        ]
        wanted.add((room, wall, *((min(tries)[1], min(tries)[3]) if tries else (None, None))))
    assert wanted and {tuple(r) for r in lines.select("room_id", "wall", "box", "button").collect()} == wanted


def test_boxes_and_pits_are_chosen_inside_their_rooms_row(spark):
    """Only the first cells of a room leave its row; repeated rooms choose among the cells of all their rows."""
    field = mechanics_of(spark)
    boxes = fields.placed_boxes(field, 16)
    assert not joins_listed_cells(boxes) and not joins_listed_cells(fields.placed_holes(field, 16))
    paths = {r.room_id: set(r.path) for r in field["paths"].collect()}
    spots = {}
    for r in fields.with_open_neighbours(fields.free_cells(field, 16)).collect():
        if r.around >= 2 and abs(r.x - r.start_x) + abs(r.y - r.start_y) > 2 and abs(r.x - r.goal_x) + abs(r.y - r.goal_y) > 1:
            u = rng.draws(np.array([3 * r.room_id]), fields.PLACE + 1 + r.node)[0]
            spots.setdefault(r.room_id, []).append((r.node not in paths[r.room_id], u, r.node))
    wanted = []
    for room, found in spots.items():
        most = int(rng.draws(np.array([3 * room]), fields.PLACE)[0] * 3) + 1
        wanted += [(room, i, n, n % 16, n // 16, not off) for i, (off, _, n) in enumerate(sorted(found)[:most])]
    assert sorted(tuple(r) for r in boxes.collect()) == sorted(wanted)
    twice = {part: table.unionAll(table) for part, table in field.items()}
    of_twice = fields.placed_boxes(twice, 16).collect()
    assert {r.room_id: r.node for r in of_twice if r.i == 0} == {r[0]: r[2] for r in wanted if r[1] == 0}
    assert all((r.i, r.node) in {(i, w[2]) for w in wanted if w[0] == r.room_id for i in range(3)} for r in of_twice)


def test_listed_cells_do_not_carry_the_boards_of_their_room(spark):
    field = fields.obstacle_fields(spark.createDataFrame([(k, k) for k in (1, 2, 3, 3)], "room_id long, seed long"))
    free = fields.free_cells(field, 16)
    assert not [kind for _, kind in free.dtypes if kind.startswith("array")]
    cells = [(r.room_id, r.node) for r in free.collect()]
    beside = lambda room, n: sum(cells.count((room, n + step)) for step in (1, -1, 16, -16))
    found = fields.with_open_neighbours(free).collect()
    # a repeated room has each cell once for every pair of its rows, and as many boards
    assert found and all(r.around == beside(r.room_id, r.node) for r in found)


def test_texts_of_fields_are_written_by_a_kernel(spark):
    field = fields.obstacle_fields(spark.createDataFrame([(k, k) for k in (1, 2, 3, 3, 4)] + [(2, 9)], "room_id long, seed long"), 9)
    texts = fields.field_texts(field, 9)
    assert "MapInArrow" in texts._jdf.queryExecution().optimizedPlan().toString()
    wanted = {}
    for r in fields.field_levels(field, size=9).collect():
        wanted.setdefault(r.room_id, {}).setdefault(r.y, {}).setdefault(r.x, []).append(r.cell)
    lines = lambda grid: "".join(" ".join(" ".join(sorted(grid[y][x])) for x in range(9)) + "\n" for y in range(9))
    assert {r.room_id: r.text for r in texts.collect()} == {room: lines(grid) for room, grid in wanted.items()}
