"""Grid graphs, connectivity and minimal pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs, sqltext as sql
from catalog.registry import query
from gridtwin.operators import boards, connectivity, grids, minimal_pairs, trees
from gridtwin.session import cut

PARAMS, NODES, EDGES, MAZE = inputs.GRID_PARAMS, inputs.GRID_NODES, inputs.GRID_EDGES, inputs.MAZE_EDGES

# --- parameter table -------------------------------------------------------------------
REQUESTS = """SELECT o_orderkey AS graph_id, (['easy', 'medium', 'hard', 'extreme', NULL, 'odd'])[o_orderkey % 6 + 1] AS preset,
  'run ' || o_custkey AS seed_text,
  CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 130)::INTEGER END AS width,
  CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey % 40)::INTEGER END AS height,
  CASE WHEN o_orderkey % 11 = 0 THEN 'wilson' WHEN o_orderkey % 11 = 1 THEN 'prim' END AS algorithm,
  CASE WHEN o_orderkey % 13 = 0 THEN 'middle' WHEN o_orderkey % 13 = 1 THEN 'border' END AS placement,
  (['0.25', '1.5', 'random', 'half', NULL])[o_orderkey % 5 + 1] AS cut,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 9 - 2)::INTEGER END AS loops,
  CASE WHEN o_orderkey % 4 = 0 THEN 7 END AS min_distance FROM orders"""


def _resolved(key: str, default: str, easy: str, medium: str, hard: str, extreme: str) -> str:
    return (
        f"coalesce({key}, CASE preset WHEN 'easy' THEN {easy} WHEN 'medium' THEN {medium} "
        f"WHEN 'hard' THEN {hard} WHEN 'extreme' THEN {extreme} ELSE {default} END) AS {key}"
    )


@query(
    "grid_parameters",
    f"""SELECT graph_id, width, height, {sql.seed_of_text('seed_text')} AS seed, algorithm, placement,
    CASE WHEN cut IN ('balanced', 'random') THEN cut ELSE 'fixed' END AS cut_mode,
    CASE WHEN cut NOT IN ('balanced', 'random') THEN TRY_CAST(cut AS DOUBLE) END AS cut_pos,
    greatest(loops, 0) AS loops,
    coalesce(min_distance, greatest(2, ceil(greatest(width, height) / 2)))::INTEGER AS min_distance,
    CASE WHEN preset = 'odd' THEN 'unknown preset'
      WHEN width NOT BETWEEN 3 AND 100 OR height NOT BETWEEN 3 AND 100 THEN 'width and height must be between 3 and 100'
      WHEN algorithm NOT IN ('backtracker', 'kruskal', 'prim') THEN 'unknown algorithm'
      WHEN placement NOT IN ('random', 'border', 'corners', 'far') THEN 'unknown placement'
      WHEN cut IN ('balanced', 'random') THEN NULL WHEN TRY_CAST(cut AS DOUBLE) IS NULL THEN 'unknown cut'
      WHEN TRY_CAST(cut AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'numeric cut must lie in [0, 1]' END AS reason
    FROM (SELECT graph_id, preset, seed_text, min_distance,
      {_resolved('width', '10', '6', '10', '16', '24')}, {_resolved('height', '10', '6', '10', '16', '24')},
      coalesce(algorithm, 'backtracker') AS algorithm,
      {_resolved('placement', "'random'", "'random'", "'random'", "'far'", "'far'")},
      {_resolved('cut', "'balanced'", "'random'", "'balanced'", "'balanced'", "'balanced'")},
      {_resolved('loops', '3', '1', '3', '6', '12')} FROM ({REQUESTS}))""",
)
def grid_parameters(spark, sf_dir):
    key = F.col("o_orderkey")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    requests = inputs.table(spark, sf_dir, "orders").select(
        key.alias("graph_id"),
        pick(("easy", "medium", "hard", "extreme", None, "odd"), key % 6).alias("preset"),
        F.concat(F.lit("run "), "o_custkey").alias("seed_text"),
        F.when(key % 5 == 0, (key % 130).cast("int")).alias("width"),
        F.when(key % 7 == 0, (key % 40).cast("int")).alias("height"),
        F.when(key % 11 == 0, "wilson").when(key % 11 == 1, "prim").alias("algorithm"),
        F.when(key % 13 == 0, "middle").when(key % 13 == 1, "border").alias("placement"),
        pick(("0.25", "1.5", "random", "half", None), key % 5).alias("cut"),
        F.when(key % 3 == 0, (key % 9 - 2).cast("int")).alias("loops"),
        F.when(key % 4 == 0, F.lit(7)).alias("min_distance"),
    )
    return minimal_pairs.resolve_params(requests)


# --- grids ---------------------------------------------------------------------------------
@query("grid_edges", f"SELECT graph_id, a, b, edge_no FROM ({EDGES})")
def grid_edges(spark, sf_dir):
    return grids.grid_edges(inputs.grid_params(spark, sf_dir))


OPEN_SIDES = f"""SELECT n.graph_id, n.width, n.height, n.node, n.x, n.y, CASE WHEN r.a IS NULL THEN 0 ELSE 1 END AS right_open,
  CASE WHEN d.a IS NULL THEN 0 ELSE 1 END AS down_open FROM ({NODES}) n
  LEFT JOIN ({MAZE}) r ON r.graph_id = n.graph_id AND r.a = n.node AND r.b = n.node + 1
  LEFT JOIN ({MAZE}) d ON d.graph_id = n.graph_id AND d.a = n.node AND d.b = n.node + n.width"""
MAZE_ROWS = f"""SELECT graph_id, string_agg(rights, '/' ORDER BY y) AS right_rows, string_agg(downs, '/' ORDER BY y) AS down_rows
  FROM (SELECT graph_id, y, string_agg(right_open::VARCHAR, '' ORDER BY x) AS rights,
    string_agg(down_open::VARCHAR, '' ORDER BY x) AS downs FROM ({OPEN_SIDES}) GROUP BY graph_id, y) GROUP BY graph_id"""


@query("passage_rows", MAZE_ROWS)
def passage_rows(spark, sf_dir):
    rows = grids.rows_from_edges(inputs.grid_params(spark, sf_dir), inputs.maze_edges(spark, sf_dir))
    flat = lambda c: F.array_join(F.transform(c, lambda row: F.array_join(row.cast("array<string>"), "")), "/")
    return rows.select("graph_id", flat("right").alias("right_rows"), flat("down").alias("down_rows"))


@query("edges_from_passage_rows", MAZE)
def edges_from_passage_rows(spark, sf_dir):
    """There and back: rows are built from the edges and read again."""
    rows = grids.rows_from_edges(inputs.grid_params(spark, sf_dir), inputs.maze_edges(spark, sf_dir))
    return grids.edges_from_rows(rows)


@query(
    "cell_distances",
    f"""SELECT graph_id, node, abs(x - seed % width) + abs(y - (seed % (width * height)) // width) AS apart FROM ({NODES})""",
)
def cell_distances(spark, sf_dir):
    nodes = grids.grid_nodes(inputs.grid_params(spark, sf_dir), "seed")
    mark = F.col("seed") % (F.col("width") * F.col("height"))
    return nodes.select("graph_id", "node", grids.manhattan(F.col("node"), mark, F.col("width")).alias("apart"))


@query("passage_counts", f"SELECT graph_id, count(*) AS passages FROM ({MAZE}) GROUP BY graph_id")
def passage_counts(spark, sf_dir):
    return grids.count_passages(inputs.maze_edges(spark, sf_dir))


@query(
    "wall_segments",
    f"""SELECT graph_id, 'h' AS kind, x, y FROM (SELECT graph_id, x, 0 AS y FROM ({NODES}) WHERE y = 0
      UNION ALL SELECT graph_id, x, y + 1 FROM ({OPEN_SIDES}) WHERE down_open = 0)
    UNION ALL SELECT graph_id, 'v', x, y FROM (SELECT graph_id, 0 AS x, y FROM ({NODES}) WHERE x = 0
      UNION ALL SELECT graph_id, x + 1, y FROM ({OPEN_SIDES}) WHERE right_open = 0)""",
)
def wall_segments(spark, sf_dir):
    return grids.wall_segments(inputs.grid_params(spark, sf_dir), inputs.maze_edges(spark, sf_dir))


TEXT_ROWS = f"""SELECT graph_id, 2 * y + 1 AS line, '#' || string_agg((CASE node WHEN width * height - 1 THEN 'G' WHEN 0 THEN 'S'
    ELSE '.' END) || (CASE right_open WHEN 1 THEN '.' ELSE '#' END), '' ORDER BY x) AS text
  FROM ({OPEN_SIDES}) GROUP BY graph_id, y
  UNION ALL SELECT graph_id, 2 * y + 2, '#' || string_agg((CASE down_open WHEN 1 THEN '.#' ELSE '##' END), '' ORDER BY x)
  FROM ({OPEN_SIDES}) GROUP BY graph_id, y
  UNION ALL SELECT graph_id, 0, repeat('#', 2 * width + 1) FROM ({PARAMS})"""


def with_corners(params):
    return params.withColumn("start", F.lit(0)).withColumn("goal", (F.col("width") * F.col("height") - 1).cast("int"))


@query(
    "maze_drawings",
    f"SELECT graph_id, string_agg(text, chr(10) ORDER BY line) AS text FROM ({TEXT_ROWS}) GROUP BY graph_id",
)
def maze_drawings(spark, sf_dir):
    params = with_corners(inputs.grid_params(spark, sf_dir))
    return grids.whole_text(grids.text_rows(params, inputs.maze_edges(spark, sf_dir)))


# --- connectivity ------------------------------------------------------------------------------
ARCS = f"SELECT graph_id, a AS u, b AS v FROM ({MAZE}) UNION ALL SELECT graph_id, b, a FROM ({MAZE})"
WITH_LABELS = f"""arcs AS MATERIALIZED ({ARCS}), cells AS MATERIALIZED ({NODES}),
  reach(graph_id, u, v) AS (SELECT graph_id, node, node FROM cells
    UNION SELECT r.graph_id, r.u, a.v FROM reach r JOIN arcs a ON a.graph_id = r.graph_id AND a.u = r.v),
  labels AS MATERIALIZED (SELECT graph_id, v AS node, min(u) AS component FROM reach GROUP BY graph_id, v)"""


@query("components_of_grids", f"WITH RECURSIVE {WITH_LABELS} SELECT graph_id, node, component FROM labels")
def components_of_grids(spark, sf_dir):
    return boards.components(inputs.maze_boards(spark, sf_dir))


@query(
    "component_sizes_of_grids",
    f"WITH RECURSIVE {WITH_LABELS} SELECT graph_id, component, count(*) AS size FROM labels GROUP BY graph_id, component",
)
def component_sizes_of_grids(spark, sf_dir):
    sizes = boards.component_sizes(inputs.maze_boards(spark, sf_dir))
    return sizes.withColumn("size", F.col("size").cast("bigint"))


@query(
    "components_of_suppliers_and_parts",
    """WITH RECURSIVE edges AS MATERIALIZED (SELECT DISTINCT -(l_suppkey + 1) AS a, l_partkey AS b FROM lineitem),
    arcs AS MATERIALIZED (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges),
    labels(node, component) USING KEY (node) AS (
      SELECT u, min(least(u, v)) FROM arcs GROUP BY u
      UNION SELECT a.v, min(l.component) FROM labels l JOIN arcs a ON a.u = l.node
        JOIN recurring.labels k ON k.node = a.v WHERE l.component < k.component GROUP BY a.v)
    SELECT component, count(*) AS size FROM labels GROUP BY component""",
)
def components_of_suppliers_and_parts(spark, sf_dir):
    """One graph over all line items, with hubs."""
    edges = cut(inputs.part_supplier_edges(spark, sf_dir), "edges")
    nodes = edges.select("graph_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = connectivity.components(edges, nodes)
    return connectivity.component_sizes(labels).select("component", "size")


DIST = f"""arcs AS MATERIALIZED ({ARCS}), cells AS MATERIALIZED ({NODES}),
  walk(graph_id, node, dist) USING KEY (graph_id, node) AS (
    SELECT graph_id, node, 0 FROM cells WHERE node = 0
    UNION SELECT w.graph_id, a.v, min(w.dist) + 1 FROM walk w JOIN arcs a ON a.graph_id = w.graph_id AND a.u = w.node
      LEFT JOIN recurring.walk k ON k.graph_id = a.graph_id AND k.node = a.v WHERE k.node IS NULL GROUP BY w.graph_id, a.v)"""


@query(
    "distances_from_corner",
    f"""WITH RECURSIVE {DIST} SELECT c.graph_id, c.node, coalesce(w.dist, -1)::INTEGER AS dist FROM cells c
    LEFT JOIN walk w ON w.graph_id = c.graph_id AND w.node = c.node""",
)
def distances_from_corner(spark, sf_dir):
    return boards.all_distances(boards.with_flood(inputs.maze_boards(spark, sf_dir), F.col("start")), "graph_id")


@query(
    "farthest_cells",
    f"""WITH RECURSIVE {DIST} SELECT graph_id, node, dist::INTEGER AS dist FROM walk
    QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY dist DESC, node) = 1""",
)
def farthest_cells(spark, sf_dir):
    width, flood = F.col("width"), F.col("flood")
    found = boards.with_flood(inputs.maze_boards(spark, sf_dir), F.col("start"))
    found = found.withColumn("node", boards.farthest_cell(flood, width))
    return found.select("graph_id", "node", boards.distance_to(flood, F.col("node"), width).alias("dist"))


PATHS = f"""{DIST}, back AS MATERIALIZED (SELECT a.graph_id, a.u AS node, min(a.v) AS back FROM arcs a
    JOIN walk x ON x.graph_id = a.graph_id AND x.node = a.u JOIN walk y ON y.graph_id = a.graph_id AND y.node = a.v
    WHERE y.dist = x.dist - 1 GROUP BY a.graph_id, a.u),
  path(graph_id, node, k) AS (SELECT w.graph_id, w.node, w.dist FROM walk w JOIN ({PARAMS}) p ON p.graph_id = w.graph_id
      AND w.node = p.width * p.height - 1
    UNION ALL SELECT p.graph_id, b.back, p.k - 1 FROM path p JOIN back b ON b.graph_id = p.graph_id AND b.node = p.node)"""


def corner_path(spark, sf_dir):
    found = boards.with_flood(inputs.maze_boards(spark, sf_dir), F.col("start"))
    path = boards.path_to(F.col("flood"), F.col("goal"), F.col("right"), F.col("down"), F.col("width"))
    steps = found.select("graph_id", F.posexplode_outer(path).alias("k", "node"))
    return steps.where(F.col("node").isNotNull())


@query("shortest_paths", f"WITH RECURSIVE {PATHS} SELECT graph_id, k::INTEGER AS k, node FROM path")
def shortest_paths(spark, sf_dir):
    return corner_path(spark, sf_dir)


@query(
    "solved_grids",
    f"""WITH RECURSIVE {WITH_LABELS}, {PATHS.replace(f'arcs AS MATERIALIZED ({ARCS}), cells AS MATERIALIZED ({NODES}),', '')},
    parts AS (SELECT graph_id, component, count(*) AS size,
      row_number() OVER (PARTITION BY graph_id ORDER BY component) - 1 AS number FROM labels GROUP BY graph_id, component),
    numbered AS (SELECT l.graph_id, l.node, p.number FROM labels l JOIN parts p USING (graph_id, component))
    SELECT g.graph_id, s.number = t.number AS solvable, w.dist::INTEGER AS path_length,
      (SELECT string_agg(size::VARCHAR, ',' ORDER BY number) FROM parts p WHERE p.graph_id = g.graph_id) AS component_sizes,
      s.number::INTEGER AS start_component, t.number::INTEGER AS goal_component, c.cells AS path
    FROM ({PARAMS}) g JOIN numbered s ON s.graph_id = g.graph_id AND s.node = 0
    JOIN numbered t ON t.graph_id = g.graph_id AND t.node = g.width * g.height - 1
    LEFT JOIN walk w ON w.graph_id = g.graph_id AND w.node = g.width * g.height - 1
    LEFT JOIN (SELECT graph_id, string_agg(node::VARCHAR, ',' ORDER BY k) AS cells FROM path GROUP BY graph_id) c
      ON c.graph_id = g.graph_id""",
)
def solved_grids(spark, sf_dir):
    solved = boards.solve(inputs.maze_boards(spark, sf_dir))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return solved.select(
        "graph_id", "solvable", "path_length", joined("component_sizes"), "start_component", "goal_component", joined("path")
    )


@query(
    "maze_drawings_with_path",
    f"""WITH RECURSIVE {PATHS}, steps AS (SELECT p.graph_id, p.node, q.node AS other FROM path p JOIN path q
        ON q.graph_id = p.graph_id AND q.k IN (p.k - 1, p.k + 1)),
    marked AS (SELECT o.*, EXISTS (SELECT 1 FROM path p WHERE p.graph_id = o.graph_id AND p.node = o.node) AS visited,
      EXISTS (SELECT 1 FROM steps s WHERE s.graph_id = o.graph_id AND s.node = o.node AND s.other = o.node + 1) AS to_right,
      EXISTS (SELECT 1 FROM steps s WHERE s.graph_id = o.graph_id AND s.node = o.node AND s.other = o.node + o.width) AS to_down
      FROM ({OPEN_SIDES}) o)
    SELECT graph_id, 2 * y + 1 AS line, '#' || string_agg((CASE WHEN node = width * height - 1 THEN 'G' WHEN node = 0 THEN 'S'
      WHEN visited THEN '*' ELSE '.' END) || (CASE WHEN to_right THEN '*' WHEN right_open = 1 THEN '.' ELSE '#' END), '' ORDER BY x) AS text
    FROM marked GROUP BY graph_id, y
    UNION ALL SELECT graph_id, 2 * y + 2, '#' || string_agg((CASE WHEN to_down THEN '*#' WHEN down_open = 1 THEN '.#' ELSE '##' END), '' ORDER BY x)
    FROM marked GROUP BY graph_id, y
    UNION ALL SELECT graph_id, 0, repeat('#', 2 * width + 1) FROM ({PARAMS})""",
)
def maze_drawings_with_path(spark, sf_dir):
    params = with_corners(inputs.grid_params(spark, sf_dir))
    return grids.text_rows(params, inputs.maze_edges(spark, sf_dir), corner_path(spark, sf_dir))


# --- spanning trees -----------------------------------------------------------------------------
# an edge belongs to the forest unless its ends are connected by lighter edges
WITH_TREE = f"""grid AS MATERIALIZED (SELECT *, {sql.draw('seed', 'edge_no')} AS w FROM ({EDGES})),
  garcs AS MATERIALIZED (SELECT graph_id, a AS u, b AS v, w FROM grid UNION ALL SELECT graph_id, b, a, w FROM grid),
  lighter(graph_id, edge_no, w, node) AS (SELECT graph_id, edge_no, w, a FROM grid
    UNION SELECT l.graph_id, l.edge_no, l.w, g.v FROM lighter l JOIN garcs g ON g.graph_id = l.graph_id AND g.u = l.node AND g.w < l.w),
  tree AS MATERIALIZED (SELECT g.graph_id, g.seed, g.a, g.b FROM grid g ANTI JOIN lighter l
    ON l.graph_id = g.graph_id AND l.edge_no = g.edge_no AND l.node = g.b)"""


@query("spanning_trees", f"WITH RECURSIVE {WITH_TREE} SELECT graph_id, a, b FROM tree")
def spanning_trees(spark, sf_dir):
    grid = minimal_pairs.weighted_grid(inputs.grid_params(spark, sf_dir))
    return connectivity.spanning_forest(grid)


#: Rounds that SQL spells out; each at least halves the parts, so they do for 2^20 suppliers and parts.
ROUNDS = 20


def forest_round(n: int) -> str:
    """The lightest link of each part before round n, and the links between the parts it leaves."""
    return f"""best{n} AS MATERIALIZED (SELECT c, arg_min(ROW(a, b, other), ROW(w, a, b)) AS e FROM (
      SELECT ca AS c, cb AS other, w, a, b FROM live{n} UNION ALL SELECT cb, ca, w, a, b FROM live{n}) GROUP BY c),
  joins{n} AS MATERIALIZED (SELECT c AS u, e[3] AS v FROM best{n} UNION ALL SELECT e[3], c FROM best{n}),
  part{n}(node, part) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM joins{n} GROUP BY u
    UNION SELECT j.v, min(l.part) FROM part{n} l JOIN joins{n} j ON j.u = l.node
      JOIN recurring.part{n} k ON k.node = j.v WHERE l.part < k.part GROUP BY j.v),
  live{n + 1} AS MATERIALIZED (SELECT x.part AS ca, y.part AS cb, w, a, b FROM live{n} l
    JOIN part{n} x ON x.node = l.ca JOIN part{n} y ON y.node = l.cb WHERE x.part <> y.part)"""


@query(
    "spanning_forest_of_suppliers_and_parts",
    f"""WITH RECURSIVE live0 AS MATERIALIZED (SELECT a AS ca, b AS cb, {sql.draw('-a', 'b')} AS w, a, b
      FROM (SELECT DISTINCT -(l_suppkey + 1) AS a, l_partkey AS b FROM lineitem)),
  {(","  + chr(10) + "  ").join(forest_round(n) for n in range(ROUNDS))}
  {" UNION ".join(f"SELECT e[1] AS a, e[2] AS b FROM best{n}" for n in range(ROUNDS))}""",
)
def spanning_forest_of_suppliers_and_parts(spark, sf_dir):
    """Lightest links that keep every supplier and part of all line items connected."""
    from gridtwin.functions.rng import draw

    edges = inputs.part_supplier_edges(spark, sf_dir)
    return connectivity.spanning_forest(edges.withColumn("w", draw(-F.col("a"), F.col("b")))).select("a", "b")


# --- minimal pairs --------------------------------------------------------------------------------
N_CELLS = "width * height"
RANDOM_ENDS = f"""SELECT graph_id, arg_min(s, attempt) AS start, arg_min(t, attempt) AS goal FROM (
  SELECT graph_id, attempt, width, min_distance, {sql.draw_int('seed', '1048576 + attempt * 2', N_CELLS)} AS s,
    {sql.draw_int('seed', '1048576 + attempt * 2 + 1', N_CELLS)} AS t
  FROM ({PARAMS}), (SELECT unnest(range(1024)) AS attempt) WHERE placement = 'random')
  WHERE s <> t AND abs(s % width - t % width) + abs(s // width - t // width) >= min_distance GROUP BY graph_id"""
SPAN = "(CASE WHEN side < 2 THEN height ELSE width END)"
BORDER_ENDS = f"""SELECT graph_id, CASE side WHEN 0 THEN p * width WHEN 1 THEN p * width + width - 1 WHEN 2 THEN p
    ELSE (height - 1) * width + p END AS start,
  CASE side WHEN 0 THEN q * width + width - 1 WHEN 1 THEN q * width WHEN 2 THEN (height - 1) * width + q ELSE q END AS goal
  FROM (SELECT *, {sql.draw_int('seed', '1048577', SPAN)} AS p, {sql.draw_int('seed', '1048578', SPAN)} AS q
    FROM (SELECT *, {sql.draw_int('seed', '1048576', '4')} AS side FROM ({PARAMS}) WHERE placement = 'border'))"""
# every cell of the tree with its way from the start
WITH_WAYS = f"""{WITH_TREE},
  starts AS MATERIALIZED (SELECT graph_id, start, goal FROM ({RANDOM_ENDS}) UNION ALL SELECT * FROM ({BORDER_ENDS})
    UNION ALL SELECT graph_id, 0, {N_CELLS} - 1 FROM ({PARAMS}) WHERE placement = 'corners'
    UNION ALL SELECT graph_id, {sql.draw_int('seed', '1048576', N_CELLS)}, NULL FROM ({PARAMS}) WHERE placement = 'far'),
  tarcs AS MATERIALIZED (SELECT graph_id, a AS u, b AS v FROM tree UNION ALL SELECT graph_id, b, a FROM tree),
  ways(graph_id, node, way) AS (SELECT graph_id, start, [start] FROM starts
    UNION ALL SELECT w.graph_id, t.v, list_append(w.way, t.v) FROM ways w JOIN tarcs t ON t.graph_id = w.graph_id AND t.u = w.node
      WHERE NOT list_contains(w.way, t.v)),
  waysm AS MATERIALIZED (SELECT * FROM ways),
  ends AS MATERIALIZED (SELECT s.graph_id, s.start, coalesce(s.goal, f.node) AS goal FROM starts s
    LEFT JOIN (SELECT graph_id, node FROM waysm QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY len(way) DESC, node) = 1) f
      ON f.graph_id = s.graph_id)"""
WITH_CUTS = f"""{WITH_WAYS},
  path AS MATERIALIZED (SELECT w.graph_id, w.way, len(w.way) - 1 AS path_length FROM waysm w JOIN ends e
    ON e.graph_id = w.graph_id AND e.goal = w.node),
  steps AS MATERIALIZED (SELECT graph_id, path_length, way, unnest(range(path_length)) AS k FROM path),
  cuts AS MATERIALIZED (SELECT s.graph_id, s.k, s.path_length, s.way[s.k + 1] AS near, s.way[s.k + 2] AS far,
      count(*) FILTER (list_contains(w.way, s.way[s.k + 2])) AS goal_side,
      count(*) FILTER (NOT list_contains(w.way, s.way[s.k + 2])) AS start_side
    FROM steps s JOIN waysm w ON w.graph_id = s.graph_id GROUP BY ALL)"""
WITH_CHOSEN = f"""{WITH_CUTS},
  chosen AS MATERIALIZED (SELECT graph_id, k, path_length, near, far, start_side, goal_side FROM (
      SELECT c.*, p.seed, p.cut_mode, p.cut_pos,
        row_number() OVER (PARTITION BY c.graph_id ORDER BY least(start_side, goal_side) DESC, k) AS rank
      FROM cuts c JOIN ({PARAMS}) p ON p.graph_id = c.graph_id)
    WHERE CASE cut_mode WHEN 'random' THEN k = {sql.draw_int('seed', '2097152', 'path_length')}
      WHEN 'fixed' THEN k = greatest(0, least(path_length - 1, floor(cut_pos * path_length)))
      ELSE rank - 1 = {sql.draw_int('seed', '2097152', 'least(3, path_length)')} END)"""
WITH_PASSAGES = f"""{WITH_CHOSEN},
  parts AS MATERIALIZED (SELECT w.graph_id, w.node, list_contains(w.way, c.far) AS goal_part
    FROM waysm w JOIN chosen c ON c.graph_id = w.graph_id),
  candidates AS MATERIALIZED (SELECT g.graph_id, g.a, g.b, g.edge_no, g.seed FROM grid g
    ANTI JOIN tree t ON t.graph_id = g.graph_id AND t.a = g.a AND t.b = g.b
    JOIN parts x ON x.graph_id = g.graph_id AND x.node = g.a JOIN parts y ON y.graph_id = g.graph_id AND y.node = g.b
    WHERE x.goal_part = y.goal_part),
  passages AS MATERIALIZED (SELECT t.graph_id, t.a, t.b, CASE WHEN c.graph_id IS NULL THEN 'tree' ELSE 'cut' END AS kind
    FROM tree t LEFT JOIN chosen c ON c.graph_id = t.graph_id AND least(c.near, c.far) = t.a AND greatest(c.near, c.far) = t.b
    UNION ALL SELECT graph_id, a, b, CASE WHEN rank <= n THEN 'loop' ELSE 'opened' END FROM (
      SELECT c.*, row_number() OVER (PARTITION BY c.graph_id ORDER BY {sql.draw('c.seed', '3145728 + edge_no')}, edge_no) AS rank,
        least(p.loops, count(*) OVER (PARTITION BY c.graph_id) - 1) AS n
      FROM candidates c JOIN ({PARAMS}) p ON p.graph_id = c.graph_id) WHERE rank <= n + 1)"""


def pairs_of(spark, sf_dir):
    """Pair tables of all parts, built once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _pairs:
        _pairs[key] = minimal_pairs.build_pairs(inputs.grid_params(spark, sf_dir))
    return _pairs[key]


_pairs: dict = {}


@query("placed_ends", f"WITH RECURSIVE {WITH_WAYS} SELECT graph_id, start, goal FROM ends")
def placed_ends(spark, sf_dir):
    return pairs_of(spark, sf_dir)["ends"].select("graph_id", "start", "goal")


@query(
    "tree_paths",
    f"""WITH RECURSIVE {WITH_CUTS} SELECT graph_id, (k - 1)::BIGINT AS k, way[k] AS node
    FROM (SELECT graph_id, way, unnest(range(1, path_length + 2)) AS k FROM path)""",
)
def tree_paths(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    return trees.tree_paths(pairs["nodes"], pairs["ends"]).select("graph_id", "k", "node")


@query("cut_sizes", f"WITH RECURSIVE {WITH_CUTS} SELECT graph_id, k, near, far, start_side, goal_side FROM cuts")
def cut_sizes(spark, sf_dir):
    cuts = trees.cut_sizes(pairs_of(spark, sf_dir)["path"])
    return cuts.select("graph_id", "k", "near", "far", "start_side", "goal_side")


@query(
    "chosen_cuts",
    f"WITH RECURSIVE {WITH_CHOSEN} SELECT graph_id, k, near, far, path_length::BIGINT AS path_length FROM chosen",
)
def chosen_cuts(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    chosen = minimal_pairs.choose_cuts(pairs["cuts"], pairs["params"])
    return chosen.select("graph_id", "k", "near", "far", "path_length")


@query("candidate_passages", f"WITH RECURSIVE {WITH_PASSAGES} SELECT graph_id, a, b FROM candidates")
def candidate_passages(spark, sf_dir):
    return pairs_of(spark, sf_dir)["candidates"].select("graph_id", "a", "b")


@query(
    "extra_passages", f"WITH RECURSIVE {WITH_PASSAGES} SELECT graph_id, a, b, kind FROM passages WHERE kind IN ('loop', 'opened')"
)
def extra_passages(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    return minimal_pairs.extra_passages(pairs["candidates"], pairs["params"])


MEMBERS = """SELECT graph_id, true AS solvable, a, b FROM passages WHERE kind <> 'opened'
  UNION ALL SELECT graph_id, false, a, b FROM passages WHERE kind <> 'cut'"""


@query("pair_members", f"WITH RECURSIVE {WITH_PASSAGES} {MEMBERS}")
def pair_members(spark, sf_dir):
    return minimal_pairs.members(pairs_of(spark, sf_dir)["passages"])


@query(
    "members_by_label",
    f"""WITH RECURSIVE {WITH_PASSAGES} SELECT m.graph_id, m.solvable, m.a, m.b FROM ({MEMBERS}) m JOIN ({PARAMS}) p
    ON p.graph_id = m.graph_id WHERE m.solvable = (CASE p.graph_id % 4 WHEN 0 THEN {sql.draw('p.seed', '4194304')} < 0.5
      WHEN 1 THEN true WHEN 2 THEN false ELSE true END)""",
)
def members_by_label(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    words = F.array(*[F.lit(v) for v in (None, "Yes", "no", "1")])
    labels = pairs["params"].select(
        "graph_id", "seed", F.element_at(words, (F.col("graph_id") % 4 + 1).cast("int")).alias("label")
    )
    return minimal_pairs.labelled_members(pairs["passages"], labels)


PAIR_FACTS = f"""{WITH_PASSAGES},
  marcs AS MATERIALIZED (SELECT graph_id, a AS u, b AS v FROM passages WHERE kind <> 'opened'
    UNION ALL SELECT graph_id, b, a FROM passages WHERE kind <> 'opened'),
  walk(graph_id, node, dist) USING KEY (graph_id, node) AS (SELECT graph_id, start, 0 FROM ends
    UNION SELECT w.graph_id, a.v, min(w.dist) + 1 FROM walk w JOIN marcs a ON a.graph_id = w.graph_id AND a.u = w.node
      LEFT JOIN recurring.walk k ON k.graph_id = a.graph_id AND k.node = a.v WHERE k.node IS NULL GROUP BY w.graph_id, a.v)"""


@query(
    "pair_metadata",
    f"""WITH RECURSIVE {PAIR_FACTS} SELECT p.graph_id, p.seed, p.width, p.height, e.start, e.goal, p.loops AS loops_requested,
      n.loops, c.path_length::BIGINT AS tree_path_length, c.k AS cut_index, c.near AS cut_near, c.far AS cut_far,
      o.a AS opened_a, o.b AS opened_b, c.start_side, c.goal_side,
      least(c.start_side, c.goal_side)::DOUBLE / (p.width * p.height) AS pocket_frac, n.passages,
      n.passages - 1 + (CASE WHEN o.a IS NULL THEN 0 ELSE 1 END) AS negative_passages, o.a IS NOT NULL AS walls_balanced,
      w.dist::INTEGER AS solution_length
    FROM ({PARAMS}) p JOIN ends e ON e.graph_id = p.graph_id JOIN chosen c ON c.graph_id = p.graph_id
    JOIN (SELECT graph_id, count(*) FILTER (kind = 'loop') AS loops, count(*) FILTER (kind <> 'opened') AS passages
      FROM passages GROUP BY graph_id) n ON n.graph_id = p.graph_id
    LEFT JOIN passages o ON o.graph_id = p.graph_id AND o.kind = 'opened'
    JOIN walk w ON w.graph_id = p.graph_id AND w.node = e.goal""",
)
def pair_metadata(spark, sf_dir):
    return minimal_pairs.pair_metadata(pairs_of(spark, sf_dir))


DIFFERENCES = f"""SELECT graph_id, count(*) FILTER (n.a IS NULL) AS only_solvable, count(*) FILTER (y.a IS NULL) AS only_unsolvable
  FROM (SELECT * FROM ({MEMBERS}) WHERE solvable) y FULL JOIN (SELECT * FROM ({MEMBERS}) WHERE NOT solvable) n
  USING (graph_id, a, b) GROUP BY graph_id"""


@query("pair_differences", f"WITH RECURSIVE {WITH_PASSAGES} {DIFFERENCES}")
def pair_differences(spark, sf_dir):
    return minimal_pairs.pair_differences(pair_members(spark, sf_dir)).select(
        "graph_id", "only_solvable", "only_unsolvable"
    )


# the audits read damaged pairs: of some the opened passage is lost, of others the cut edge stays in both members
WITH_DAMAGE = f"""{WITH_PASSAGES},
  damaged AS MATERIALIZED (SELECT graph_id, a, b, CASE WHEN graph_id % 16 = 9 AND kind = 'cut' THEN 'tree' ELSE kind END AS kind
    FROM passages WHERE NOT (graph_id % 16 = 5 AND kind = 'opened'))"""
DAMAGED_MEMBERS = MEMBERS.replace("FROM passages", "FROM damaged")
DAMAGED_DIFFERENCES = DIFFERENCES.replace("FROM passages", "FROM damaged")


def damaged(passages):
    number = F.col("graph_id") % 16
    lost = (number == 5) & (F.col("kind") == "opened")
    kind = F.when((number == 9) & (F.col("kind") == "cut"), "tree").otherwise(F.col("kind"))
    return passages.where(~lost).withColumn("kind", kind)


@query(
    "minimality_violations",
    f"""WITH RECURSIVE {WITH_DAMAGE} SELECT d.graph_id, d.only_solvable, d.only_unsolvable FROM ({DAMAGED_DIFFERENCES}) d
    JOIN chosen c ON c.graph_id = d.graph_id LEFT JOIN passages o ON o.graph_id = d.graph_id AND o.kind = 'opened'
    WHERE d.only_solvable <> 1 OR d.only_unsolvable <> (CASE WHEN o.a IS NULL THEN 0 ELSE 1 END)""",
)
def minimality_violations(spark, sf_dir):
    """The damaged ones among all pairs; every other differs in exactly the recorded edges."""
    pairs = pairs_of(spark, sf_dir)
    members = minimal_pairs.members(damaged(pairs["passages"]))
    return minimal_pairs.minimality_violations(members, pairs["chosen"], pairs["passages"])


@query(
    "label_audit",
    f"""WITH RECURSIVE {WITH_DAMAGE},
    darcs AS MATERIALIZED (SELECT graph_id, solvable, a AS u, b AS v FROM ({DAMAGED_MEMBERS})
      UNION ALL SELECT graph_id, solvable, b, a FROM ({DAMAGED_MEMBERS})),
    met(graph_id, solvable, node) AS (SELECT graph_id, s.solvable, start FROM ends, (SELECT unnest([true, false]) AS solvable) s
      UNION SELECT m.graph_id, m.solvable, d.v FROM met m JOIN darcs d ON d.graph_id = m.graph_id AND d.solvable = m.solvable AND d.u = m.node),
    reached AS MATERIALIZED (SELECT m.graph_id, m.solvable, count(*) AS n, bool_or(m.node = e.goal) AS joined
      FROM met m JOIN ends e ON e.graph_id = m.graph_id GROUP BY m.graph_id, m.solvable),
    facts AS MATERIALIZED (SELECT c.graph_id, c.start_side, c.goal_side, p.width * p.height AS cells, p.loops AS asked,
        (SELECT count(*) FROM candidates x WHERE x.graph_id = c.graph_id) AS pool,
        (SELECT count(*) FROM damaged x WHERE x.graph_id = c.graph_id AND x.kind = 'loop') AS loops,
        (SELECT count(*) FROM damaged x WHERE x.graph_id = c.graph_id AND x.kind = 'opened') AS opened
      FROM chosen c JOIN ({PARAMS}) p ON p.graph_id = c.graph_id)
    SELECT f.graph_id, r.solvable, CASE WHEN r.n = f.cells THEN 1 ELSE 2 END::BIGINT AS parts,
      CASE WHEN r.n = f.cells THEN f.cells ELSE least(r.n, f.cells - r.n) END::BIGINT AS smallest,
      CASE WHEN r.n = f.cells THEN f.cells ELSE greatest(r.n, f.cells - r.n) END::BIGINT AS largest,
      r.joined = r.solvable AND f.loops = greatest(0, least(f.asked, f.pool - 1)) AND f.opened = (CASE WHEN f.pool >= 1 THEN 1 ELSE 0 END)
        AND CASE WHEN r.solvable THEN r.n = f.cells
          ELSE r.n < f.cells AND least(r.n, f.cells - r.n) = least(f.start_side, f.goal_side) END AS agrees
    FROM facts f JOIN reached r ON r.graph_id = f.graph_id""",
)
def label_audit(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    return minimal_pairs.label_audit({**pairs, "passages": damaged(pairs["passages"])})
