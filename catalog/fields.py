"""Open-field rooms and their mechanics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs, sqltext as sql
from catalog.registry import query
from gridtwin.operators import fields

SIZE = 16
_fields: dict = {}


def field_of(spark, sf_dir):
    """Fields of all customers, built once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fields:
        rooms = inputs.table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("room_id"), F.col("c_custkey").alias("seed")
        )
        _fields[key] = fields.obstacle_fields(rooms, SIZE)
    return _fields[key]


def d(block: int, k: str = "0", attempt: int = 0) -> str:
    return sql.draw("seed", f"{((16 + block) << 20) + (attempt << 23)} + {k}")


def di(block: int, k: str, n: str, attempt: int = 0) -> str:
    return sql.draw_int("seed", f"{((16 + block) << 20) + (attempt << 23)} + {k}", n)


#: Attempts that SQL spells out; about one room in six needs another one each time.
ATTEMPTS = 9


def attempt(n: int) -> str:
    """The rooms without a field after n attempts, attempt n of their fields, and the ends of those that will do."""
    left = f"SELECT room_id, seed FROM rooms{n - 1} WHERE room_id NOT IN (SELECT room_id FROM ends{n - 1})" if n else "SELECT c_custkey AS room_id, c_custkey AS seed FROM customer"
    return f"""rooms{n} AS MATERIALIZED ({left}),
  bars{n} AS MATERIALIZED (SELECT DISTINCT room_id, x, y FROM (SELECT room_id, bx + CASE WHEN flat THEN i ELSE 0 END AS x,
      by_ + CASE WHEN flat THEN 0 ELSE i END AS y FROM (SELECT *, unnest(range(len)) AS i FROM (SELECT room_id,
        {di(2, 'bar * 4', '14', n)} + 1 AS bx, {di(2, 'bar * 4 + 1', '14', n)} + 1 AS by_, {d(2, 'bar * 4 + 2', n)} < 0.5 AS flat,
        {di(2, 'bar * 4 + 3', '3', n)} + 2 AS len FROM (SELECT *, unnest(range(6)) AS bar FROM rooms{n})))) WHERE x < 15 AND y < 15),
  cells{n} AS MATERIALIZED (SELECT c.room_id, c.seed, c.node, c.x, c.y, NOT (c.x = 0 OR c.y = 0 OR c.x = 15 OR c.y = 15) AND c.u >= c.density
      AND b.room_id IS NULL AS open FROM (SELECT *, node % 16 AS x, node // 16 AS y, {d(0, '0', n)} * 0.12 + 0.18 AS density, {d(1, 'node', n)} AS u
        FROM (SELECT *, unnest(range(256))::INTEGER AS node FROM rooms{n})) c
      LEFT JOIN bars{n} b ON b.room_id = c.room_id AND b.x = c.x AND b.y = c.y),
  starts{n} AS MATERIALIZED (SELECT room_id, arg_min(node, u) AS start FROM (SELECT *, {d(3, 'node', n)} AS u FROM cells{n} WHERE open) GROUP BY room_id),
  arcs{n} AS MATERIALIZED (SELECT a.room_id, a.node AS u, b.node AS v FROM cells{n} a JOIN cells{n} b ON a.room_id = b.room_id
      AND abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE a.open AND b.open),
  walk{n}(room_id, node, dist) USING KEY (room_id, node) AS (SELECT room_id, start, 0 FROM starts{n}
    UNION SELECT w.room_id, a.v, min(w.dist) + 1 FROM walk{n} w JOIN arcs{n} a ON a.room_id = w.room_id AND a.u = w.node
      LEFT JOIN recurring.walk{n} k ON k.room_id = a.room_id AND k.node = a.v WHERE k.node IS NULL GROUP BY w.room_id, a.v),
  ends{n} AS MATERIALIZED (SELECT w.room_id, s.start, w.node AS goal, w.dist FROM walk{n} w JOIN starts{n} s ON s.room_id = w.room_id
    QUALIFY count(*) OVER (PARTITION BY w.room_id) >= 20 AND row_number() OVER (PARTITION BY w.room_id ORDER BY w.dist DESC, w.node) = 1)"""


def of_all_attempts(name: str, prefix: str = "") -> str:
    rows = (f"SELECT * FROM {name}{n} WHERE room_id IN (SELECT room_id FROM ends{n})" for n in range(ATTEMPTS))
    return f"{prefix}{name} AS MATERIALIZED ({' UNION ALL '.join(rows)})"


WITH_FIELD = ",\n  ".join([*map(attempt, range(ATTEMPTS)), *map(of_all_attempts, ("cells", "arcs", "walk", "ends"))])
IN_VAIN = " UNION ALL ".join(
    f"SELECT room_id, {n} AS attempt, 'too few reachable cells' AS reason FROM rooms{n} WHERE room_id NOT IN (SELECT room_id FROM ends{n})"
    for n in range(ATTEMPTS)
)
WITH_FREE = f"""{WITH_FIELD},
  free AS MATERIALIZED (SELECT c.room_id, c.seed, c.node, c.x, c.y, e.start % 16 AS sx, e.start // 16 AS sy, e.goal % 16 AS gx, e.goal // 16 AS gy
    FROM cells c JOIN ends e ON e.room_id = c.room_id WHERE c.open AND c.node <> e.start AND c.node <> e.goal),
  around AS MATERIALIZED (SELECT f.*, (SELECT count(*) FROM free g WHERE g.room_id = f.room_id AND abs(g.x - f.x) + abs(g.y - f.y) = 1) AS around FROM free f)"""
WITH_SOLUTION = f"""{WITH_FREE},
  back AS MATERIALIZED (SELECT a.room_id, a.u AS node, min(a.v) AS back FROM arcs a JOIN walk p ON p.room_id = a.room_id AND p.node = a.u
    JOIN walk q ON q.room_id = a.room_id AND q.node = a.v WHERE q.dist = p.dist - 1 GROUP BY a.room_id, a.u),
  solution(room_id, k, node) AS (SELECT room_id, dist, goal FROM ends
    UNION ALL SELECT s.room_id, s.k - 1, b.back FROM solution s JOIN back b ON b.room_id = s.room_id AND b.node = s.node),
  onpath AS MATERIALIZED (SELECT room_id, node FROM solution)"""
FAR_S = lambda n: f"abs(x - sx) + abs(y - sy) > {n}"
FAR_G = lambda n: f"abs(x - gx) + abs(y - gy) > {n}"
ON_PATH = "EXISTS (SELECT 1 FROM onpath p WHERE p.room_id = f.room_id AND p.node = f.node)"


@query(
    "obstacle_fields",
    f"""WITH RECURSIVE {WITH_FIELD}, texts AS (SELECT room_id, string_agg(line, chr(10) ORDER BY y) || chr(10) AS text FROM (
      SELECT c.room_id, c.y, string_agg(CASE WHEN c.node = e.start THEN '.+p' WHEN c.node = e.goal THEN '.+G' WHEN c.open THEN '.' ELSE '.+#' END, ' ' ORDER BY c.x) AS line
      FROM cells c JOIN ends e ON e.room_id = c.room_id GROUP BY c.room_id, c.y) GROUP BY room_id)
    SELECT e.room_id, e.start, e.goal, t.text FROM ends e JOIN texts t ON t.room_id = e.room_id""",
)
def obstacle_fields(spark, sf_dir):
    field = field_of(spark, sf_dir)
    return field["ends"].join(fields.field_texts(field, SIZE), "room_id")


@query(
    "rejected_fields",
    f"WITH RECURSIVE {WITH_FIELD} {IN_VAIN}",
)
def rejected_fields(spark, sf_dir):
    return field_of(spark, sf_dir)["rejected"]


@query("field_solutions", f"WITH RECURSIVE {WITH_SOLUTION} SELECT room_id, k::INTEGER AS k, node FROM solution")
def field_solutions(spark, sf_dir):
    return field_of(spark, sf_dir)["solution"].select("room_id", "k", "node")


@query("open_neighbours", f"WITH RECURSIVE {WITH_FREE} SELECT room_id, node, around FROM around")
def open_neighbours(spark, sf_dir):
    free = fields.free_cells(field_of(spark, sf_dir), SIZE)
    return fields.with_open_neighbours(free).select("room_id", "node", "around")


@query("cells_away_from_ends", f"WITH RECURSIVE {WITH_FREE} SELECT room_id, node FROM free WHERE {FAR_S(2)} AND {FAR_G(1)}")
def cells_away_from_ends(spark, sf_dir):
    free = fields.free_cells(field_of(spark, sf_dir), SIZE)
    return free.where(fields.farther_than(2, "start") & fields.farther_than(1, "goal")).select("room_id", "node")


@query("frozen_cells", f"WITH RECURSIVE {WITH_FREE} SELECT room_id, node, x, y FROM free WHERE {d(4, '1 + node')} < 0.35 + {d(4)} * 0.4")
def frozen_cells(spark, sf_dir):
    return fields.frozen_cells(field_of(spark, sf_dir), SIZE)


@query(
    "placed_boxes",
    f"""WITH RECURSIVE {WITH_SOLUTION} SELECT room_id, (r - 1)::INTEGER AS i, node, x, y, on_path FROM (SELECT *, row_number() OVER (PARTITION BY room_id
      ORDER BY on_path DESC, {d(5, '1 + node')}, node) AS r FROM (SELECT f.*, {ON_PATH} AS on_path FROM around f
      WHERE around >= 2 AND {FAR_S(2)} AND {FAR_G(1)})) WHERE r <= {di(5, '0', '3')} + 1""",
)
def placed_boxes(spark, sf_dir):
    return fields.placed_boxes(field_of(spark, sf_dir), SIZE)


WITH_HOLES = f"""{WITH_SOLUTION}, holes AS MATERIALIZED (SELECT room_id, seed, r - 1 AS i, node, x, y FROM (SELECT *, row_number() OVER (PARTITION BY room_id
    ORDER BY {d(5, '1 + node')}, node) AS r FROM (SELECT f.* FROM free f WHERE {ON_PATH} AND {FAR_S(2)} AND {FAR_G(1)})) WHERE r <= {di(5, '0', '2')} + 1)"""


@query("placed_holes", f"WITH RECURSIVE {WITH_HOLES} SELECT room_id, i::INTEGER AS i, node, x, y, true AS on_path FROM holes")
def placed_holes(spark, sf_dir):
    return fields.placed_holes(field_of(spark, sf_dir), SIZE)


@query(
    "hole_fillers",
    f"""WITH RECURSIVE {WITH_HOLES}, rest AS MATERIALIZED (SELECT f.* FROM free f WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE h.room_id = f.room_id AND h.node = f.node)),
    spots AS MATERIALIZED (SELECT *, {d(6, 'node')} AS u FROM rest f WHERE {FAR_S(1)} AND (SELECT count(*) FROM rest g WHERE g.room_id = f.room_id
      AND abs(g.x - f.x) + abs(g.y - f.y) = 1) >= 2),
    numbered AS MATERIALIZED (SELECT room_id, node, row_number() OVER (PARTITION BY room_id ORDER BY u, node) - 1 AS i FROM spots)
    SELECT room_id, hole, coalesce(near, any_) AS filler FROM (SELECT h.room_id, h.node AS hole,
      (SELECT arg_min(s.node, s.u) FROM spots s WHERE s.room_id = h.room_id AND abs(s.x - h.x) + abs(s.y - h.y) BETWEEN 2 AND 5) AS near,
      (SELECT n.node FROM numbered n WHERE n.room_id = h.room_id AND n.i = h.i) AS any_ FROM holes h) WHERE filler IS NOT NULL""",
)
def hole_fillers(spark, sf_dir):
    field = field_of(spark, sf_dir)
    return fields.hole_fillers(field, fields.placed_holes(field, SIZE), SIZE)


@query(
    "button_lines",
    f"""WITH RECURSIVE {WITH_SOLUTION}, walls AS MATERIALIZED (SELECT room_id, arg_min(node, u) AS wall FROM (SELECT *, {d(5, 'node')} AS u FROM free f
      WHERE {ON_PATH} AND {FAR_S(1)} AND {FAR_G(1)}) GROUP BY room_id),
    rest AS MATERIALIZED (SELECT f.*, w.wall FROM free f JOIN walls w ON w.room_id = f.room_id WHERE f.node <> w.wall),
    tries AS (SELECT f.room_id, f.node, {d(6, 'node')} AS u, {d(7, 'node * 4 + way')} AS v, f.x + dx AS px, f.y + dy AS py, f.x - dx AS qx, f.y - dy AS qy
      FROM rest f, (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) AS dirs(way, dx, dy)
      WHERE {FAR_S(1)} AND {FAR_G(1)} AND abs(x - wall % 16) + abs(y - wall // 16) > 1),
    lines AS (SELECT t.*, b.node AS button FROM tries t JOIN rest b ON b.room_id = t.room_id AND b.x = t.px AND b.y = t.py
      JOIN rest q ON q.room_id = t.room_id AND q.x = t.qx AND q.y = t.qy QUALIFY row_number() OVER (PARTITION BY t.room_id ORDER BY u, t.node, v) = 1)
    SELECT w.room_id, w.wall, l.node AS box, l.button FROM walls w LEFT JOIN lines l ON l.room_id = w.room_id""",
)
def button_lines(spark, sf_dir):
    return fields.button_lines(field_of(spark, sf_dir), SIZE)
