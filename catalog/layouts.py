"""Whole generated rooms: mazes and fields with mechanics, and the edits they allow."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fields, graphs, inputs, rooms, sqltext as sql
from catalog.registry import SQL, query
from gridtwin.operators import edits, layouts

SIDE, SIZE = 7, 16
KINDS = ", ".join(f"'{kind}'" for kind in layouts.TYPES)


def block(cell: str) -> str:
    return f"((2 * ({cell} // {SIDE}) + 1) * {SIZE} + 2 * ({cell} % {SIDE}) + 1)"


def tail(name: str, head: str) -> str:
    """The statement of a registered query without the tables it begins with."""
    statement = SQL[name].removeprefix(f"WITH RECURSIVE {head}")
    return f"WITH {statement[1:].strip()}" if statement.startswith(",") else statement


PLAN = f"""SELECT *, CASE WHEN {sql.draw('seed', str(layouts.LAYOUT))} < (CASE WHEN type IN ('boxes', 'holes', 'orange') THEN 0.75 ELSE 0.4 END)
    THEN 'field' ELSE 'maze' END AS layout FROM (SELECT c_custkey AS room_id, c_custkey AS seed, ([{KINDS}])[c_custkey % 5 + 1] AS type FROM customer)"""
MAZE_PARAMS = f"""SELECT room_id AS graph_id, {SIDE} AS width, {SIDE} AS height, seed, 'far' AS placement, 'balanced' AS cut_mode,
    NULL::DOUBLE AS cut_pos, {sql.draw_int('seed', str(layouts.LOOPS), '3')} + 2 AS loops, 4 AS min_distance FROM plan WHERE layout = 'maze'"""
MAZES = f"""WITH RECURSIVE {graphs.WITH_PASSAGES.replace(inputs.GRID_PARAMS, MAZE_PARAMS)},
  solvable AS MATERIALIZED (SELECT graph_id, a, b FROM passages WHERE kind <> 'opened'),
  both_ways AS MATERIALIZED (SELECT graph_id, a AS u, b AS v FROM solvable UNION ALL SELECT graph_id, b, a FROM solvable),
  reached(graph_id, node, dist) USING KEY (graph_id, node) AS (SELECT graph_id, start, 0 FROM ends
    UNION SELECT w.graph_id, a.v, min(w.dist) + 1 FROM reached w JOIN both_ways a ON a.graph_id = w.graph_id AND a.u = w.node
      LEFT JOIN recurring.reached k ON k.graph_id = a.graph_id AND k.node = a.v WHERE k.node IS NULL GROUP BY w.graph_id, a.v),
  before AS MATERIALIZED (SELECT a.graph_id, a.u AS node, min(a.v) AS back FROM both_ways a JOIN reached p ON p.graph_id = a.graph_id AND p.node = a.u
    JOIN reached q ON q.graph_id = a.graph_id AND q.node = a.v WHERE q.dist = p.dist - 1 GROUP BY a.graph_id, a.u),
  shortest(graph_id, k, node) AS (SELECT e.graph_id, r.dist, e.goal FROM ends e JOIN reached r ON r.graph_id = e.graph_id AND r.node = e.goal
    UNION ALL SELECT s.graph_id, s.k - 1, b.back FROM shortest s JOIN before b ON b.graph_id = s.graph_id AND b.node = s.node)
  SELECT 'passage' AS what, graph_id AS room_id, a, b FROM solvable UNION ALL SELECT 'ends', graph_id, start, goal FROM ends
    UNION ALL SELECT 'step', graph_id, k, node FROM shortest"""
FIELDS = ",\n  ".join(
    [
        fields.attempt(0).replace("SELECT c_custkey AS room_id, c_custkey AS seed FROM customer", "SELECT room_id, seed FROM plan WHERE layout = 'field'"),
        *[fields.attempt(n) for n in range(1, fields.ATTEMPTS)],
        *[fields.of_all_attempts(name, "f") for name in ("cells", "arcs", "walk", "ends")],
    ]
)
WITH_ROOMS = f"""plan AS MATERIALIZED ({PLAN}), mazes AS MATERIALIZED ({MAZES}),
  {FIELDS},
  fback AS MATERIALIZED (SELECT a.room_id, a.u AS node, min(a.v) AS back FROM farcs a JOIN fwalk p ON p.room_id = a.room_id AND p.node = a.u
    JOIN fwalk q ON q.room_id = a.room_id AND q.node = a.v WHERE q.dist = p.dist - 1 GROUP BY a.room_id, a.u),
  fsteps(room_id, k, node) AS (SELECT room_id, dist, goal FROM fends
    UNION ALL SELECT s.room_id, s.k - 1, b.back FROM fsteps s JOIN fback b ON b.room_id = s.room_id AND b.node = s.node),
  ends AS MATERIALIZED (SELECT room_id, start, goal FROM fends
    UNION ALL SELECT room_id, {block('a')}, {block('b')} FROM mazes WHERE what = 'ends'),
  through AS MATERIALIZED (SELECT room_id, {block('a')} + CASE WHEN b = a + 1 THEN 1 ELSE {SIZE} END AS node FROM mazes WHERE what = 'passage'),
  cells AS MATERIALIZED (SELECT room_id, seed, node, x, y, open FROM fcells
    UNION ALL SELECT c.room_id, c.seed, c.node, c.x, c.y, (x % 2 = 1 AND y % 2 = 1 AND x < 14 AND y < 14) OR t.node IS NOT NULL
    FROM (SELECT room_id, seed, node, node % {SIZE} AS x, node // {SIZE} AS y FROM (SELECT *, unnest(range(256))::INTEGER AS node FROM plan WHERE layout = 'maze')) c
    LEFT JOIN through t ON t.room_id = c.room_id AND t.node = c.node),
  solution AS MATERIALIZED (SELECT room_id, k, node FROM fsteps UNION ALL SELECT room_id, a, {block('b')} FROM mazes WHERE what = 'step'),
  onpath AS MATERIALIZED (SELECT room_id, node FROM solution){fields.WITH_FREE.removeprefix(fields.WITH_FIELD)}"""


def of_kind(kind: str, placed: str, node: str, cell: str) -> str:
    return f"""SELECT room_id, {node} AS node, {cell} AS cell FROM ({placed})
      WHERE {node} IS NOT NULL AND room_id IN (SELECT room_id FROM plan WHERE type = '{kind}')"""


LINES = tail("button_lines", fields.WITH_SOLUTION)
WITH_LEVELS = f"""{WITH_ROOMS}{fields.WITH_HOLES.removeprefix(fields.WITH_SOLUTION)},
  changes AS MATERIALIZED ({" UNION ".join([
      of_kind('ice', tail('frozen_cells', fields.WITH_FREE), 'node', "'i'"),
      of_kind('boxes', tail('placed_boxes', fields.WITH_SOLUTION), 'node', "'.+M' || i"),
      of_kind('holes', 'SELECT * FROM holes', 'node', "'+'"),
      of_kind('holes', tail('hole_fillers', fields.WITH_HOLES), 'filler', "'.+f'"),
      of_kind('orange', LINES, 'wall', "'.+O'"),
      of_kind('orange', LINES, 'box', "'.+M0'"),
      of_kind('orange', LINES, 'button', "'.+o'"),
  ])}),
  drawn AS MATERIALIZED (SELECT c.room_id, c.x, c.y, CASE WHEN g.cell IS NOT NULL THEN g.cell WHEN c.node = e.start THEN '.+p' WHEN c.node = e.goal THEN '.+G'
      WHEN c.open THEN '.' ELSE '.+#' END AS cell FROM cells c JOIN ends e ON e.room_id = c.room_id
      LEFT JOIN changes g ON g.room_id = c.room_id AND g.node = c.node)"""


def generated(spark, sf_dir):
    """One try for each customer."""
    key = F.col("c_custkey")
    tries = inputs.table(spark, sf_dir, "customer").select(key.alias("room_id"), key.alias("seed"), key.alias("attempt"))
    return layouts.generated_rooms(tries, SIZE)


@query(
    "generated_rooms",
    f"""WITH RECURSIVE {WITH_LEVELS} SELECT p.room_id, 'gen-' || type || '-' || layout || '-' || seed AS name, seed, type, layout, text FROM plan p
    JOIN (SELECT room_id, string_agg(line, chr(10) ORDER BY y) || chr(10) AS text FROM (SELECT room_id, y, string_agg(cell, ' ' ORDER BY x) AS line
      FROM drawn GROUP BY room_id, y) GROUP BY room_id) t ON t.room_id = p.room_id""",
)
def generated_rooms(spark, sf_dir):
    return generated(spark, sf_dir)


EDITS = rooms.WITH_EDITS.replace(
    rooms.CELLS, f"SELECT room_id, {SIZE} AS width, {SIZE} AS height, x::INTEGER AS x, y::INTEGER AS y, cell, CASE WHEN cell = '+' THEN [''] ELSE string_split(cell, '+') END AS t FROM drawn"
)


@query(
    "edits_of_generated_rooms",
    f"""WITH RECURSIVE {WITH_LEVELS} SELECT p.room_id, p.type, p.layout, e.edit, e.n FROM plan p
    JOIN (WITH {EDITS} SELECT room_id, type AS edit, count(*) AS n FROM edits GROUP BY ALL) e ON e.room_id = p.room_id""",
)
def edits_of_generated_rooms(spark, sf_dir):
    """How many edits of each type every generated room allows."""
    made = generated(spark, sf_dir)
    found = edits.enumerate_edits(made.select("room_id", "text"))
    counts = found.groupBy("room_id", F.col("type").alias("edit")).agg(F.count("*").alias("n"))
    return made.select("room_id", "type", "layout").join(counts, "room_id")
