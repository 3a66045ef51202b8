"""A whole corpus of maze pairs: labels, objects and configuration, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs, sqltext as sql
from catalog.graphs import MEMBERS, NODES, PAIR_FACTS, PARAMS, pairs_of
from catalog.registry import query
from gridtwin import VERSION, schemas
from gridtwin.plans import corpus
from gridtwin.session import scratch_path
from gridtwin.sources import readers, writers

MIN_PATH, SEED = 6, 83

# every pair whose tree path is long enough, in both members, with split and running id
PLACED = f"""{PAIR_FACTS},
  taken AS MATERIALIZED (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS idx, count(*) OVER () AS n
    FROM chosen WHERE path_length >= {MIN_PATH}),
  dealt AS MATERIALIZED (SELECT graph_id, idx, n, row_number() OVER (ORDER BY {sql.draw(str(SEED), 'idx')}, idx) AS r FROM taken),
  placed AS MATERIALIZED (SELECT graph_id, idx, s.solvable, printf('%06d', 2 * idx + CASE WHEN s.solvable THEN 0 ELSE 1 END) AS id,
      CASE WHEN r <= round_even(0.8 * n, 0) THEN 'train'
        WHEN r <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'val' ELSE 'test' END AS split
    FROM dealt, (SELECT unnest([true, false]) AS solvable) s),
  counted AS MATERIALIZED (SELECT graph_id, count(*) FILTER (kind = 'loop')::INTEGER AS loops,
      count(*) FILTER (kind <> 'opened')::INTEGER AS passages, max(CASE WHEN kind = 'opened' THEN [a, b] END) AS opened
    FROM passages GROUP BY graph_id)"""


def saved_corpus(spark, sf_dir):
    root = scratch_path(spark, "mazes")
    seeds = inputs.table(spark, sf_dir, "part").count()
    stats = corpus.write_corpus(pairs_of(spark, sf_dir), root, seeds, min_path=MIN_PATH, seed=SEED)
    return root, stats


@query(
    "maze_labels",
    f"""WITH RECURSIVE {PLACED} SELECT m.id, p.seed, m.solvable::INTEGER AS solvable, m.split, m.idx AS pair, p.width, p.height,
      c.path_length::INTEGER AS tree_path_length, CASE WHEN m.solvable THEN w.dist::INTEGER END AS solution_length,
      round_even(least(c.start_side, c.goal_side)::DOUBLE / (p.width * p.height), 4) AS pocket_frac,
      least(c.start_side, c.goal_side)::INTEGER AS component_min, n.loops, c.k::INTEGER AS cut_index,
      (e.start % p.width)::INTEGER AS start_x, (e.start // p.width)::INTEGER AS start_y,
      (e.goal % p.width)::INTEGER AS goal_x, (e.goal // p.width)::INTEGER AS goal_y
    FROM placed m JOIN ({PARAMS}) p ON p.graph_id = m.graph_id JOIN chosen c ON c.graph_id = m.graph_id
    JOIN ends e ON e.graph_id = m.graph_id JOIN counted n ON n.graph_id = m.graph_id
    JOIN walk w ON w.graph_id = m.graph_id AND w.node = e.goal""",
)
def maze_labels(spark, sf_dir):
    """The label table as CSV."""
    root, _ = saved_corpus(spark, sf_dir)
    return writers.read_csv(spark, f"{root}/labels", schemas.LABEL)


def _points(cells: str, width: str) -> str:
    return f"array_to_string(list_transform({cells}, lambda c: (c % {width}) || ',' || (c // {width})), ' ')"


@query(
    "maze_objects",
    f"""WITH RECURSIVE {PLACED},
    sides AS MATERIALIZED (SELECT graph_id, solvable, a, b FROM ({MEMBERS})),
    lines AS MATERIALIZED (SELECT n.graph_id, s.solvable, n.y,
        string_agg(CASE WHEN r.a IS NULL THEN '0' ELSE '1' END, '' ORDER BY n.x) AS rights,
        string_agg(CASE WHEN d.a IS NULL THEN '0' ELSE '1' END, '' ORDER BY n.x) AS downs
      FROM ({NODES}) n JOIN placed s ON s.graph_id = n.graph_id
      LEFT JOIN sides r ON r.graph_id = n.graph_id AND r.solvable = s.solvable AND r.a = n.node AND r.b = n.node + 1
      LEFT JOIN sides d ON d.graph_id = n.graph_id AND d.solvable = s.solvable AND d.a = n.node AND d.b = n.node + n.width
      GROUP BY n.graph_id, s.solvable, n.y),
    boards AS MATERIALIZED (SELECT graph_id, solvable, string_agg(rights, '/' ORDER BY y) AS right_rows,
      string_agg(downs, '/' ORDER BY y) AS down_rows FROM lines GROUP BY graph_id, solvable),
    back AS MATERIALIZED (SELECT a.graph_id, a.u AS node, min(a.v) AS back FROM marcs a
      JOIN walk x ON x.graph_id = a.graph_id AND x.node = a.u JOIN walk y ON y.graph_id = a.graph_id AND y.node = a.v
      WHERE y.dist = x.dist - 1 GROUP BY a.graph_id, a.u),
    solved(graph_id, node, cells) AS (SELECT graph_id, goal, [goal] FROM ends
      UNION ALL SELECT s.graph_id, b.back, list_prepend(b.back, s.cells) FROM solved s JOIN back b ON b.graph_id = s.graph_id AND b.node = s.node),
    solutions AS MATERIALIZED (SELECT s.graph_id, s.cells FROM solved s JOIN ends e ON e.graph_id = s.graph_id AND e.start = s.node),
    looped AS MATERIALIZED (SELECT x.graph_id, string_agg((a % width) || ',' || (a // width) || ' ' || (b % width) || ',' || (b // width),
      '|' ORDER BY a, b) AS loop_edges FROM passages x JOIN ({PARAMS}) p ON p.graph_id = x.graph_id WHERE kind = 'loop' GROUP BY x.graph_id)
    SELECT m.id, m.split, '{VERSION}' AS version, p.width, p.height, p.seed, m.solvable, p.placement,
      CASE WHEN p.cut_mode = 'fixed' THEN printf('%.2f', p.cut_pos) ELSE p.cut_mode END AS cut,
      p.loops AS loops_requested, p.min_distance, {_points('[e.start, e.goal]', 'p.width')} AS ends,
      b.right_rows, b.down_rows, {_points('t.way', 'p.width')} AS tree_path, c.k::INTEGER AS cut_index,
      {_points('[c.near, c.far]', 'p.width')} AS cut_edge, {_points('n.opened', 'p.width')} AS opened_edge,
      coalesce(l.loop_edges, '') AS loop_edges, c.start_side::INTEGER AS start_side, c.goal_side::INTEGER AS goal_side,
      n.passages - CASE WHEN NOT m.solvable AND n.opened IS NULL THEN 1 ELSE 0 END AS passages,
      n.opened IS NOT NULL AS walls_balanced, CASE WHEN m.solvable THEN {_points('s.cells', 'p.width')} END AS solution
    FROM placed m JOIN ({PARAMS}) p ON p.graph_id = m.graph_id JOIN chosen c ON c.graph_id = m.graph_id
    JOIN ends e ON e.graph_id = m.graph_id JOIN counted n ON n.graph_id = m.graph_id JOIN path t ON t.graph_id = m.graph_id
    JOIN solutions s ON s.graph_id = m.graph_id JOIN boards b ON b.graph_id = m.graph_id AND b.solvable = m.solvable
    LEFT JOIN looped l ON l.graph_id = m.graph_id""",
)
def maze_objects(spark, sf_dir):
    """Both members as whole objects, read from JSON lines; nested fields as text."""
    root, _ = saved_corpus(spark, sf_dir)
    text = lambda points: F.array_join(F.transform(points, lambda p: F.array_join(p.cast("array<string>"), ",")), " ")
    rows = lambda side: F.array_join(F.transform(side, lambda r: F.array_join(r.cast("array<string>"), "")), "/")
    meta = lambda name: F.col(f"meta.{name}")
    cut = F.col("params.cut")
    number = F.try_variant_get(cut, "$", "double")
    word = F.when(number.isNull(), F.try_variant_get(cut, "$", "string")).otherwise(F.format_string("%.2f", number))
    return readers.read_mazes(spark, root).select(
        "id",
        "split",
        "version",
        "width",
        "height",
        "seed",
        "solvable",
        "params.placement",
        word.alias("cut"),
        F.col("params.loops").alias("loops_requested"),
        F.col("params.minDistance").alias("min_distance"),
        text(F.array("start", "goal")).alias("ends"),
        rows("right").alias("right_rows"),
        rows("down").alias("down_rows"),
        text(meta("treePath")).alias("tree_path"),
        meta("cutIndex").alias("cut_index"),
        text(meta("cutEdge")).alias("cut_edge"),
        text(meta("openedEdge")).alias("opened_edge"),
        F.array_join(F.transform(meta("loopEdges"), text), "|").alias("loop_edges"),
        meta("componentSizes")[0].alias("start_side"),
        meta("componentSizes")[1].alias("goal_side"),
        meta("passages").alias("passages"),
        meta("wallsBalanced").alias("walls_balanced"),
        text(meta("solution")).alias("solution"),
    )


@query(
    "maze_config",
    f"""WITH RECURSIVE {PLACED} SELECT (SELECT count(*) FROM placed) AS n, true AS pairs, {SEED}::BIGINT AS base_seed, {MIN_PATH} AS min_path,
      (SELECT count(*) FROM chosen WHERE path_length < {MIN_PATH}) AS seeds_skipped_for_min_path, '0.8 0.1 0.1' AS splits,
      NULL::VARCHAR AS preset, '{VERSION}' AS version""",
)
def maze_config(spark, sf_dir):
    root, _ = saved_corpus(spark, sf_dir)
    config = readers.read_config(spark, root, schemas.CORPUS_CONFIG)
    return config.withColumn("splits", F.array_join(F.col("splits").cast("array<string>"), " ")).drop("maze_params")


@query(
    "maze_corpus_statistics",
    f"""WITH RECURSIVE {PLACED} SELECT coalesce(m.split, 'all') AS split, count(*) AS n, count(*) FILTER (m.solvable) AS solvable,
      sum(c.path_length)::BIGINT AS path_cells, min(c.path_length)::INTEGER AS min_path, max(c.path_length)::INTEGER AS max_path,
      min(round_even(least(c.start_side, c.goal_side)::DOUBLE / (p.width * p.height), 4)) AS min_pocket
    FROM placed m JOIN ({PARAMS}) p ON p.graph_id = m.graph_id JOIN chosen c ON c.graph_id = m.graph_id GROUP BY ROLLUP (m.split)""",
)
def maze_corpus_statistics(spark, sf_dir):
    _, stats = saved_corpus(spark, sf_dir)
    cells = F.round(F.col("mean_path") * F.col("n")).cast("bigint")
    return stats.select("split", "n", "solvable", cells.alias("path_cells"), "min_path", "max_path", "min_pocket")
