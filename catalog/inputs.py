"""How the given tables stand in for corpora, results and replies.

Each stand-in has a Spark form and the same mapping as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import sqltext as sql
from gridtwin.functions.rng import draw
from gridtwin.session import spread

EDIT_TYPES = ("add_wall", "remove_wall", "move_gem", "floor_to_ice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- trial results from events ------------------------------------------------
def trial_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per event."""
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    tags = F.filter(
        F.array(
            F.when(F.col("k") % 2 == 0, F.lit("ice")),
            F.when(F.col("k") % 3 == 0, F.lit("box")),
            F.when(F.col("k") % 5 == 0, F.lit("holes")),
        ),
        lambda tag: tag.isNotNull(),
    )
    edit = F.element_at(F.array(*[F.lit(t) for t in EDIT_TYPES]), (F.col("user_id") % 4 + 1).cast("int"))
    chance = F.when(F.col("event_type").isin("click", "purchase"), 0.7).otherwise(0.3)
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .select(
            "event_id",
            "ts",
            "user_id",
            (draw(F.col("event_id")) < chance).alias("solvable"),
            F.when(F.col("event_type").isin("click", "purchase"), "yes")
            .when(F.col("event_type") == "view", "no")
            .when(F.col("event_type") == "error", "error")
            .when(F.col("k") % 2 == 0, "unparsed")
            .otherwise("refused")
            .alias("answer"),
            F.col("value").alias("latency"),
            ((F.col("k") % 50) / 100).alias("pocket_frac"),
            F.hour("ts").alias("tree_path_length"),
            F.when(F.col("k") % 11 != 0, edit).alias("edit_type"),
            tags.alias("tags"),
            F.when(F.col("k") % 7 != 0, F.col("k") * 10).cast("bigint").alias("input_tokens"),
            F.when(F.col("k") % 5 != 0, F.col("k") * 3).cast("bigint").alias("output_tokens"),
        )
    )


K_SQL = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER)"

TRIAL_RESULTS = f"""
SELECT event_id, ts, user_id,
  {sql.draw('event_id')} < (CASE WHEN event_type IN ('click', 'purchase') THEN 0.7 ELSE 0.3 END) AS solvable,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'yes' WHEN event_type = 'view' THEN 'no'
       WHEN event_type = 'error' THEN 'error' WHEN k % 2 = 0 THEN 'unparsed' ELSE 'refused' END AS answer,
  value AS latency, (k % 50) / 100.0::DOUBLE AS pocket_frac, CAST(hour(ts) AS INTEGER) AS tree_path_length,
  CASE WHEN k % 11 <> 0 THEN (['add_wall', 'remove_wall', 'move_gem', 'floor_to_ice'])[user_id % 4 + 1] END AS edit_type,
  list_filter([CASE WHEN k % 2 = 0 THEN 'ice' END, CASE WHEN k % 3 = 0 THEN 'box' END,
    CASE WHEN k % 5 = 0 THEN 'holes' END], lambda t: t IS NOT NULL) AS tags,
  CASE WHEN k % 7 <> 0 THEN k * 10 END AS input_tokens,
  CASE WHEN k % 5 <> 0 THEN k * 3 END AS output_tokens
FROM (SELECT *, {K_SQL} AS k FROM events)"""


# --- paired items from part ------------------------------------------------------
def paired_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two neighbouring parts form a pair; brand is the set and name the room."""
    size = F.col("p_size")
    solvable = draw(F.col("p_partkey")) < 0.5
    tag_list = F.filter(
        F.array(
            F.lower("p_type"),
            F.when(size % 2 == 0, F.lit("ice")),
            F.when(size % 3 == 0, F.lit("box")),
        ),
        lambda tag: tag.isNotNull(),
    )
    name = F.col("p_partkey").cast("string")

    def image(suffix: str):
        return F.concat(F.lit("images/"), name, F.lit(suffix))

    yaws = F.map_from_entries(
        F.transform(
            F.slice(F.array(F.lit("0"), F.lit("90"), F.lit("180"), F.lit("270")), 1, (size % 4 + 1).cast("int")),
            lambda a: F.struct(a, F.concat(F.lit("images/"), name, F.lit("-y"), a, F.lit(".png"))),
        )
    )
    return (
        table(spark, sf_dir, "part")
        .withColumn("solvable", solvable)
        .select(
            F.col("p_partkey").alias("id"),
            F.floor(F.col("p_partkey") / 2).alias("pair"),
            F.col("p_brand").alias("set_id"),
            F.col("p_name").alias("room"),
            F.col("p_partkey").alias("position"),
            "solvable",
            F.when(size % 5 != 0, F.when(size % 11 == 0, ~F.col("solvable")).otherwise(F.col("solvable"))).alias(
                "verified"
            ),
            F.when(size % 7 != 0, tag_list).alias("tags"),
            F.struct(
                F.when(size % 3 != 0, image(".png")).alias("perspective"),
                F.when(size % 4 == 0, image("-top.png")).alias("top"),
                F.when(size % 6 != 0, yaws).alias("yaws"),
            ).alias("images"),
        )
    )


PAIRED_ITEMS = f"""
SELECT *, CASE WHEN p_size % 5 <> 0 THEN (CASE WHEN p_size % 11 = 0 THEN NOT solvable ELSE solvable END) END AS verified,
  CASE WHEN p_size % 7 <> 0 THEN list_filter([lower(p_type), CASE WHEN p_size % 2 = 0 THEN 'ice' END,
    CASE WHEN p_size % 3 = 0 THEN 'box' END], lambda t: t IS NOT NULL) END AS tags,
  CASE WHEN p_size % 3 <> 0 THEN 'images/' || id || '.png' END AS perspective,
  CASE WHEN p_size % 4 = 0 THEN 'images/' || id || '-top.png' END AS top_image,
  CASE WHEN p_size % 6 <> 0 THEN list_slice([0, 90, 180, 270], 1, p_size % 4 + 1) END AS yaws
FROM (SELECT p_partkey AS id, p_partkey // 2 AS pair, p_brand AS set_id, p_name AS room, p_partkey AS position,
  p_size, p_type, {sql.draw('p_partkey')} < 0.5 AS solvable FROM part)"""

VALID_PAIRS = f"""SELECT pair FROM ({PAIRED_ITEMS}) GROUP BY pair
  HAVING count(*) = 2 AND count(*) FILTER (solvable) = 1 AND count(*) FILTER (NOT solvable) = 1"""


# --- graphs from part --------------------------------------------------------------
def grid_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid per part: most of the sizes 6x6, 6x10 and 10x10, some 16x16 and 24x24."""
    size = F.col("p_size")
    placement = F.element_at(F.array(*[F.lit(p) for p in ("random", "border", "corners", "far")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    mode = F.element_at(F.array(*[F.lit(c) for c in ("balanced", "random", "fixed")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    side = F.when(size % 50 == 0, 24).when(size % 25 == 1, 16).when(size % 8 == 3, 10).otherwise(6)
    sized = table(spark, sf_dir, "part").withColumn("_side", side)
    return sized.select(
        F.col("p_partkey").alias("graph_id"),
        F.col("_side").alias("width"),
        F.when((F.col("_side") == 6) & (size % 7 == 2), 10).otherwise(F.col("_side")).alias("height"),
        F.col("p_partkey").alias("seed"),
        placement.alias("placement"),
        mode.alias("cut_mode"),
        F.when(F.col("p_partkey") % 3 == 2, (size % 5) / 4).alias("cut_pos"),
        F.when(F.col("_side") == 6, 1).when(F.col("_side") == 10, 3).when(F.col("_side") == 16, 6).otherwise(12).alias("loops"),
        F.floor(F.col("_side") / 2).cast("int").alias("min_distance"),
    )


GRID_PARAMS = """SELECT p_partkey AS graph_id, side AS width, CASE WHEN side = 6 AND p_size % 7 = 2 THEN 10 ELSE side END AS height,
  p_partkey AS seed, (['random', 'border', 'corners', 'far'])[p_partkey % 4 + 1] AS placement,
  (['balanced', 'random', 'fixed'])[p_partkey % 3 + 1] AS cut_mode,
  CASE WHEN p_partkey % 3 = 2 THEN (p_size % 5) / 4.0::DOUBLE END AS cut_pos,
  CASE side WHEN 6 THEN 1 WHEN 10 THEN 3 WHEN 16 THEN 6 ELSE 12 END AS loops, side // 2 AS min_distance
  FROM (SELECT *, CASE WHEN p_size % 50 = 0 THEN 24 WHEN p_size % 25 = 1 THEN 16 WHEN p_size % 8 = 3 THEN 10 ELSE 6 END AS side FROM part)"""

GRID_NODES = f"""SELECT *, node % width AS x, node // width AS y
  FROM (SELECT *, unnest(range(width * height))::INTEGER AS node FROM ({GRID_PARAMS}))"""

GRID_EDGES = f"""SELECT graph_id, seed, node AS a, node + 1 AS b, node * 2 AS edge_no FROM ({GRID_NODES}) WHERE x < width - 1
  UNION ALL SELECT graph_id, seed, node, (node + width)::INTEGER, node * 2 + 1 FROM ({GRID_NODES}) WHERE y < height - 1"""


def maze_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About six in ten passages of each grid open, so graphs fall into several parts."""
    from gridtwin.operators.grids import grid_edges

    edges = grid_edges(grid_params(spark, sf_dir), "seed")
    return edges.where(draw(F.col("seed"), F.col("edge_no") + 7000) < 0.6).select("graph_id", "a", "b")


MAZE_EDGES = f"""SELECT graph_id, a, b FROM ({GRID_EDGES}) WHERE {sql.draw('seed', 'edge_no + 7000')} < 0.6"""


def maze_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grids as bit boards, with both corners as ends."""
    from gridtwin.operators.boards import boards_of_edges

    made = boards_of_edges(grid_params(spark, sf_dir), maze_edges(spark, sf_dir))
    return made.withColumn("start", F.lit(0)).withColumn("goal", (F.col("width") * F.col("height") - 1).cast("int"))


def part_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts sold together, over all line items; suppliers have negative numbers."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.lit(0).alias("graph_id"), (-(F.col("l_suppkey") + 1)).alias("a"), F.col("l_partkey").alias("b"))
        .distinct()
    )


# --- rooms from customer -------------------------------------------------------------
ROOM_SIZE = 8
TOKEN_BANDS = (
    (0.50, "."), (0.62, ".+#"), (0.66, ".+#+#"), (0.70, ".+#+#+#"), (0.76, "i"), (0.80, "+"), (0.84, ".+M0"),
    (0.86, ".+M1"), (0.88, ".+f"), (0.90, "+M0"), (0.91, "Sr"), (0.92, "Su"), (0.93, ".+SlO"), (0.95, "l"),
    (0.96, "L"), (0.98, ".+O"), (0.99, ".+o"), (1.0, ".+q"),
)


def room_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x8 room per customer, with one player and one gem."""
    from gridtwin.functions.rng import draw_int

    cell = F.lit(TOKEN_BANDS[-1][1])
    for edge, token in reversed(TOKEN_BANDS[:-1]):
        cell = F.when(F.col("u") < edge, F.lit(token)).otherwise(cell)
    total = ROOM_SIZE * ROOM_SIZE
    key = F.col("c_custkey")
    # a customer is one small row with 64 cells, which are grouped by room
    cells = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(
        key.alias("room_id"),
        draw_int(key, 100, total).alias("player"),
        F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("i"),
    )
    return cells.withColumn("u", draw(F.col("room_id"), F.col("i"))).select(
        "room_id",
        (F.col("i") % ROOM_SIZE).alias("x"),
        F.floor(F.col("i") / ROOM_SIZE).cast("int").alias("y"),
        F.when(F.col("i") == F.col("player"), ".+p")
        .when(F.col("i") == (F.col("player") + 17) % total, ".+G")
        .otherwise(cell)
        .alias("cell"),
    )


def room_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridtwin.operators.rooms import cells_level

    return cells_level(room_cells(spark, sf_dir))


_BANDS = " ".join(f"WHEN u < {edge} THEN '{token}'" for edge, token in TOKEN_BANDS)
ROOM_CELLS = f"""SELECT *, CASE WHEN cell = '+' THEN [''] ELSE string_split(cell, '+') END AS t FROM (
  SELECT room_id, 8 AS width, 8 AS height, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y,
    CASE WHEN i = player THEN '.+p' WHEN i = (player + 17) % 64 THEN '.+G' ELSE (CASE {_BANDS} END) END AS cell
  FROM (SELECT *, {sql.draw('room_id', 'i')} AS u FROM (SELECT c_custkey AS room_id, {sql.draw_int('c_custkey', '100', '64')} AS player,
    unnest(range(64)) AS i FROM customer)))"""
ROOM_LEVELS = f"""SELECT room_id, string_agg(line, chr(10) ORDER BY y) || chr(10) AS text FROM (
  SELECT room_id, y, string_agg(cell, ' ' ORDER BY x) AS line FROM ({ROOM_CELLS}) GROUP BY room_id, y) GROUP BY room_id"""


def edit_results(edits: DataFrame) -> DataFrame:
    """A seeded verdict per edit."""
    from gridtwin.functions.rng import draw_int, fnv1a32_of_rows

    rows = edits.select("edit_id", fnv1a32_of_rows(F.col("edit_id")).alias("h"))
    rows = rows.withColumn("u", draw(7, F.col("h")))
    return rows.select(
        "edit_id",
        F.when(F.col("u") < 0.45, "solved").when(F.col("u") < 0.9, "unsolved").otherwise("over budget").alias("status"),
        F.when(F.col("u") < 0.45, draw_int(8, F.col("h"), 90) + 1).alias("moves"),
    )


def path_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells visited by a known solution, for two rooms in three."""
    cells = room_cells(spark, sf_dir).where(F.col("room_id") % 3 != 0)
    u = draw(F.col("room_id"), F.col("y") * ROOM_SIZE + F.col("x") + 500)
    return cells.withColumn("_u", u).where(F.col("_u") < 0.15).select("room_id", "x", "y")


PATH_CELLS = f"""SELECT room_id, x, y FROM ({ROOM_CELLS}) WHERE room_id % 3 <> 0 AND {sql.draw('room_id', 'y * 8 + x + 500')} < 0.15"""
