"""Seeded randomness, pairs, balance and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs, sqltext as sql
from catalog.registry import query
from gridtwin.functions import rng
from gridtwin.functions.images import image_paths, normalise_angles
from gridtwin.operators import ranking, sampling

ITEMS = inputs.PAIRED_ITEMS
VALID = inputs.VALID_PAIRS


# --- seeded randomness ----------------------------------------------------------------
@query(
    "seeded_draws",
    f"""SELECT event_id, k, {sql.draw('event_id', 'k')} AS u FROM events, (SELECT unnest([0, 1, 2]) AS k)""",
)
def seeded_draws(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select("event_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    return rows.withColumn("u", rng.draw(F.col("event_id"), F.col("k")))


@query(
    "seeded_integers",
    f"SELECT o_orderkey, {sql.draw_int('o_orderkey', '5', '6')} AS die, {sql.draw('o_orderkey', '1')} < 0.5 AS coin FROM orders",
)
def seeded_integers(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.select(
        "o_orderkey", rng.draw_int(F.col("o_orderkey"), 5, 6).alias("die"), rng.coin(F.col("o_orderkey"), 1).alias("coin")
    )


@query("text_hashes", f"SELECT doc_id, ({sql.fnv('text')})::BIGINT AS hash FROM documents")
def text_hashes(spark, sf_dir):
    """Hash of every whole document."""
    documents = inputs.table(spark, sf_dir, "documents")
    return documents.select("doc_id", rng.fnv1a32(F.col("text")).alias("hash"))


MIXED_SEEDS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '  ' || (event_id * 7919 * 104729) || ' '
  WHEN 1 THEN '-' || event_id WHEN 2 THEN event_type || chr(10) END AS seed_text FROM events"""


@query("normalised_seeds", f"SELECT event_id, {sql.seed_of_text('seed_text')} AS seed FROM ({MIXED_SEEDS})")
def normalised_seeds(spark, sf_dir):
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("  "), (F.col("event_id") * 7919 * 104729).cast("string"), F.lit(" ")))
        .when(kind == 1, F.concat(F.lit("-"), F.col("event_id")))
        .when(kind == 2, F.concat("event_type", F.lit("\n")))
    )
    return inputs.table(spark, sf_dir, "events").select("event_id", rng.seed_from_text(text).alias("seed"))


@query(
    "normalised_number_seeds",
    """SELECT event_id, (((trunc((event_id - 5000) * value * 1000)::BIGINT % 4294967296) + 4294967296) % 4294967296)::BIGINT
    AS seed FROM events""",
)
def normalised_number_seeds(spark, sf_dir):
    number = (F.col("event_id") - 5000) * F.col("value") * 1000
    return inputs.table(spark, sf_dir, "events").select("event_id", rng.seed_from_number(number).alias("seed"))


@query(
    "trial_seeds",
    f"SELECT o_orderkey, {sql.seed_of_text(chr(39) + 'evening:' + chr(39) + ' || o_orderkey')} AS seed FROM orders",
)
def trial_seeds(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", rng.trial_seed("evening", F.col("o_orderkey")).alias("seed"))


@query(
    "seeded_shuffle",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY {sql.draw('11', 'o_orderkey')}, o_orderkey) AS place FROM orders""",
)
def seeded_shuffle(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey")
    return ranking.seeded_rank(orders, 11, "o_orderkey", "place")


@query(
    "seeded_shuffle_by_group",
    f"""SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus
    ORDER BY {sql.draw('12', 'o_orderkey')}, o_orderkey) AS place FROM orders""",
)
def seeded_shuffle_by_group(spark, sf_dir):
    """Three groups, one of them large: each is ranked by many tasks."""
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    return ranking.seeded_rank(orders, 12, "o_orderkey", "place", ["o_orderstatus"])


# --- pairs ----------------------------------------------------------------------------
@query("valid_pairs", f"SELECT id, pair, solvable FROM ({ITEMS}) WHERE pair IN ({VALID})")
def valid_pairs(spark, sf_dir):
    return sampling.valid_pairs(inputs.paired_items(spark, sf_dir)).select("id", "pair", "solvable")


@query(
    "verified_pairs",
    f"""SELECT id, pair, solvable FROM ({ITEMS}) WHERE pair IN ({VALID}) AND pair NOT IN
    (SELECT pair FROM ({ITEMS}) WHERE verified IS NOT NULL AND verified <> solvable)""",
)
def verified_pairs(spark, sf_dir):
    return sampling.valid_pairs(inputs.paired_items(spark, sf_dir), verified_only=True).select("id", "pair", "solvable")


@query("items_with_tag", f"SELECT id, pair FROM ({ITEMS}) WHERE list_contains(coalesce(tags, []), 'ice')")
def items_with_tag(spark, sf_dir):
    return sampling.with_tag(inputs.paired_items(spark, sf_dir), "ice").select("id", "pair")


@query(
    "oriented_pairs",
    f"""SELECT pair, max(id) FILTER (solvable) AS positive_id, max(id) FILTER (NOT solvable) AS negative_id,
    min(id) AS left_id, max(id) AS right_id FROM ({ITEMS}) WHERE pair IN ({VALID}) GROUP BY pair""",
)
def oriented_pairs(spark, sf_dir):
    return sampling.oriented_pairs(inputs.paired_items(spark, sf_dir))


@query(
    "twins",
    f"""SELECT a.id, a.pair, b.id AS twin_id, b.solvable AS twin_solvable FROM ({ITEMS}) a JOIN ({ITEMS}) b
    ON a.pair = b.pair AND a.id <> b.id""",
)
def twins(spark, sf_dir):
    return sampling.twins(inputs.paired_items(spark, sf_dir)).select("id", "pair", "twin_id", "twin_solvable")


def sampled_pairs(keep: str) -> str:
    return f"""SELECT id, pair, solvable, row_number() OVER (ORDER BY {sql.draw('22', 'id')}, id) - 1 AS trial
    FROM ({ITEMS}) WHERE pair IN (SELECT pair FROM (SELECT pair,
      row_number() OVER (ORDER BY {sql.draw('21', 'pair')}, pair) AS r FROM ({VALID})) WHERE {keep})"""


@query("pair_sample", sampled_pairs("r <= 100"))
def pair_sample(spark, sf_dir):
    return sampling.pair_sample(inputs.paired_items(spark, sf_dir), 21, 200).select("id", "pair", "solvable", "trial")


@query("pair_sample_of_all", sampled_pairs("true"))
def pair_sample_of_all(spark, sf_dir):
    return sampling.pair_sample(inputs.paired_items(spark, sf_dir), 21, 0).select("id", "pair", "solvable", "trial")


@query(
    "first_pairs_of_sets",
    f"""SELECT set_id, pair, id FROM ({ITEMS}) i WHERE set_id NOT IN ('Brand#1', 'Brand#2') OR EXISTS (
      SELECT 1 FROM (SELECT set_id, pair, row_number() OVER (PARTITION BY set_id ORDER BY first, pair) AS r
        FROM (SELECT set_id, pair, min(position) AS first FROM ({ITEMS}) GROUP BY set_id, pair)) p
      WHERE p.set_id = i.set_id AND p.pair = i.pair AND r <= (CASE i.set_id WHEN 'Brand#1' THEN 10 ELSE 4 END))""",
)
def first_pairs_of_sets(spark, sf_dir):
    limited = sampling.first_pairs(inputs.paired_items(spark, sf_dir), {"Brand#1": 10, "Brand#2": 4})
    return limited.select("set_id", "pair", "id")


# --- balance ----------------------------------------------------------------------------
@query(
    "balanced_trials",
    f"""SELECT index, {sql.seed_of_text(chr(39) + 'evening:' + chr(39) + ' || index')} AS seed, r % 2 = 1 AS solvable
    FROM (SELECT o_orderkey AS index, row_number() OVER (ORDER BY {sql.draw('31', 'o_orderkey')}, o_orderkey) AS r
    FROM orders)""",
)
def balanced_trials(spark, sf_dir):
    indexed = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"))
    return sampling.balanced_trials(indexed, "evening", 31)


BALANCED = f"""SELECT id, solvable FROM (SELECT *, row_number() OVER (PARTITION BY solvable
  ORDER BY {sql.draw('41', 'id')}, id) AS r FROM ({ITEMS})) WHERE r <= 150"""


@query(
    "balanced_subset",
    f"SELECT id, solvable, row_number() OVER (ORDER BY {sql.draw('42', 'id')}, id) - 1 AS trial FROM ({BALANCED})",
)
def balanced_subset(spark, sf_dir):
    return sampling.balanced_subset(inputs.paired_items(spark, sf_dir).select("id", "solvable"), 300, 41)


CUSTOMER_PLAN = f"""SELECT o_custkey, split, (row_number() OVER (PARTITION BY split ORDER BY r)) % 2 = 1 AS label FROM (
  SELECT o_custkey, r, CASE WHEN r <= round_even(0.8 * n, 0) THEN 'train'
    WHEN r <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT o_custkey, row_number() OVER (ORDER BY {sql.draw('51', 'o_custkey')}, o_custkey) AS r,
    count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)))"""


@query(
    "exact_splits",
    f"SELECT o_orderkey, o_custkey, split FROM orders JOIN ({CUSTOMER_PLAN}) USING (o_custkey)",
)
def exact_splits(spark, sf_dir):
    """All orders of a customer stay in one split."""
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    plan = sampling.split_plan(orders.select("o_custkey").distinct(), "o_custkey", (0.8, 0.1, 0.1), 51)
    return orders.join(plan.select("o_custkey", "split"), "o_custkey")


@query("alternating_labels", CUSTOMER_PLAN)
def alternating_labels(spark, sf_dir):
    customers = inputs.table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return sampling.split_plan(customers, "o_custkey", (0.8, 0.1, 0.1), 51)


SEED_PATHS = f"SELECT o_orderkey AS seed, {sql.draw_int('o_orderkey', '9', '40')} AS tree_path_length FROM orders"


def seed_paths(spark, sf_dir):
    return inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seed"), rng.draw_int(F.col("o_orderkey"), 9, 40).alias("tree_path_length")
    )


@query(
    "first_valid_seeds",
    f"""SELECT seed, tree_path_length, row_number() OVER (ORDER BY seed) - 1 AS idx FROM ({SEED_PATHS})
    WHERE tree_path_length >= 12 QUALIFY idx < 1000""",
)
def first_valid_seeds(spark, sf_dir):
    return sampling.first_valid_seeds(seed_paths(spark, sf_dir), 1000, 12)


@query(
    "skipped_seeds",
    f"""WITH valid AS (SELECT seed FROM ({SEED_PATHS}) WHERE tree_path_length >= 12 ORDER BY seed LIMIT 1000)
    SELECT (SELECT count(*) FROM valid) AS chosen, (SELECT count(*) FROM ({SEED_PATHS})
      WHERE tree_path_length < 12 AND seed < (SELECT max(seed) FROM valid)) AS skipped""",
)
def skipped_seeds(spark, sf_dir):
    return sampling.skipped_seeds(seed_paths(spark, sf_dir), 1000, 12)


PAIR_PLAN = f"""SELECT pair AS idx, split, (row_number() OVER (PARTITION BY split ORDER BY r)) % 2 = 1 AS label FROM (
  SELECT pair, r, CASE WHEN r <= round_even(0.7 * n, 0) THEN 'train'
    WHEN r <= round_even(0.7 * n, 0) + round_even(0.15 * n, 0) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT pair, row_number() OVER (ORDER BY {sql.draw('61', 'pair')}, pair) AS r, count(*) OVER () AS n FROM ({VALID})))"""


def planned_members(spark, sf_dir, both):
    items = inputs.paired_items(spark, sf_dir).select("id", "pair", "solvable")
    pairs = sampling.pair_table(items).withColumnRenamed("pair", "idx")
    plan = sampling.split_plan(pairs, "idx", (0.7, 0.15, 0.15), 61)
    members = items.select(F.col("pair").alias("idx"), "solvable", F.col("id").alias("source_id"))
    return sampling.emit_members(plan, members, both)


@query(
    "emitted_pairs",
    f"""SELECT idx, solvable, id AS source_id, split, printf('%06d', 2 * idx + CASE WHEN solvable THEN 0 ELSE 1 END) AS id
    FROM ({ITEMS}) i JOIN ({PAIR_PLAN}) p ON i.pair = p.idx""",
)
def emitted_pairs(spark, sf_dir):
    return planned_members(spark, sf_dir, True)


@query(
    "emitted_members",
    f"""SELECT idx, solvable, id AS source_id, split, printf('%06d', idx) AS id
    FROM ({ITEMS}) i JOIN ({PAIR_PLAN}) p ON i.pair = p.idx AND i.solvable = p.label""",
)
def emitted_members(spark, sf_dir):
    return planned_members(spark, sf_dir, False)


# --- catalogue views ----------------------------------------------------------------------
ANGLES = "coalesce(yaws, [0])"
PICKED = f"""SELECT *, CASE WHEN view = 'top' THEN 0 ELSE ({ANGLES})[{sql.draw_int('73', 'id', f'len({ANGLES})')} + 1] END AS yaw
  FROM (SELECT *, CASE WHEN top_image IS NOT NULL AND {sql.draw('72', 'id')} < 0.4 THEN 'top' ELSE 'perspective' END AS view
    FROM ({ITEMS}))"""


@query(
    "selection_view_mixed",
    f"""SELECT row_number() OVER (ORDER BY len({ANGLES}) DESC, {sql.draw('71', 'id')}, id) AS position,
    id, pair, solvable, view, yaw FROM ({PICKED})""",
)
def selection_view_mixed(spark, sf_dir):
    return sampling.selection_view(inputs.paired_items(spark, sf_dir), 71)


@query(
    "selection_view_turned",
    f"""SELECT row_number() OVER (ORDER BY len({ANGLES}) DESC, {sql.draw('71', 'id')}, id) AS position,
    id, pair, solvable, 'perspective' AS view, 90 AS yaw FROM ({ITEMS})
    WHERE set_id = 'Brand#3' AND list_contains(coalesce(tags, []), 'ice') AND list_contains({ANGLES}, 90)""",
)
def selection_view_turned(spark, sf_dir):
    return sampling.selection_view(inputs.paired_items(spark, sf_dir), 71, "Brand#3", "ice", "perspective", "90")


@query(
    "facets_of_sets",
    f"""SELECT set_id, items, solvable_items, coalesce(pairs, 0) AS pairs, coalesce(rooms, 0) AS rooms, coalesce(tags, '') AS tags
    FROM (SELECT set_id, count(*) AS items, count(*) FILTER (solvable) AS solvable_items FROM ({ITEMS}) GROUP BY set_id)
    LEFT JOIN (SELECT set_id, count(DISTINCT pair) AS pairs, count(DISTINCT room) AS rooms FROM ({ITEMS})
      WHERE pair IN ({VALID}) GROUP BY set_id) USING (set_id)
    LEFT JOIN (SELECT set_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags
      FROM (SELECT set_id, unnest(tags) AS tag FROM ({ITEMS})) GROUP BY set_id) USING (set_id)""",
)
def facets_of_sets(spark, sf_dir):
    return sampling.facets(inputs.paired_items(spark, sf_dir))


def path_of(angle: str) -> str:
    fallback = "perspective" if angle == "0" else "NULL"
    return f"CASE WHEN list_contains(yaws, {angle}) THEN 'images/' || id || '-y{angle}.png' ELSE {fallback} END"


@query(
    "image_paths_of_views",
    f"""SELECT id, coalesce(top_image, '') AS top,
    array_to_string(list_filter([{path_of('0')}, {path_of('180')}], lambda p: p IS NOT NULL), '|') AS turned,
    coalesce(array_to_string(list_transform(yaws, lambda y: 'images/' || id || '-y' || y || '.png'), '|'), '') AS every_angle
    FROM ({ITEMS})""",
)
def image_paths_of_views(spark, sf_dir):
    images = F.col("images")
    return inputs.paired_items(spark, sf_dir).select(
        "id",
        F.array_join(image_paths(images, "top"), "|").alias("top"),
        F.array_join(image_paths(images, "perspective", "0,180"), "|").alias("turned"),
        F.array_join(image_paths(images, "perspective", "all"), "|").alias("every_angle"),
    )


@query(
    "normalised_angles",
    """SELECT event_id, array_to_string(list_transform(list_filter(list_transform(
      [event_id * 45 - 900, event_id, -90], lambda a: ((a % 360) + 360) % 360), lambda a: a % 90 = 0),
      lambda a: a::VARCHAR), ',') AS angles FROM events""",
)
def normalised_angles(spark, sf_dir):
    listed = F.concat_ws(",", F.col("event_id") * 45 - 900, F.col("event_id"), F.lit("-90"))
    angles = F.transform(normalise_angles(listed), lambda a: a.cast("string"))
    return inputs.table(spark, sf_dir, "events").select("event_id", F.array_join(angles, ",").alias("angles"))
