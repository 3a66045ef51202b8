"""Rooms: level text, statistics, one-edit variants and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs, sqltext as sql
from catalog.registry import query
from gridtwin.functions import cells as C
from gridtwin.operators import edits, rooms
from gridtwin.session import cut

CELLS, LEVELS = inputs.ROOM_CELLS, inputs.ROOM_LEVELS


def level_cells_of(spark, sf_dir):
    return rooms.level_cells(inputs.room_levels(spark, sf_dir))


@query("level_cells", f"SELECT room_id, width, height, x, y, cell FROM ({CELLS})")
def level_cells(spark, sf_dir):
    return level_cells_of(spark, sf_dir)


WS = sql.SPACE
DOC_GRID = rf"""SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda l: {sql.strip('l')} <> ''),
  lambda l: list_filter(string_split({sql.strip('l')}, ' '), lambda c: c <> '')) AS grid FROM documents"""


@query(
    "documents_as_levels",
    f"""SELECT doc_id, len(grid)::INTEGER AS height, coalesce(list_max(list_transform(grid, lambda r: len(r))), 0)::INTEGER AS width,
    coalesce(list_sum(list_transform(grid, lambda r: len(r))), 0)::BIGINT AS written,
    (len(grid) * coalesce(list_max(list_transform(grid, lambda r: len(r))), 0))::BIGINT AS cells FROM ({DOC_GRID})""",
)
def documents_as_levels(spark, sf_dir):
    """Every whole document read as level text: words are cells, short lines are padded."""
    grid = inputs.table(spark, sf_dir, "documents").select("doc_id", C.level_grid(F.col("text")).alias("grid"))
    size = F.transform("grid", lambda row: F.size(row))
    written = F.transform("grid", lambda row: F.size(F.filter(row, lambda cell: cell != C.LAYER)))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, n: a + n)
    return grid.select(
        "doc_id",
        F.size("grid").alias("height"),
        F.coalesce(F.array_max(size), F.lit(0)).alias("width"),
        add(written).alias("written"),
        add(size).alias("cells"),
    )


@query("level_texts", LEVELS)
def level_texts(spark, sf_dir):
    """Cells to text, back to cells, and to text again."""
    return rooms.cells_level(level_cells_of(spark, sf_dir))


@query(
    "token_stacks",
    f"""SELECT room_id, x, y, len(t)::INTEGER AS layers, t[1] AS bottom, t[-1] AS top, cell AS written FROM ({CELLS})""",
)
def token_stacks(spark, sf_dir):
    tokens = C.split_cell(F.col("cell"))
    return (
        inputs.room_cells(spark, sf_dir)
        .withColumn("tokens", tokens)
        .select(
            "room_id",
            "x",
            "y",
            F.size("tokens").alias("layers"),
            F.col("tokens")[0].alias("bottom"),
            F.element_at("tokens", -1).alias("top"),
            C.join_cell(F.col("tokens")).alias("written"),
        )
    )


KIND = """CASE WHEN token = '.' THEN 'floor' WHEN token = '#' THEN 'wall' WHEN token = 'i' THEN 'ice'
  WHEN regexp_full_match(token, 'S[rlud](#|O)?') THEN 'ice_slope' WHEN token IN ('l', 'L') THEN 'player_lift'
  WHEN token = 'O' THEN 'orange_wall' WHEN token = 'o' THEN 'orange_button' WHEN token = 'p' THEN 'player'
  WHEN token = 'G' THEN 'gem' WHEN regexp_full_match(token, 'M[0-9]+|b') THEN 'box' WHEN token = 'f' THEN 'floating_floor'
  ELSE 'unknown' END"""
TYPED = f"""SELECT room_id, {KIND} AS type FROM (SELECT room_id, unnest(t) AS token FROM ({CELLS})) WHERE token <> ''"""


def listed(kinds: str) -> str:
    return f"coalesce((SELECT string_agg(type || ':' || n, ',' ORDER BY type) FROM counts c WHERE c.room_id = s.room_id AND type IN ({kinds})), '')"


@query(
    "room_statistics",
    f"""WITH counts AS MATERIALIZED (SELECT room_id, type, count(*) AS n FROM ({TYPED}) GROUP BY room_id, type),
    tags AS MATERIALIZED (SELECT DISTINCT room_id, CASE type WHEN 'ice_slope' THEN 'slope' WHEN 'player_lift' THEN 'lift'
        WHEN 'orange_wall' THEN 'orange' WHEN 'orange_button' THEN 'orange' ELSE type END AS tag FROM counts
        WHERE type IN ('ice', 'ice_slope', 'player_lift', 'orange_wall', 'orange_button', 'box', 'floating_floor')
      UNION SELECT room_id, 'holes' FROM ({CELLS}) WHERE cell = '+'
      UNION SELECT room_id, 'elevation' FROM ({CELLS}) WHERE len(t) > 2)
    SELECT s.room_id, 8 AS width, 8 AS height, s.cells_used, s.air, s.max_stack,
      coalesce((SELECT n FROM counts c WHERE c.room_id = s.room_id AND type = 'gem'), 0) AS gems,
      coalesce((SELECT n FROM counts c WHERE c.room_id = s.room_id AND type = 'player'), 0) AS players,
      coalesce((SELECT n FROM counts c WHERE c.room_id = s.room_id AND type = 'unknown'), 0) AS unknown,
      {listed("'player', 'gem', 'box', 'floating_floor'")} AS actors,
      {listed("'floor', 'wall', 'ice', 'ice_slope', 'player_lift', 'orange_wall', 'orange_button'")} AS terrain,
      (SELECT string_agg(tag, '|' ORDER BY tag) FROM tags g WHERE g.room_id = s.room_id) AS tags
    FROM (SELECT room_id, count(*) FILTER (cell <> '+') AS cells_used, count(*) FILTER (cell = '+') AS air,
      max(len(t)) FILTER (cell <> '+')::INTEGER AS max_stack FROM ({CELLS}) GROUP BY room_id) s""",
)
def room_statistics(spark, sf_dir):
    stats = rooms.room_statistics(level_cells_of(spark, sf_dir), rooms.token_types(spark))
    listed_map = lambda c: F.array_join(
        F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ","
    ).alias(c)
    return stats.select(
        "room_id", "width", "height", "cells_used", "air", "max_stack", "gems", "players", "unknown",
        listed_map("actors"), listed_map("terrain"), F.array_join("tags", "|").alias("tags"),
    )


@query(
    "level_zoom",
    f"""SELECT room_id, m AS max_stack, CASE WHEN m <= 3 THEN 1.4 WHEN m <= 5 THEN 1.15 ELSE 0.9 END::DOUBLE AS zoom
    FROM (SELECT room_id, max(len(t))::INTEGER AS m FROM ({CELLS}) GROUP BY room_id)""",
)
def level_zoom(spark, sf_dir):
    return rooms.level_zoom(inputs.room_levels(spark, sf_dir))


# --- edits -------------------------------------------------------------------------------
def _at(kind: str, layer: str = "0") -> str:
    return f"room_id || '/{kind}/' || x || ',' || y || '/' || {layer}"


def _single(kind: str, after: str, condition: str) -> str:
    return f"""SELECT room_id, {_at(kind)} AS edit_id, '{kind}' AS type, x, y, cell AS before, {after} AS after,
      NULL::INTEGER AS to_x, NULL::INTEGER AS to_y, NULL AS to_before, NULL AS to_after FROM cells WHERE {condition}"""


def _move(kind: str, source: str, left: str, moved: str, condition: str) -> str:
    return f"""SELECT s.room_id, s.room_id || '/{kind}/' || s.x || ',' || s.y || '/' || f.x || ',' || f.y AS edit_id, '{kind}' AS type,
      s.x, s.y, s.cell, {left}, f.x, f.y, f.cell, {moved} FROM (SELECT * FROM cells WHERE {source}) s
      JOIN (SELECT * FROM cells WHERE cell = '.') f ON f.room_id = s.room_id AND {condition}"""


WALLS = "len(t) >= 2 AND t[-1] = '#' AND t[1] = '.'"
LAYERED = "(SELECT *, unnest(range(len(t))) AS layer FROM cells)"
TURNED = "translate(substr(t[layer + 1], 1, 2), 'rlud', 'lrdu') || substr(t[layer + 1], 3)"
FIRST = lambda token: f"array_to_string(list_concat(s.t[:list_position(s.t, '{token}') - 1], s.t[list_position(s.t, '{token}') + 1:]), '+')"


def _layer(kind: str, token: str, condition: str) -> str:
    after = f"array_to_string(list_concat(list_concat(t[:layer], [{token}]), t[layer + 2:]), '+')"
    return f"""SELECT room_id, {_at(kind, 'layer')}, '{kind}', x, y, cell, {after}, NULL, NULL, NULL, NULL FROM {LAYERED} WHERE {condition}"""


WITH_EDITS = f"""cells AS MATERIALIZED ({CELLS}), edits AS MATERIALIZED (
  {_single('add_wall', "'.+#'", "cell = '.'")} UNION ALL {_single('floor_to_ice', "'i'", "cell = '.'")}
  UNION ALL {_single('floor_to_hole', "'+'", "cell = '.'")} UNION ALL {_single('ice_to_floor', "'.'", "cell = 'i'")}
  UNION ALL {_single('hole_to_floor', "'.'", "cell = '+' AND x > 0 AND y > 0 AND x < width - 1 AND y < height - 1")}
  UNION ALL {_single('remove_wall', "'.'", "cell = '.+#'")} UNION ALL {_single('raise_wall', "cell || '+#'", WALLS)}
  UNION ALL {_single('lower_wall', "array_to_string(t[:-2], '+')", f"{WALLS} AND len(t) >= 3")}
  UNION ALL {_layer('flip_slope', TURNED, "regexp_full_match(t[layer + 1], 'S[rlud](#|O)?')")}
  UNION ALL {_layer('toggle_lift', "CASE t[layer + 1] WHEN 'l' THEN 'L' ELSE 'l' END", "t[layer + 1] IN ('l', 'L')")}
  UNION ALL {_move('move_gem', "list_contains(t, 'G')", FIRST('G'), "'.+G'", 'true')}
  UNION ALL {_move('move_player', "list_contains(t, 'p')", FIRST('p'), "'.+p'", 'true')}
  UNION ALL {_move('move_box', "len(t) >= 2 AND t[1] = '.' AND regexp_full_match(t[-1], 'M[0-9]+|b|f')",
                   "array_to_string(s.t[:-2], '+')", "'.+' || s.t[-1]", 'abs(f.x - s.x) + abs(f.y - s.y) = 1')})"""
EDIT_COLUMNS = "room_id, edit_id, type, x, y, before, after, to_x, to_y, to_before, to_after"


def flat_changes(df, *keep):
    first, second = F.col("changes")[0], F.try_element_at("changes", F.lit(2))
    return df.select(
        *keep,
        *[first[c].alias(c) for c in ("x", "y", "before", "after")],
        *[second[c].alias(f"to_{c}") for c in ("x", "y", "before", "after")],
    )


def edits_of(spark, sf_dir):
    return edits.enumerate_edits(inputs.room_levels(spark, sf_dir))


@query("enumerated_edits", f"WITH {WITH_EDITS} SELECT {EDIT_COLUMNS} FROM edits")
def enumerated_edits(spark, sf_dir):
    return flat_changes(edits_of(spark, sf_dir), "room_id", "edit_id", "type")


WITH_SAMPLE = f"""{WITH_EDITS}, visited AS MATERIALIZED ({inputs.PATH_CELLS}),
  near AS MATERIALIZED (SELECT e.*, EXISTS (SELECT 1 FROM visited v WHERE v.room_id = e.room_id
      AND ((v.x = e.x AND v.y = e.y) OR (v.x = e.to_x AND v.y = e.to_y))) AS near FROM edits e),
  shuffled AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY room_id, type, near
      ORDER BY {sql.draw('5', 'h')}, edit_id) AS r FROM (SELECT *, {sql.fnv('edit_id')} AS h FROM near)),
  sampled AS MATERIALIZED (SELECT * FROM (SELECT *, CASE WHEN near THEN r ELSE r + least(4, count(*) FILTER (near)
      OVER (PARTITION BY room_id, type)) END AS k FROM shuffled) WHERE k <= 8 AND (NOT near OR r <= 4))"""
PRIORITY = "list_position([" + ", ".join(f"'{p}'" for p in edits.PRIORITY) + "], type)"
WITH_TRIES = f"""{WITH_SAMPLE}, tries AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY k, {PRIORITY}) AS try_no,
    CASE WHEN u < 0.45 THEN 'solved' WHEN u < 0.9 THEN 'unsolved' ELSE 'capped' END AS status,
    CASE WHEN u < 0.45 THEN {sql.draw_int('8', 'h', '90')} + 1 END AS moves
  FROM (SELECT *, {sql.draw('7', 'h')} AS u FROM sampled))"""
WITH_ENOUGH = f"""{WITH_TRIES},
  counted AS MATERIALIZED (SELECT *, count(*) FILTER (status = 'solved') OVER t >= 2 AND count(*) FILTER (status = 'unsolved') OVER t >= 2 AS ready,
      count(*) FILTER (status <> 'capped') OVER (PARTITION BY room_id ORDER BY try_no) AS verdicts
    FROM tries WINDOW t AS (PARTITION BY room_id, type ORDER BY try_no)),
  stops AS (SELECT room_id, min(try_no) AS stop FROM (SELECT *, bool_or(ready) OVER (PARTITION BY room_id ORDER BY try_no) AS any_ready
      FROM counted) WHERE any_ready AND verdicts >= 8 GROUP BY room_id),
  done AS MATERIALIZED (SELECT t.* FROM tries t LEFT JOIN stops s ON s.room_id = t.room_id WHERE s.stop IS NULL OR t.try_no <= s.stop)"""


def near_of(spark, sf_dir):
    levels = edits.with_paths(inputs.room_levels(spark, sf_dir), inputs.path_cells(spark, sf_dir))
    return edits.touching(edits.enumerate_edits(levels, ["visited"]))


def tries_of(spark, sf_dir):
    near = near_of(spark, sf_dir)
    ordered = cut(edits.try_order(edits.sample_edits(near, 5, 8)), "tries")
    return edits.with_status(ordered, inputs.edit_results(ordered))


@query("sampled_edits", f"WITH {WITH_SAMPLE} SELECT room_id, edit_id, type, k FROM sampled")
def sampled_edits(spark, sf_dir):
    near = near_of(spark, sf_dir)
    return edits.sample_edits(near, 5, 8).select("room_id", "edit_id", "type", "k")


@query("try_order", f"WITH {WITH_TRIES} SELECT room_id, edit_id, try_no::INTEGER AS try_no FROM tries")
def try_order(spark, sf_dir):
    return tries_of(spark, sf_dir).select("room_id", "edit_id", "try_no")


@query(
    "tried_counts",
    f"""WITH {WITH_TRIES} SELECT room_id, count(*) AS tried, count(*) FILTER (status = 'solved') AS solved,
    count(*) FILTER (status = 'unsolved') AS unsolved, count(*) FILTER (status = 'capped') AS capped FROM tries GROUP BY room_id""",
)
def tried_counts(spark, sf_dir):
    return edits.tried_counts(tries_of(spark, sf_dir))


@query("tries_until_enough", f"WITH {WITH_ENOUGH} SELECT room_id, edit_id, try_no::INTEGER AS try_no, status FROM done")
def tries_until_enough(spark, sf_dir):
    return edits.until_enough(tries_of(spark, sf_dir), 2).select("room_id", "edit_id", "try_no", "status")


WITH_MATCHES = f"""{WITH_ENOUGH},
  sides AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY room_id, type, status ORDER BY try_no) AS pr FROM done WHERE status <> 'capped'),
  same AS MATERIALIZED (SELECT room_id, k, yes, no, true AS same_type FROM (SELECT s.room_id, s.edit_id AS yes, u.edit_id AS no,
      row_number() OVER (PARTITION BY s.room_id ORDER BY {PRIORITY.replace('], type)', '], s.type)')}, s.pr) - 1 AS k
    FROM sides s JOIN sides u ON u.room_id = s.room_id AND u.type = s.type AND u.pr = s.pr
    WHERE s.status = 'solved' AND u.status = 'unsolved') WHERE k < 2),
  leftover AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY room_id, status ORDER BY try_no) AS q FROM sides d
    WHERE NOT EXISTS (SELECT 1 FROM same m WHERE m.yes = d.edit_id OR m.no = d.edit_id)),
  matches AS MATERIALIZED (SELECT * FROM same UNION ALL SELECT * FROM (SELECT s.room_id,
      s.q - 1 + coalesce((SELECT count(*) FROM same m WHERE m.room_id = s.room_id), 0) AS k, s.edit_id, u.edit_id, s.type = u.type
    FROM leftover s JOIN leftover u ON u.room_id = s.room_id AND u.q = s.q WHERE s.status = 'solved' AND u.status = 'unsolved') WHERE k < 2)"""


def matches_of(spark, sf_dir):
    tries = cut(edits.until_enough(tries_of(spark, sf_dir), 2), "tries")
    return edits.match_pairs(tries, 2)


@query("matched_pairs", f"WITH {WITH_MATCHES} SELECT room_id, k::INTEGER AS k, same_type, yes AS positive_edit, no AS negative_edit FROM matches")
def matched_pairs(spark, sf_dir):
    return matches_of(spark, sf_dir).select(
        "room_id", "k", "same_type", F.col("positive.edit_id").alias("positive_edit"), F.col("negative.edit_id").alias("negative_edit")
    )


WITH_RECORDS = f"""{WITH_MATCHES},
  members AS MATERIALIZED (SELECT room_id || '-' || k || '-yes' AS id, room_id, room_id || '-' || k AS pair, true AS solvable, same_type, yes AS edit_id FROM matches
    UNION ALL SELECT room_id || '-' || k || '-no', room_id, room_id || '-' || k, false, same_type, no FROM matches),
  changed AS MATERIALIZED (SELECT m.id, m.pair, m.solvable, m.room_id, m.same_type, e.type, e.moves, c.x, c.y, c.t AS old, CASE WHEN c.x = e.x AND c.y = e.y THEN e.after
      WHEN c.x = e.to_x AND c.y = e.to_y THEN e.to_after ELSE c.cell END AS cell
    FROM members m JOIN done e ON e.edit_id = m.edit_id JOIN cells c ON c.room_id = m.room_id),
  records AS MATERIALIZED (SELECT id, pair, solvable, room_id, same_type, type, moves, string_agg(line, chr(10) ORDER BY y) || chr(10) AS level
    FROM (SELECT id, pair, solvable, room_id, same_type, type, moves, y, string_agg(cell, ' ' ORDER BY x) AS line FROM changed GROUP BY ALL) GROUP BY ALL)"""


def records_of(spark, sf_dir):
    facts = inputs.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("room_id"),
        F.col("c_mktsegment").alias("world"),
        F.col("c_nationkey").alias("base_moves"),
        F.array(F.lit("ice")).alias("tags"),
        F.lit(1).alias("gems"),
    )
    return edits.pair_records(matches_of(spark, sf_dir), facts, inputs.room_levels(spark, sf_dir))


@query(
    "pair_records",
    f"""WITH {WITH_RECORDS} SELECT id, room_id AS room, c_mktsegment AS world, pair, solvable, same_type, type, c_nationkey AS base_moves,
    moves, level FROM records JOIN customer ON c_custkey = room_id""",
)
def pair_records(spark, sf_dir):
    records = records_of(spark, sf_dir)
    return records.select(
        "id", "room", "world", "pair", "solvable", "same_type", F.col("edit.type").alias("type"), "base_moves", "moves", "level"
    )


@query(
    "edited_levels",
    f"""WITH {WITH_EDITS} SELECT e.edit_id, string_agg(CASE WHEN c.x = e.x AND c.y = e.y THEN e.after
      WHEN c.x = e.to_x AND c.y = e.to_y THEN e.to_after ELSE c.cell END, ' ' ORDER BY c.y, c.x) AS cells
    FROM edits e JOIN cells c ON c.room_id = e.room_id
    GROUP BY e.edit_id""",
)
def edited_levels(spark, sf_dir):
    """Rooms after every edit of every type; an edit carries its room's text."""
    edited = edits.apply_edits(None, edits.enumerate_edits(inputs.room_levels(spark, sf_dir), ["text"]))
    return edited.select("edit_id", F.trim(F.replace(F.col("level"), F.lit("\n"), F.lit(" "))).alias("cells"))


@query(
    "pair_audit",
    f"""WITH {WITH_RECORDS} SELECT pair, members, positive, differing, complete,
      members = 2 AND positive = 1 AND differing BETWEEN 1 AND 4 AND complete AS ok
    FROM (SELECT a.pair, 2::BIGINT AS members, 1::BIGINT AS positive, count(*) FILTER (a.cell <> b.cell)::INTEGER AS differing,
      count(*) FILTER (a.cell LIKE '%G%') > 0 AND count(*) FILTER (a.cell LIKE '%p%') > 0
      AND count(*) FILTER (b.cell LIKE '%G%') > 0 AND count(*) FILTER (b.cell LIKE '%p%') > 0 AS complete
    FROM (SELECT * FROM changed WHERE solvable) a JOIN (SELECT * FROM changed WHERE NOT solvable) b
      ON a.pair = b.pair AND a.x = b.x AND a.y = b.y GROUP BY a.pair)""",
)
def pair_audit(spark, sf_dir):
    return edits.pair_audit(records_of(spark, sf_dir))


# --- known results ---------------------------------------------------------------------------
RESULTS = f"""SELECT o_orderkey AS room_id, CASE o_orderstatus WHEN 'F' THEN 'solved' WHEN 'O' THEN 'unsolved' ELSE 'capped' END AS status,
  o_custkey AS moves FROM orders WHERE {sql.draw('o_orderkey', '77')} < 0.7"""
ROOM_FILES = "SELECT o_orderkey AS room_id, 'level_' || o_orderkey || '.txt' AS file FROM orders"


def results_of(spark, sf_dir):
    from gridtwin.functions.rng import draw

    orders = inputs.table(spark, sf_dir, "orders")
    return (
        orders.withColumn("u", draw(F.col("o_orderkey"), 77))
        .where(F.col("u") < 0.7)
        .select(
            F.col("o_orderkey").alias("room_id"),
            F.when(F.col("o_orderstatus") == "F", "solved").when(F.col("o_orderstatus") == "O", "unsolved").otherwise("capped").alias("status"),
            F.col("o_custkey").alias("moves"),
        )
    )


def files_of(spark, sf_dir):
    key = F.col("o_orderkey")
    return inputs.table(spark, sf_dir, "orders").select(
        key.alias("room_id"), F.concat(F.lit("level_"), key, F.lit(".txt")).alias("file")
    )


@query("status_counts", f"SELECT status, count(*) AS n FROM ({RESULTS}) GROUP BY status")
def status_counts(spark, sf_dir):
    return rooms.status_counts(results_of(spark, sf_dir))


@query("rooms_not_recorded", f"SELECT * FROM ({ROOM_FILES}) WHERE room_id NOT IN (SELECT room_id FROM ({RESULTS}))")
def rooms_not_recorded(spark, sf_dir):
    return rooms.not_recorded(files_of(spark, sf_dir), results_of(spark, sf_dir))


USABLE = f"SELECT f.room_id, file, status, moves FROM ({ROOM_FILES}) f LEFT JOIN ({RESULTS}) r ON r.room_id = f.room_id WHERE status IS NULL OR status = 'solved'"


@query("usable_rooms", USABLE)
def usable_rooms(spark, sf_dir):
    return rooms.usable_rooms(files_of(spark, sf_dir), results_of(spark, sf_dir))


@query(
    "skipped_rooms",
    f"""SELECT f.room_id, coalesce(status, 'no result') AS reason FROM ({ROOM_FILES}) f LEFT JOIN ({RESULTS}) r ON r.room_id = f.room_id
    WHERE coalesce(status, '') <> 'solved'""",
)
def skipped_rooms(spark, sf_dir):
    return rooms.skipped_rooms(files_of(spark, sf_dir), results_of(spark, sf_dir))


@query("first_usable_rooms", f"SELECT * FROM ({USABLE}) ORDER BY file LIMIT 50")
def first_usable_rooms(spark, sf_dir):
    """Top 50 by file name."""
    return rooms.usable_rooms(files_of(spark, sf_dir), results_of(spark, sf_dir), limit=50)


@query(
    "verification_audit",
    f"""SELECT count(*) AS n, count(*) FILTER (solvable) AS solvable, count(*) FILTER (verified IS NULL) AS capped,
    count(*) FILTER (verified <> solvable) AS mismatches FROM ({inputs.PAIRED_ITEMS})""",
)
def verification_audit(spark, sf_dir):
    return rooms.verification_audit(inputs.paired_items(spark, sf_dir))
