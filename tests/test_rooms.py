"""Rooms, edits and pair matching against step-by-step Python, files and a damaged input."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridtwin.operators import edits, messages, rooms, scoring
from gridtwin.sources import readers, writers

LEVEL = ". .+# .+p +\n\n.+G i SlO l\n.+M0 . .+#+# +M1\n. .\n"


@pytest.fixture(scope="module")
def level(spark):
    return spark.createDataFrame([("r1", LEVEL)], "room_id string, text string")


def test_statistics(spark, level):
    cells = rooms.level_cells(level)
    assert cells.count() == 16
    stats = rooms.room_statistics(cells, rooms.token_types(spark)).first()
    assert (stats.width, stats.height, stats.air, stats.cells_used, stats.max_stack, stats.gems, stats.players) == (4, 4, 3, 13, 3, 1, 1)
    assert stats.tags == ["box", "elevation", "holes", "ice", "lift", "slope"]
    assert rooms.level_zoom(level).first().zoom == 1.4
    again = rooms.level_cells(rooms.cells_level(cells))
    assert again.exceptAll(cells).isEmpty() and cells.exceptAll(again).isEmpty()


def test_every_edit_type(spark, level):
    found = edits.enumerate_edits(level)
    n = {r.type: r["count"] for r in found.groupBy("type").count().collect()}
    floors = 4
    # the box +M1 stands on air, so only the one on floor moves; two floors lie beside it
    assert n == {
        "add_wall": floors, "floor_to_ice": floors, "floor_to_hole": floors, "ice_to_floor": 1, "remove_wall": 1,
        "raise_wall": 2, "lower_wall": 1, "flip_slope": 1, "toggle_lift": 1, "move_gem": floors, "move_player": floors,
        "move_box": 2,
    }
    edited = {r.edit_id: r.level for r in edits.apply_edits(level, found).collect()}
    assert len(edited) == found.count()
    assert edited["r1/flip_slope/2,1/0"].split("\n")[1] == ".+G i SrO l"
    assert edited["r1/toggle_lift/3,1/0"].split("\n")[1] == ".+G i SlO L"
    assert edited["r1/move_gem/0,1/0,0"].split("\n")[:2] == [".+G .+# .+p +", ". i SlO l"]
    assert edited["r1/lower_wall/2,2/0"].split("\n")[2] == ".+M0 . .+# +M1"
    assert edited["r1/move_box/0,2/1,2"].split("\n")[2] == ". .+M0 .+#+# +M1"


def test_sampling_prefers_the_path(spark):
    rows = [("a", f"e{i}", "add_wall", i < 2) for i in range(20)] + [("b", f"f{i}", "add_wall", i < 9) for i in range(20)]
    table = spark.createDataFrame(rows, "room_id string, edit_id string, type string, near boolean")
    picked = edits.sample_edits(table, 1, 5).collect()
    by_room = {room: sorted((r.k, r.near) for r in picked if r.room_id == room) for room in "ab"}
    assert by_room["a"] == [(1, True), (2, True), (3, False), (4, False), (5, False)]
    assert by_room["b"] == [(1, True), (2, True), (3, True), (4, False), (5, False)]


def test_edits_of_odd_levels(spark):
    rows = [("a", "G . .+G+p\n. .+b"), (None, ". .+#"), ("b", None), ("c", "\n"), ("d", ". .+#\n" * 300), ("e", "+ + +\n+ h +\n+ l+i+O +")]
    found = edits.enumerate_edits(spark.createDataFrame(rows, "room_id string, text string"))
    n = {(r.room_id, r.type): r["count"] for r in found.groupBy("room_id", "type").count().collect()}
    assert (n["a", "move_gem"], n["a", "move_player"], n["a", "move_box"], n["d", "add_wall"]) == (4, 2, 2, 300)
    assert n["e", "hole_to_floor"] == n["e", "toggle_lift"] == 1 and not any(room in "bc" for room, _ in n if room)
    lone = {r.edit_id: r.changes for r in found.where("type = 'move_gem'").collect()}
    assert [c.after for c in lone["a/move_gem/0,0/1,0"]] == [None, ".+G"]
    assert [(c.x, c.y, c.before, c.after) for c in lone["a/move_gem/2,0/0,1"]] == [(2, 0, ".+G+p", ".+p"), (0, 1, ".", ".+G")]
    assert not found.where("edit_id = 'add_wall/0,0/0' AND room_id IS NULL").isEmpty()


def test_only_levels_meet_their_paths(spark):
    levels = spark.createDataFrame([(n, ". . .+G\n. .+p ." * 2) for n in (1, 2)], "room_id int, text string")
    path = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, None, 3)], "room_id int, x int, y int")
    found = edits.enumerate_edits(edits.with_paths(levels, path), ["visited"])
    near = edits.touching(found).select("room_id", "edit_id", "near").collect()
    joined = edits.touching(edits.enumerate_edits(levels), path).select("room_id", "edit_id", "near").collect()
    assert sorted(near, key=str) == sorted(joined, key=str) and {r.near for r in near} == {True, False, None}
    assert all(r.near == ("/0,0/" in r.edit_id or "/1,0/" in r.edit_id or r.edit_id.endswith(("/0,0", "/1,0"))) for r in near if r.room_id == 1)
    # one shuffle by room serves all windows; edits are dropped before it
    plan = edits.try_order(edits.sample_edits(edits.touching(found), 5, 2))._jdf.queryExecution().executedPlan().toString()
    after_edits = plan[: plan.index("MapInArrow")]
    assert after_edits.count("Exchange") == 1 and after_edits.index("Exchange") < after_edits.index("isnan")


def test_sampling_spread_edits(spark):
    """Groups dealt over many batches, with edits without id and of equal draws."""
    rows = [(n % 3 or None, f"e{n // 2}" if n % 97 else None, "add_wall", n % 5 == 0) for n in range(2000)]
    table = spark.createDataFrame(rows, "room_id int, edit_id string, type string, near boolean").repartition(7)
    window = edits.seeded_order(3, "edit_id", ["room_id", "near"], True)
    ranked = table.withColumn("r", F.row_number().over(window)).where(F.col("r") <= F.when(F.col("near"), 4).otherwise(8))
    wanted = sorted((str(r.room_id), str(r.edit_id), r.r + (0 if r.near else 4)) for r in ranked.collect() if r.near or r.r <= 4)
    assert sorted((str(r.room_id), str(r.edit_id), r.k) for r in edits.sample_edits(table, 3, 8).collect()) == wanted


def stop_and_match(tries, p):
    """The same search one try after the other."""
    solved, unsolved, kept = [], [], []
    for t in sorted(tries, key=lambda t: t["try_no"]):
        kept.append(t["try_no"])
        if t["status"] == "solved":
            solved.append(t)
        elif t["status"] == "unsolved":
            unsolved.append(t)
        count = lambda side, kind: sum(x["type"] == kind for x in side)
        if any(count(solved, k) >= p and count(unsolved, k) >= p for k in edits.PRIORITY) and len(solved) + len(unsolved) >= 4 * p:
            break
    made = []
    for kind in (*edits.PRIORITY, None):
        while len(made) < p:
            a = next((x for x in solved if kind in (None, x["type"])), None)
            b = next((x for x in unsolved if kind in (None, x["type"])), None)
            if a is None or b is None:
                break
            solved.remove(a)
            unsolved.remove(b)
            made.append((a["edit_id"], b["edit_id"], a["type"] == b["type"]))
    return kept, made


def test_stop_and_matching(spark):
    rng = random.Random(3)
    rows = []
    for room in range(60):
        for n in range(1, rng.randrange(2, 40)):
            kind = rng.choice(edits.PRIORITY[: rng.randrange(1, 6)])
            rows.append((room, f"{room}/{n}", kind, n, rng.choice(["solved", "unsolved", "unsolved", "capped"]), n))
    schema = "room_id int, edit_id string, type string, try_no int, status string, moves int"
    tries = spark.createDataFrame(rows, schema).withColumn("changes", F.array(F.lit(1)))
    kept = edits.until_enough(tries, 2)
    matched = edits.match_pairs(kept, 2)
    got_kept, got_made = {}, {}
    for r in kept.collect():
        got_kept.setdefault(r.room_id, []).append(r.try_no)
    for r in sorted(matched.collect(), key=lambda r: (r.room_id, r.k)):
        got_made.setdefault(r.room_id, []).append((r.positive.edit_id, r.negative.edit_id, r.same_type))
    names = schema.replace(" int", "").replace(" string", "").split(", ")
    for room in range(60):
        mine = [dict(zip(names, r)) for r in rows if r[0] == room]
        expected_kept, expected_made = stop_and_match(mine, 2)
        assert sorted(got_kept.get(room, [])) == expected_kept
        assert got_made.get(room, []) == expected_made


def test_records_and_audit(spark, level):
    found = edits.enumerate_edits(level).where("type = 'add_wall'").withColumn("moves", F.lit(3))
    tries = edits.try_order(found.withColumn("k", F.row_number().over(edits.seeded_order(1, "edit_id", ["room_id", "type"], True))))
    judged = tries.withColumn("status", F.when(F.col("try_no") % 2 == 0, "solved").otherwise("unsolved"))
    facts = spark.createDataFrame([("r1", "AB", 9, ["ice"], 1)], "room_id string, world string, base_moves int, tags array<string>, gems int")
    records = edits.pair_records(edits.match_pairs(judged, 2), facts, level)
    assert sorted(r.id for r in records.collect()) == ["r1-0-no", "r1-0-yes", "r1-1-no", "r1-1-yes"]
    audit = edits.pair_audit(records)
    assert audit.where(~F.col("ok")).isEmpty() and audit.agg(F.max("differing")).first()[0] == 2
    no_gem = records.withColumn("level", F.regexp_replace("level", r"\.\+G", "."))
    assert edits.pair_audit(no_gem).where("ok").isEmpty()


def test_summary_without_negatives(spark):
    rows = [(True, "yes", 5, None), (True, "no", None, 2), (True, "error", 1, 1), (True, None, None, None)]
    results = spark.createDataFrame(rows, "solvable boolean, answer string, input_tokens bigint, output_tokens bigint")
    s = scoring.summarize(results).first()
    assert (s.n, s.answered, s.correct, s.accuracy, s.hit_rate, s.fa_rate, s.dprime) == (4, 2, 1, 0.5, 0.5, None, None)
    assert (s.errors, s.input_tokens, s.output_tokens) == (1, 6, 3)


def test_missing_parts_are_rejected(spark):
    rows = [("a", "image", "q", ["u"], None, None), ("b", "image", "q", [], "t", None), ("c", "json", "q", None, None, None), ("d", "both", "q", ["u", "v"], "text", None)]
    items = spark.createDataFrame(rows, "id string, representation string, prompt string, images array<string>, ascii string, json string")
    ready, rejected = messages.message_content(items)
    assert {r.id: [b.type for b in r.content] for r in ready.collect()} == {"a": ["image", "text"], "d": ["image", "image", "text"]}
    assert {r.id for r in rejected.collect()} == {"b", "c"}


def test_files(spark, tmp_path):
    (tmp_path / "levels").mkdir()
    (tmp_path / "levels" / "b.txt").write_text(LEVEL)
    (tmp_path / "levels" / "a.txt").write_text(". .\n")
    (tmp_path / "levels" / "notes.md").write_text("no level")
    found = readers.read_levels(spark, str(tmp_path / "levels"))
    assert [(r.room_id, r.text) for r in found.orderBy("file").collect()] == [("a", ". .\n"), ("b", LEVEL)]
    (tmp_path / "map.json").write_text(json.dumps({"levels": {"a.txt": ["A", "C"]}}, indent=1))
    assert [tuple(r) for r in readers.read_world_map(spark, str(tmp_path / "map.json")).collect()] == [("a.txt", "AC")]
    (tmp_path / "broken.jsonl").write_text('{"id": 1}\n\n{"id": \n')
    assert readers.read_jsonl(spark, str(tmp_path / "broken.jsonl"), "id int", "DROPMALFORMED").count() == 1
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "broken.jsonl"), "id int").collect()
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "x.png").write_bytes(b"\x89PNG" + b"0" * 100)
    items = spark.createDataFrame([("i", ["images/x.png", "images/none.png"]), ("j", [])], "id string, paths array<string>")
    shown = {r.id: r.images for r in readers.attach_images(items, str(tmp_path)).collect()}
    assert shown["j"] == [] and len(shown["i"]) == 1 and shown["i"][0].startswith("data:image/png;base64,iVBORz")
    rows = spark.createDataFrame([('say "hi", then\nleave', None)], "a string, b int")
    writers.write_csv(rows, str(tmp_path / "csv"))
    assert [tuple(r) for r in writers.read_csv(spark, str(tmp_path / "csv"), "a string, b int").collect()] == [('say "hi", then\nleave', None)]


def test_edits_meet_their_levels_in_no_broadcast(spark):
    """Levels, paths and facts made of few small rows are never sent whole to every task; odd levels and changes keep their texts."""
    texts = [("a", " . .+p  i\n\n.+é+G\n"), ("b", ""), ("c", None), ("d", "+"), (None, ". .")]
    levels = spark.createDataFrame(texts, "room_id string, text string").cache()
    rows = [
        ("a", "1", [(0, 0, ".", "+"), (0, 1, "x", "öö")]), ("a", "2", [(1, 0, "", "y"), (1, 0, "", "z")]), ("a", "3", [(1, 0, "", "y"), (1, 0, "", None)]),
        ("a", "4", [(3, 0, "", "y"), (-1, 1, "", "y"), (0, 2, "", "y"), None]), ("a", "5", None), ("a", None, [(2, 1, "", "")]), ("a", "6", [(2, 1, "", "q"), (0, 0, "", "p")]),
        ("b", "7", [(0, 0, "", "y")]), ("c", "8", [(0, 0, "", "y")]), ("d", "9", [(0, 0, "", "y")]), (None, "0", []),
    ]
    changed = spark.createDataFrame(rows, "room_id string, edit_id string, changes array<struct<x: int, y: int, before: string, after: string>>")
    plain = ". .+p i\n.+é+G + +\n"
    wanted = {
        "1": "+ .+p i\nöö + +\n", "2": ". z i\n.+é+G + +\n", "3": plain, "4": plain, "5": plain, None: ". .+p i\n.+é+G + \n",
        "6": "p .+p i\n.+é+G + q\n", "7": "\n", "8": None, "9": "y\n",
    }
    joined = edits.apply_edits(levels, changed, ["room_id"])
    carried = edits.apply_edits(None, changed.join(levels, "room_id", "left"), ["room_id"])
    for made in (joined, carried):
        assert {r.edit_id: r.level for r in made.collect()} == wanted
    few = spark.range(3).select(F.col("id").alias("room_id"), F.lit(". .+p\n.+G .").alias("text"))
    facts = few.select("room_id", F.lit("w").alias("world"), F.lit(1).alias("base_moves"), F.array(F.lit("t")).alias("tags"), F.lit(1).alias("gems"))
    found = edits.enumerate_edits(edits.with_paths(few, few.select("room_id", F.lit(0).alias("x"), F.lit(0).alias("y"))), ["visited"])
    tries = edits.try_order(edits.sample_edits(edits.touching(found), 5, 2))
    judged = tries.withColumn("moves", F.lit(1)).withColumn("status", F.when(F.col("try_no") % 2 == 0, "solved").otherwise("unsolved"))
    records = edits.pair_records(edits.match_pairs(judged, 2), facts, few)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (records, found, edits.apply_edits(few, found))]
    assert all("Broadcast" not in plan and "SortMergeJoin" in plan for plan in plans)
    assert edits.pair_audit(records).where("ok").count() == 6


def test_audit_of_repeated_records_compares_the_largest_levels(spark):
    rows = [("p", True, ". .+p .+G\n"), ("p", True, ".+# .+p .+G\n"), ("p", False, ".+# .+p .+G\n"), ("p", None, "i"), ("q", True, None), (None, False, ".+p .+G\n")]
    audit = {r.pair: tuple(r)[1:] for r in edits.pair_audit(spark.createDataFrame(rows, "pair string, solvable boolean, level string")).collect()}
    assert audit == {"p": (4, 2, 0, True, False), "q": (1, 1, audit["q"][2], None, audit["q"][4]), None: (1, 0, audit[None][2], None, audit[None][4])}
