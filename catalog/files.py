"""Round trips through files: tables are written to the shared folder, read back and compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog import inputs, sqltext as sql
from catalog.registry import query
from catalog.scoring import rounded
from gridtwin.operators import rooms, sampling, scoring
from gridtwin.session import scratch_path, spread
from gridtwin.sources import catalogue, readers, writers

ITEMS = inputs.PAIRED_ITEMS


def flat_items(spark, sf_dir):
    return inputs.paired_items(spark, sf_dir).select("id", "pair", "set_id", "room", "solvable", "verified", "tags", "images")


@query(
    "json_lines_round_trip",
    f"""SELECT id, pair, solvable, coalesce(array_to_string(tags, '|'), '') AS tags, coalesce(top_image, '') AS top FROM ({ITEMS})""",
)
def json_lines_round_trip(spark, sf_dir):
    path = scratch_path(spark, "items")
    items = flat_items(spark, sf_dir)
    items.write.json(path)
    # a second file of blank lines only, as left by editors
    items.select(F.lit("").alias("value")).write.mode("append").text(path)
    back = readers.read_jsonl(spark, path, items.schema)
    return back.select(
        "id", "pair", "solvable",
        F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"),
        F.coalesce("images.top", F.lit("")).alias("top"),
    )


SUPPLIER_LEVEL = "'  ' || replace(s_name, '#', ' .+#+#') || ' ' || chr(10) || chr(10) || s_nationkey || ' . i' || chr(10)"


def supplier_levels(spark, sf_dir):
    text = F.concat(
        F.lit("  "), F.replace(F.col("s_name"), F.lit("#"), F.lit(" .+#+#")), F.lit(" \n\n"), F.col("s_nationkey"), F.lit(" . i\n")
    )
    return inputs.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", text.alias("text"))


def files_of(texts, key, path):
    """A text file for each ``key``; opening a file costs more than its rows, so keys are dealt to all cores."""
    spread(texts, key).write.partitionBy(key).text(path)


@query(
    "level_folder",
    """SELECT 's' || s_suppkey AS room_id, y::INTEGER AS y, x::INTEGER AS x, cell FROM (SELECT s_suppkey, 0 AS y, 0 AS x, 'Supplier' AS cell FROM supplier
      UNION ALL SELECT s_suppkey, 0, 1, '.+#+#' || split_part(s_name, '#', 2) FROM supplier UNION ALL SELECT s_suppkey, 0, 2, '+' FROM supplier
      UNION ALL SELECT s_suppkey, 1, 0, s_nationkey::VARCHAR FROM supplier UNION ALL SELECT s_suppkey, 1, 1, '.' FROM supplier
      UNION ALL SELECT s_suppkey, 1, 2, 'i' FROM supplier)""",
)
def level_folder(spark, sf_dir):
    """One text file per supplier, listed and read whole."""
    path = scratch_path(spark, "levels")
    levels = supplier_levels(spark, sf_dir).select("text", F.concat(F.lit("s"), "s_suppkey").alias("room"))
    files_of(levels, "room", path)
    back = readers.read_levels(spark, path, r"room=([^/]+)/", recursive=True)
    return rooms.level_cells(back).select("room_id", "y", "x", "cell")


# Blocks of keys as long as a world has rooms (26 by 26), so that no list grows with the table.
def world():
    return F.floor(F.col("s_suppkey") / 676).alias("block")


@query(
    "world_map_slots",
    """SELECT 'level_' || s_suppkey || '.txt' AS file, chr((65 + s_suppkey % 26)::INTEGER) || chr((65 + s_nationkey)::INTEGER) AS slot FROM supplier""",
)
def world_map_slots(spark, sf_dir):
    """A map per nation and block of as many rooms as a world can hold."""
    letter = lambda n: F.char(F.lit(65) + n)
    entry = F.struct(
        F.concat(F.lit("level_"), "s_suppkey", F.lit(".txt")),
        F.array(letter(F.col("s_suppkey") % 26), letter(F.col("s_nationkey"))),
    )
    path = scratch_path(spark, "maps")
    suppliers = inputs.table(spark, sf_dir, "supplier")
    suppliers.groupBy("s_nationkey", world()).agg(
        F.map_from_entries(F.collect_list(entry)).alias("levels")
    ).select("levels").write.json(path)
    return readers.read_world_map(spark, path, multi_line=False)


VERSION = "build-world-v1"
LEVEL_NAME = "CASE WHEN s_suppkey % 7 = 0 THEN 'draft_' || s_suppkey ELSE 'level_' || chr((65 + s_suppkey % 26)::INTEGER) || 'x' || chr((65 + s_nationkey)::INTEGER) END"


def exports(spark, sf_dir):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    name = F.when(key % 7 == 0, F.concat(F.lit("draft_"), key)).otherwise(
        F.concat(F.lit("level_"), F.char(65 + key % 26), F.lit("x"), F.char(65 + nation))
    )
    cells = F.array(
        F.array(F.lit(" . "), F.lit(""), key.cast("string")), F.array(F.lit(None).cast("string"), F.lit(".+#"), F.lit("i"))
    )
    level = F.struct(name.alias("id"), cells.alias("cells"))
    worlds = inputs.table(spark, sf_dir, "supplier").groupBy("s_nationkey", world()).agg(
        F.collect_list(level).alias("levels")
    )
    path = scratch_path(spark, "exports")
    worlds.select(
        F.when(nation % 5 == 0, "other-v2").when(nation % 5 != 1, VERSION).alias("version"),
        F.concat(F.lit("nation "), nation).alias("title"),
        F.when(nation % 2 == 0, F.struct((nation + 1).alias("width"), F.lit(0).alias("height"))).alias("world"),
        "levels",
    ).write.json(path)
    return readers.read_world_export(spark, path, VERSION, multi_line=False)


@query(
    "imported_levels",
    f"""SELECT 'nation ' || s_nationkey AS title, {LEVEL_NAME} AS room_id, chr((65 + s_suppkey % 26)::INTEGER) || chr((65 + s_nationkey)::INTEGER) AS slot,
    '. + ' || s_suppkey || chr(10) || '+ .+# i' || chr(10) AS text FROM supplier WHERE s_nationkey % 5 <> 0 AND s_suppkey % 7 <> 0""",
)
def imported_levels(spark, sf_dir):
    return exports(spark, sf_dir)["levels"]


@query(
    "imported_worlds",
    """SELECT 'nation ' || s_nationkey AS title, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey + 1 ELSE 16 END::INTEGER AS width, 16 AS height,
    count(*) FILTER (s_suppkey % 7 <> 0)::INTEGER AS rooms FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY s_nationkey, s_suppkey // 676""",
)
def imported_worlds(spark, sf_dir):
    return exports(spark, sf_dir)["worlds"]


@query(
    "rejected_worlds",
    "SELECT 'nation ' || s_nationkey AS title, 'other-v2' AS version FROM supplier WHERE s_nationkey % 5 = 0 GROUP BY s_nationkey, s_suppkey // 676",
)
def rejected_worlds(spark, sf_dir):
    return exports(spark, sf_dir)["rejected"]


@query(
    "wrapped_json",
    "SELECT 'nation ' || s_nationkey AS label, count(*)::INTEGER AS items, min(s_name) AS first FROM supplier GROUP BY s_nationkey, s_suppkey // 676",
)
def wrapped_json(spark, sf_dir):
    """Script files that assign a JSON object, one per nation and block."""
    path = scratch_path(spark, "scripts")
    suppliers = inputs.table(spark, sf_dir, "supplier").groupBy("s_nationkey", world()).agg(
        F.sort_array(F.collect_list("s_name")).alias("items")
    )
    body = F.to_json(F.struct(F.concat(F.lit("nation "), "s_nationkey").alias("label"), "items"))
    script = F.concat(F.lit("// made by an exporter\nwindow.STIMULI = "), body, F.lit(";\n"))
    suppliers.select(script.alias("value"), "s_nationkey", "block").write.partitionBy("s_nationkey", "block").text(path)
    read = readers.read_wrapped_json(spark, path, r"window\.STIMULI", "label string, items array<string>")
    return read.select("label", F.size("items").alias("items"), F.col("items")[0].alias("first"))


def sidecar_items(spark, sf_dir, path):
    """Items that name the file of their supplier and one that does not exist."""
    texts = supplier_levels(spark, sf_dir).select(F.concat("text", F.lit("end")).alias("value"), F.col("s_suppkey").alias("key"))
    files_of(texts, "key", path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    named = files.select(
        F.regexp_extract("path", r"key=([0-9]+)/", 1).cast("bigint").alias("id"),
        F.regexp_extract("path", r"(key=[0-9]+/[^/]+)$", 1).alias("file"),
    )
    return named


@query(
    "attached_images",
    f"""SELECT s_suppkey AS id, 1 AS images, 'data:text/plain;base64,' || to_base64(encode({SUPPLIER_LEVEL} || 'end' || chr(10))) AS first FROM supplier""",
)
def attached_images(spark, sf_dir):
    """Files as data URIs; a missing second file drops out."""
    path = scratch_path(spark, "sidecars")
    items = sidecar_items(spark, sf_dir, path).select("id", F.array("file", F.lit("key=none/a.txt")).alias("paths"))
    shown = readers.attach_images(items, path, "paths", "text/plain", "*.txt")
    return shown.select("id", F.size("images").alias("images"), F.col("images")[0].alias("first"))


@query(
    "attached_texts",
    f"""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN {SUPPLIER_LEVEL} || 'end' || chr(10) END AS ascii FROM supplier""",
)
def attached_texts(spark, sf_dir):
    path = scratch_path(spark, "sidecars")
    items = sidecar_items(spark, sf_dir, path).withColumn("file", F.when(F.col("id") % 3 != 0, F.col("file")))
    return readers.attach_text(items, path, "file", "ascii").select("id", "ascii")


# --- a saved corpus ------------------------------------------------------------------------
PLAN = f"""SELECT id AS source_id, solvable, pair, CASE WHEN pair % 10 < 8 THEN 'train' WHEN pair % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM ({ITEMS})"""


def saved_corpus(spark, sf_dir):
    digit = F.col("pair") % 10
    records = inputs.paired_items(spark, sf_dir).select(
        sampling.item_id(F.col("id")).alias("id"),
        F.col("id").alias("seed"),
        "solvable",
        "pair",
        F.when(digit < 8, "train").when(digit == 8, "val").otherwise("test").alias("split"),
    )
    root = scratch_path(spark, "corpus")
    writers.write_records(records, root)
    counts = records.agg(F.count("*").alias("n"), F.count_if(F.col("solvable")).alias("solvable"))
    writers.write_config(counts, root, base_seed=F.lit(0), pairs=F.lit(True))
    return root, records


RECORD = "id string, seed bigint, solvable boolean, pair bigint"


@query("saved_records", f"SELECT printf('%06d', source_id) AS id, source_id AS seed, solvable, pair, split FROM ({PLAN})")
def saved_records(spark, sf_dir):
    return readers.read_dataset(spark, saved_corpus(spark, sf_dir)[0], RECORD)


@query(
    "saved_records_of_split",
    f"SELECT printf('%06d', source_id) AS id, source_id AS seed, solvable, pair, split FROM ({PLAN}) WHERE split = 'val'",
)
def saved_records_of_split(spark, sf_dir):
    """Only the folder of the split is read."""
    return readers.read_dataset(spark, saved_corpus(spark, sf_dir)[0], RECORD, "val")


@query(
    "saved_config",
    f"SELECT count(*) AS n, count(*) FILTER (solvable) AS solvable, 0 AS base_seed, true AS pairs FROM ({PLAN})",
)
def saved_config(spark, sf_dir):
    root, _ = saved_corpus(spark, sf_dir)
    return readers.read_config(spark, root, "n bigint, solvable bigint, base_seed int, pairs boolean")


@query(
    "labels_csv",
    f"""SELECT printf('%06d', id) AS id, solvable::INTEGER AS solvable, set_id, CASE WHEN p_size % 5 <> 0 THEN p_size END AS solution_length,
    round(p_size / 7.0::DOUBLE, 4) AS pocket_frac FROM ({ITEMS})""",
)
def labels_csv(spark, sf_dir):
    path = scratch_path(spark, "labels")
    part = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    items = inputs.paired_items(spark, sf_dir).join(part, "id")
    labels = items.select(
        sampling.item_id(F.col("id")).alias("id"),
        F.col("solvable").cast("int").alias("solvable"),
        "set_id",
        F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("solution_length"),
        F.round(F.col("p_size") / 7, 4).alias("pocket_frac"),
    )
    writers.write_labels(labels, path)
    return writers.read_csv(spark, path, "id string, solvable int, set_id string, solution_length int, pocket_frac double")


@query(
    "quoted_csv",
    """SELECT doc_id, '"' || lang || '", ' || text AS quoted, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source FROM documents""",
)
def quoted_csv(spark, sf_dir):
    """Whole documents with quotes, commas and line breaks survive."""
    path = scratch_path(spark, "quoted")
    documents = inputs.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit('"'), "lang", F.lit('", '), "text").alias("quoted"),
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"),
    )
    writers.write_csv(documents, path)
    return writers.read_csv(spark, path, "doc_id bigint, quoted string, source string")


@query(
    "appended_results",
    f"SELECT event_id AS id, answer, solvable FROM ({inputs.TRIAL_RESULTS})",
)
def appended_results(spark, sf_dir):
    """Two runs append to the same place."""
    path = scratch_path(spark, "results")
    rows = inputs.trial_results(spark, sf_dir).select(F.col("event_id").alias("id"), "answer", "solvable")
    writers.append_results(rows.where(F.col("id") % 2 == 0), path)
    writers.append_results(rows.where(F.col("id") % 2 == 1), path)
    return readers.read_jsonl(spark, path, rows.schema)


@query(
    "saved_report",
    f"""SELECT 'batch' AS model, s.n, s.answered, s.dprime, t.trials FROM ({sql.summary(inputs.TRIAL_RESULTS)}) s,
    (SELECT count(*) AS trials FROM events) t""",
)
def saved_report(spark, sf_dir):
    """Settings and summary in one object, trials beside it."""
    path = scratch_path(spark, "report")
    results = inputs.trial_results(spark, sf_dir)
    writers.write_report(results, rounded(scoring.summarize(results)), path, model=F.lit("batch"), effort=F.lit(None).cast("string"))
    report = spark.read.schema("settings struct<model: string>, summary struct<n: bigint, answered: bigint, dprime: double>").json(f"{path}/report")
    trials = spark.read.schema(results.schema).json(f"{path}/trials").count()
    return report.select("settings.model", "summary.*", F.lit(trials).cast("bigint").alias("trials"))


def changed_catalogue(spark, sf_dir):
    """Two sets are written, a third with one of them replaced, the third is removed."""
    root = scratch_path(spark, "catalogue")
    items = flat_items(spark, sf_dir).drop("set_id")
    catalogue.upsert_set(items, root, "first")
    catalogue.upsert_set(items, root, "second")
    catalogue.change(spark, root, {"third": items.where(~F.col("solvable")), "first": items.where("solvable")})
    catalogue.remove_set(spark, root, "third")
    return root


@query(
    "catalogue_totals",
    f"""SELECT coalesce(set_id, 'all') AS set_id, count(*) AS items FROM (
      SELECT 'first' AS set_id FROM ({ITEMS}) WHERE solvable UNION ALL SELECT 'second' FROM ({ITEMS})) GROUP BY ROLLUP (set_id)""",
)
def catalogue_totals(spark, sf_dir):
    """A fresh read of the newest version."""
    return catalogue.catalogue_totals(catalogue.read_catalogue(spark, changed_catalogue(spark, sf_dir)))


@query(
    "catalogue_versions",
    f"""SELECT v.version, s.set_id, count(*) AS items FROM ({ITEMS}) i, (SELECT unnest([1, 2, 3, 4]) AS version) v,
      (SELECT unnest(['first', 'second', 'third']) AS set_id) s
    WHERE CASE s.set_id WHEN 'first' THEN v.version < 3 OR i.solvable WHEN 'second' THEN v.version >= 2
      ELSE v.version = 3 AND NOT i.solvable END GROUP BY v.version, s.set_id""",
)
def catalogue_versions(spark, sf_dir):
    """Items of each set in every version, counted in its rows."""
    root = changed_catalogue(spark, sf_dir)
    counted = [
        catalogue.read_catalogue(spark, root, version).groupBy("set_id").agg(F.count("*").alias("items")).select(
            F.lit(version).alias("version"), "set_id", "items"
        )
        for version in catalogue.versions(spark, root)
    ]
    return reduce(lambda a, b: a.unionAll(b), counted)


@query("catalogue_items", f"""SELECT id, pair, solvable, 'first' AS set_id FROM ({ITEMS}) WHERE solvable""")
def catalogue_items(spark, sf_dir):
    """One set of the newest version: only its folder is read."""
    rows = catalogue.read_catalogue(spark, changed_catalogue(spark, sf_dir), sets=("first", "third"))
    return rows.select("id", "pair", "solvable", "set_id")
