"""Versioned catalogue, recorded ids and attached files."""

from threading import Thread

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridtwin.sources import catalogue, readers
from gridtwin.streaming import running, store


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_removed_set_is_gone_and_old_versions_stay(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    assert catalogue.versions(spark, root) == {} and catalogue.read_catalogue(spark, root).count() == 0
    catalogue.upsert_set(spark.range(5), root, "a")
    opened = catalogue.read_catalogue(spark, root)
    assert catalogue.change(spark, root, {"a": spark.range(2).withColumn("x", F.lit("new")), "b": spark.range(7, 9)}) == 2
    assert catalogue.remove_set(spark, root, "b") == 3
    assert ids(opened) == [0, 1, 2, 3, 4]  # a reader keeps the version it opened
    assert ids(catalogue.read_catalogue(spark, root)) == [0, 1]
    assert ids(catalogue.read_catalogue(spark, root, 2)) == [0, 1, 7, 8]
    assert catalogue.read_catalogue(spark, root, 2).where("set_id = 'b' AND x IS NULL").count() == 2
    assert catalogue.read_catalogue(spark, root, sets=("b",)).count() == 0
    assert {r.set_id: r["items"] for r in catalogue.manifest(spark, root, 2).collect()} == {"a": 2, "b": 2}
    assert catalogue.remove_set(spark, root, "none") == 4 and ids(catalogue.read_catalogue(spark, root)) == [0, 1]
    assert len(catalogue.unused_folders(spark, root, 1)) == 2 and catalogue.unused_folders(spark, root, 4) == []


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    writers = [Thread(target=catalogue.upsert_set, args=(spark.range(n + 1), root, f"set {n}")) for n in range(5)]
    for writer in writers:
        writer.start()
    for writer in writers:
        writer.join()
    totals = {r.set_id: r["items"] for r in catalogue.catalogue_totals(catalogue.read_catalogue(spark, root)).collect()}
    assert totals == {**{f"set {n}": n + 1 for n in range(5)}, "all": 15}
    assert list(catalogue.versions(spark, root)) == [1, 2, 3, 4, 5]


def test_unfinished_version_is_not_read(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    catalogue.upsert_set(spark.range(3), root, "a")
    (tmp_path / "catalogue" / "versions" / "0000000002").write_text("half")
    assert ids(catalogue.read_catalogue(spark, root)) == [0, 1, 2]
    with pytest.raises(RuntimeError):
        catalogue.change(spark, root, remove=("a",), tries=2)


def test_recorded_ids_over_restarts_and_repeated_batches(spark, tmp_path):
    path, root, checkpoint = (str(tmp_path / name) for name in ("results", "store", "offsets"))
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("yes").alias("answer"))
    schema = StructType.fromDDL("id string, answer string")

    def record():
        results = running.result_stream(spark, path, schema)
        query = store.record_new(results, root, checkpoint, availableNow=True)
        query.awaitTermination()
        return query

    rows.where("id < 300").unionAll(rows.limit(50)).write.json(path)
    query = record()
    assert not query.lastProgress["stateOperators"]
    more = rows.where("id >= 200").withColumn("answer", F.lit("no"))
    nameless = spark.createDataFrame([(None, "no"), (None, "no")], "id string, answer string")
    more.unionAll(nameless).write.mode("append").json(path)
    record()
    kept = store.recorded(spark, root, schema)
    assert sorted(int(r.id) for r in kept.where("id IS NOT NULL").collect()) == list(range(400))
    assert kept.where("id IS NULL").count() == 2  # rows without an id are all kept
    assert kept.where("id < 300 AND answer = 'no'").isEmpty()  # the first one stays
    # the last batch again, as after a failure
    last = kept.agg(F.max("batch_id")).first()[0]
    store.add_new(more.unionAll(nameless), last, root, "id", ["id", "answer"])
    again = store.recorded(spark, root, schema)
    assert again.count() == 402 and again.where("id IS NOT NULL").select("id").distinct().count() == 400


def test_first_row_of_an_id_within_a_batch(spark, tmp_path):
    schema = "id long, answer string, n long"
    spark.createDataFrame([], schema).withColumns({"batch_id": F.lit(-1), "bucket": F.lit(0)}).write.partitionBy(
        "batch_id", "bucket"
    ).parquet(str(tmp_path / "s"))
    batch = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, None, 1)], schema)
    store.add_new(batch, 0, str(tmp_path / "s"), "id", ["n"])
    store.add_new(batch.limit(0), 1, str(tmp_path / "s"), "id", ["n"])
    found = {r.id: r.answer for r in store.recorded(spark, str(tmp_path / "s"), batch.schema).collect()}
    assert found == {1: "b", 2: None}


def test_only_named_files_are_opened(spark, tmp_path, monkeypatch):
    """An unnamed file over the size limit would fail if it were read."""
    monkeypatch.setattr(readers, "GROUP_FILES", 3)
    folder = tmp_path / "images"
    folder.mkdir()
    names = [f"a {n}+%[x].png" for n in range(8)]
    for name in names:
        (folder / name).write_bytes(name.encode())
    (folder / "large.png").write_bytes(b"x" * 5000)
    items = spark.createDataFrame([(1, names), (2, [names[3], "none.png", names[3]]), (3, []), (4, None)], "id int, paths array<string>")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        shown = {r.id: r.images for r in readers.attach_images(items, str(folder)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    import base64

    uri = lambda name: "data:image/png;base64," + base64.b64encode(name.encode()).decode()
    assert shown == {1: [uri(n) for n in names], 2: [uri(names[3])] * 2, 3: [], 4: []}


def test_texts_of_named_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("not named")
    items = spark.createDataFrame([(1, "a.txt"), (2, "none.txt"), (3, None), (4, "a.txt")], "id int, file string")
    found = {r.id: r.ascii for r in readers.attach_text(items, str(tmp_path), "file", "ascii").collect()}
    assert found == {1: "one\ntwo", 2: None, 3: None, 4: "one\ntwo"}
