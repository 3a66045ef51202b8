"""Readers: JSON lines, level folders, world files, wrapped JSON, binary and sidecar files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridtwin import schemas
from gridtwin.functions import cells as C
from gridtwin.functions.text import strip
from gridtwin.session import cut_counting, scratch_path

# Which level ids an export may use, and the size of a world that names none.
LEVEL_ID = r"^level_([A-Z])x([A-Z])$"
WORLD_SIDE = 16

GROUP_FILES = 10_000  # attached files that one job reads, whose paths the driver names


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, broken ones are an error.

    ``mode="DROPMALFORMED"`` skips broken lines, as resuming does.
    """
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_levels(spark: SparkSession, folder: str, id_pattern: str = r"([^/]+)\.txt$", recursive: bool = False) -> DataFrame:
    """Level text files as ``room_id, file, text``; the id is the file name without ending.

    ``id_pattern`` takes it from another part of the path.
    """
    reader = spark.read.option("pathGlobFilter", "*.txt")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    files = reader.text(folder, wholetext=True).select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("file"),
    )
    return files.select(F.regexp_extract("_path", id_pattern, 1).alias("room_id"), "file", "text")


def read_world_map(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """World maps as ``file, slot``: the slot is the level's coordinates joined."""
    maps = spark.read.schema(schemas.WORLD_MAP).option("multiLine", multi_line).json(path)
    return maps.select(F.explode("levels").alias("file", "_at")).select("file", F.array_join("_at", "").alias("slot"))


def read_world_export(spark: SparkSession, path: str, version: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """World exports of the accepted ``version`` (or none named).

    Tables: ``worlds`` (title, size, rooms), ``levels`` (title, room_id, slot,
    text) and ``rejected`` (exports of another version). Levels whose id or
    cells are not usable are left out and not counted.
    """
    raw = spark.read.schema(schemas.WORLD_EXPORT).option("multiLine", multi_line).json(path)
    known = F.coalesce(F.col("version"), F.lit("")).isin("", version)
    written = lambda cell: F.when(strip(F.coalesce(cell, F.lit(""))) == "", F.lit(C.LAYER)).otherwise(strip(cell))
    usable = F.filter(
        F.coalesce("levels", F.array().cast(raw.schema["levels"].dataType)),
        lambda level: F.coalesce(level["id"].rlike(LEVEL_ID), F.lit(False)) & level["cells"].isNotNull(),
    )
    accepted = raw.where(known).withColumn("_usable", usable)
    side = lambda key: F.coalesce(F.nullif(F.col(f"world.{key}"), F.lit(0)), F.lit(WORLD_SIDE)).alias(key)
    level = F.col("_level")
    return {
        "worlds": accepted.select("title", side("width"), side("height"), F.size("_usable").alias("rooms")),
        "levels": accepted.select("title", F.explode("_usable").alias("_level")).select(
            "title",
            level["id"].alias("room_id"),
            F.concat(F.regexp_extract(level["id"], LEVEL_ID, 1), F.regexp_extract(level["id"], LEVEL_ID, 2)).alias("slot"),
            C.grid_text(F.transform(level["cells"], lambda row: F.transform(row, written))).alias("text"),
        ),
        "rejected": raw.where(~known).select("title", "version"),
    }


def read_wrapped_json(spark: SparkSession, path: str, variable: str, schema: str | StructType) -> DataFrame:
    """JSON assigned to ``variable`` in script files (``variable = {...};`` at the end)."""
    pattern = rf"(?s){variable}\s*=\s*(\{{.*\}});?\s*\z"
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", pattern, 1)
    return text.select(body.alias("_body")).where(F.col("_body") != "").select(
        F.from_json("_body", schema, {"mode": "FAILFAST"}).alias("_json")
    ).select("_json.*")


def _below(path: Column, root: str) -> Column:
    """Path relative to ``root``, whatever scheme either is written with."""
    bare = root.split("://", 1)[-1].removeprefix("file:").strip("/")
    return F.element_at(F.split(path, F.lit(f"\\Q/{bare}/\\E"), 2), -1)


def _wanted_contents(files: DataFrame, wanted: DataFrame, root: str, value: Column) -> DataFrame:
    """``_file, _value`` of those ``files`` below ``root`` that ``wanted(_file)`` names; no other file is opened.

    A first pass only lists. The wanted files are then dealt into groups of about
    ``GROUP_FILES``, and each group is read by a job of its own whose scan is
    pruned to its paths, so the driver holds the paths of one group at a time.
    """
    spark = files.sparkSession
    path = F.col("_metadata.file_path")
    listed = files.select(path.alias("_path"), _below(path, root).alias("_file"))
    # names are compared as they are written, the file system's escapes undone
    listed = listed.withColumn("_file", F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B"))))
    found, n = cut_counting(listed.join(wanted, "_file", "left_semi"), label="wanted")
    groups = -(-n // GROUP_FILES)
    out = scratch_path(spark, "contents")
    for number in range(groups):
        mine = found.where(F.pmod(F.xxhash64("_path"), F.lit(groups)) == number)
        paths = [row["_path"] for row in mine.select("_path").collect()]
        read = files.where(path.isin(*paths, "")).select(path.alias("_path"), value.alias("_value"))
        read.join(mine, "_path").select("_file", "_value").write.mode("append").parquet(out)
    schema = "_file string, _value string"
    return spark.read.schema(schema).parquet(out) if groups else spark.createDataFrame([], schema)


def attach_images(items: DataFrame, root: str, paths: str = "paths", mime: str = "image/png", pattern: str = "*.png") -> DataFrame:
    """Add ``images``: the files of the array ``paths`` (relative to ``root``) as data URIs, in order.

    Missing files drop out. ``id`` identifies an item. Only files that items name are read.
    """
    spark = items.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    named = items.select("id", F.posexplode(paths).alias("_at", "_file"))
    uri = F.concat(F.lit(f"data:{mime};base64,"), F.base64("content"))
    contents = _wanted_contents(files, named.select("_file").distinct(), root, uri)
    found = named.join(contents, "_file").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_value")))["_value"].alias("images")
    )
    return items.join(found, "id", "left").withColumn(
        "images", F.coalesce("images", F.array().cast("array<string>"))
    )


def attach_text(items: DataFrame, root: str, column: str, name: str, pattern: str = "*.txt") -> DataFrame:
    """Add ``name``: the whole text of the file in ``column``; null where it names none or it is missing.

    Of the files matching ``pattern`` only those that items name are read.
    """
    reader = items.sparkSession.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = reader.text(root, wholetext=True)
    wanted = items.where(F.col(column).isNotNull()).select(F.col(column).alias("_file")).distinct()
    contents = _wanted_contents(files, wanted, root, F.col("value"))
    return items.join(contents.select(F.col("_file").alias(column), F.col("_value").alias(name)), column, "left")


def read_dataset(spark: SparkSession, root: str, schema: str, split: str | None = None) -> DataFrame:
    """Records of a saved corpus (``records/split=.../``); one split only reads its folder."""
    rows = spark.read.schema(f"{schema}, split string").option("mode", "FAILFAST").json(f"{root}/records")
    return rows.where(F.col("split") == split) if split else rows


def read_config(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{root}/config")


def read_mazes(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """The whole maze objects of a saved corpus, or of one split."""
    return read_dataset(spark, root, schemas.MAZE, split)
