"""A catalogue of named sets in versions: every change is a new version, and readers keep the one they opened.

Below the root, ``sets/`` holds the rows of each set as it was written,
``manifests/`` one table per version (set, folder, number of items), and
``versions/`` one small file per version that names its manifest. A version
counts from the moment that file is there, which only one writer can create;
one that comes second builds its change again on the newer version. Nothing is
overwritten, so a failed or repeated write leaves at most unused folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "set_id string, folder string, items bigint"
NAME_LENGTH = 32  # of a manifest; a version file that is shorter is still being written


def _files(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; false if it is there already."""
    place, files = _files(spark, path)
    try:
        out = files.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text, "ascii"))
    out.close()
    return True


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """The finished versions and the names of their manifests, oldest first."""
    place, files = _files(spark, f"{root}/versions")
    if not files.exists(place):
        return {}
    named = {}
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if name.isdigit() and status.getLen() >= NAME_LENGTH:
            stream = files.open(status.getPath())
            named[int(name)] = bytes(stream.readNBytes(NAME_LENGTH)).decode("ascii")
            stream.close()
    return dict(sorted(named.items()))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """``set_id, folder, items`` of a version, by default the newest; no rows for a catalogue without one."""
    known = versions(spark, root)
    if version is None and not known:
        return spark.createDataFrame([], MANIFEST)
    name = known[max(known) if version is None else version]
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{name}")


def change(
    spark: SparkSession, root: str, put: Mapping[str, DataFrame] | None = None, remove: tuple[str, ...] = (), tries: int = 20
) -> int:
    """Write the sets of ``put`` and take out those of ``remove`` in one new version, whose number is returned.

    A set that is put again is replaced whole. To remove one that is not
    there changes nothing in the sets. Items need not have a column ``set_id``; one they have is replaced.
    """
    put = dict(put or {})
    added = []
    for set_id, items in put.items():
        folder, counted = f"sets/{uuid.uuid4().hex}", Observation()
        rows = items.withColumn("set_id", F.lit(set_id)).observe(counted, F.count("*").alias("n"))
        rows.write.parquet(f"{root}/{folder}")
        added.append((set_id, folder, int(counted.get["n"])))
    for _ in range(tries):
        known = versions(spark, root)
        latest = max(known, default=0)
        stay = manifest(spark, root, latest or None).where(~F.col("set_id").isin(*put, *remove, ""))
        name = uuid.uuid4().hex
        stay.unionAll(spark.createDataFrame(added, MANIFEST)).coalesce(1).write.parquet(f"{root}/manifests/{name}")
        if _claim(spark, f"{root}/versions/{latest + 1:010d}", name):
            return latest + 1
    raise RuntimeError(f"other writers were first {tries} times")


def upsert_set(items: DataFrame, root: str, set_id: str) -> int:
    """Write one set, replacing it if it is there; other sets are not touched."""
    return change(items.sparkSession, root, {set_id: items})


def remove_set(spark: SparkSession, root: str, set_id: str) -> int:
    """A version without the set."""
    return change(spark, root, remove=(set_id,))


def read_catalogue(
    spark: SparkSession, root: str, version: int | None = None, sets: tuple[str, ...] | None = None
) -> DataFrame:
    """Items of all sets (or of those named) of a version, by default the newest, with ``set_id``.

    Only the folders of these sets are read. Columns that a set lacks are
    null. Without any set the table has no rows and the column ``set_id`` alone.
    """
    listed = manifest(spark, root, version)
    if sets is not None:
        listed = listed.where(F.col("set_id").isin(*sets, ""))
    folders = [f"{root}/{row['folder']}" for row in listed.select("folder").collect()]  # one row a set
    if not folders:
        return spark.createDataFrame([], "set_id string")
    return spark.read.option("mergeSchema", True).parquet(*folders)


def catalogue_totals(catalogue: DataFrame) -> DataFrame:
    """Items per set, and of all sets under the name ``all``."""
    return (
        catalogue.rollup("set_id").agg(F.count("*").alias("items")).withColumn("set_id", F.coalesce("set_id", F.lit("all")))
    )


def unused_folders(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Folders below ``sets`` that none of the ``keep`` newest versions names.

    They belong to older versions, to failed writes, or to writes still going on: delete
    those that are older than any write and any reader.
    """
    named: set[str] = set()
    for version in list(versions(spark, root))[-keep:]:
        named |= {row["folder"] for row in manifest(spark, root, version).select("folder").collect()}
    place, files = _files(spark, f"{root}/sets")
    if not files.exists(place):
        return []
    return sorted({f"sets/{status.getPath().getName()}" for status in files.listStatus(place)} - named)
