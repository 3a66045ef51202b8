"""Session set-up, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Whether Spark removes the shuffle files of a statement as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}


def build_session(app: str = "gridtwin", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs here rely on; ``conf`` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # methods the JVM would not compile are generated in smaller pieces, with shared subexpressions
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (master
    ``local``) a temporary folder of this machine is used; on a cluster a
    missing setting is an error, because executors do not share such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="gridtwin-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier call has returned."""
    return f"{shared_root(spark)}/gridtwin/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage behind it, survives lost executors, and has
    exact file sizes, so join strategies after it are chosen on real numbers.
    Shuffle files that only this write has read are removed after it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal few small rows that cost much each to all cores, four tasks a core; one file of them would be one task.

    Dealt by ``keys``, what is made of a row stays with it: grouping by them needs no shuffle.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def cut_observing(df: DataFrame, label: str = "cut", **aggregates: Column) -> tuple[DataFrame, dict]:
    """Like :func:`cut`, and compute the named aggregates in the same pass."""
    observation = Observation()
    written = cut(df.observe(observation, *[value.alias(name) for name, value in aggregates.items()]), label)
    return written, observation.get


def cut_counting(df: DataFrame, condition: Column | None = None, label: str = "cut") -> tuple[DataFrame, int]:
    """Like :func:`cut`, and count rows (those meeting ``condition``) in the same pass."""
    written, seen = cut_observing(df, label, n=F.count("*") if condition is None else F.count_if(condition))
    return written, int(seen["n"])
