"""Writers: labels, records, run configuration, appended results and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def write_labels(labels: DataFrame, path: str) -> None:
    """Label table as CSV with a header."""
    write_csv(labels, path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header: quotes around values with comma, quote or line break, doubled quotes, null as nothing."""
    (
        rows.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read what :func:`write_csv` wrote; nothing comes back as null."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_records(records: DataFrame, root: str) -> None:
    """Full objects as JSON lines, one folder per split; fields without a value are written as null."""
    records.write.partitionBy("split").option("ignoreNullFields", False).json(f"{root}/records")


def write_config(counts: DataFrame, root: str, **settings: Column) -> None:
    """One JSON object: counts (a single row) and settings."""
    config = counts.select("*", *[value.alias(name) for name, value in settings.items()])
    config.coalesce(1).write.option("ignoreNullFields", False).json(f"{root}/config")


def append_results(results: DataFrame, path: str) -> None:
    """Add trial results as JSON lines."""
    results.write.mode("append").json(path)


def write_report(results: DataFrame, summary: DataFrame, path: str, **settings: Column) -> None:
    """Settings with the summary as one JSON object, and the trials beside it as JSON lines.

    The trials stay in as many files as there are tasks; they are not nested
    into the one object.
    """
    head = F.struct(*[value.alias(name) for name, value in settings.items()])
    body = F.struct(*[F.col(c) for c in summary.columns])
    summary.select(head.alias("settings"), body.alias("summary")).coalesce(1).write.json(f"{path}/report")
    results.write.json(f"{path}/trials")
