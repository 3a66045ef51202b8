"""A corpus pipeline: quality, language, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtwin.llm import language, packing, quality, superminhash
from gridtwin.llm.frames import numbered
from gridtwin.llm.queries import CAPACITY, tokenizer
from gridtwin.session import cut

ROW = "_row_number"


def good_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents that the votes of all labelled documents call good (score of 0.3 or more), and number the rows."""
    rows = _numbered(docs)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scores = quality.score(_by_row(rows), quality.fit(rows, labels))
    return _accepted(rows, scores.where("predicted = 1"))


def documents_in_a_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents with a recognised language: null, empty and letterless texts go."""
    rows = _numbered(docs)
    found = language.predict(_by_row(rows), *language.fit(rows))
    return _accepted(rows, found.where(F.col("lang_pred") != language.NO_LANGUAGE)).select(docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the first row of every group of near-duplicates (five-word shingles, similarity 0.8), whatever their ids."""
    rows = _numbered(docs)
    return _accepted(rows, superminhash.near_duplicates(_by_row(rows)).where("kept")).select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    rows = _numbered(docs)
    cut_pieces = cut(packing.pieces(_by_row(rows), tokenizer("word_bpe_49k.json"), 0, CAPACITY), "pieces")
    packed = packing.pack(cut_pieces, CAPACITY).drop("part", "part_bound", "total_bound")
    ids = rows.select(F.col(ROW), F.col("doc_id").alias("_id"))
    return packed.withColumnRenamed("doc_id", ROW).join(ids, ROW).select(F.col("_id").alias("doc_id"), *packed.columns[1:])


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row in order of doc_id (nulls last) and text; a row numbered before keeps its number.

    Stages decide by it: ids may be null or repeated, with equal texts or with different ones.
    """
    if ROW in docs.columns:
        return docs
    keys = {"_unnamed": F.col("doc_id").isNull(), "_digest": F.xxhash64("text")}
    return numbered(docs.withColumns(keys), ["_unnamed", "doc_id", "_digest"], ROW).drop(*keys)


def _by_row(rows: DataFrame) -> DataFrame:
    """The texts with the number of their row as doc_id."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def _accepted(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """The numbered rows whose number was accepted as doc_id."""
    return rows.join(accepted.select(F.col("doc_id").alias(ROW)), ROW, "left_semi").select(rows.columns)


STAGES = [
    ("quality", good_documents),
    ("language", documents_in_a_language),
    ("near_duplicates", distinct_documents),
    ("packing", packed_sequences),
]

#: Trained models and tokenizers cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
