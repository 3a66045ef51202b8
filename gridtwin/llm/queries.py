"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtwin.llm import bilinear, flatgraph, language, licences, negatives, packing, quality, roundtrip, sharding, superminhash, vantage, variants, wavelet
from gridtwin.llm.frames import held_out, table
from gridtwin.session import cut, scratch_path

CAPACITY = 2048


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    shards = wavelet.write_shards(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return wavelet.document_digests(shards)


def op2_flat_graph(spark: SparkSession, folder: str) -> DataFrame:
    return flatgraph.near_duplicates(table(spark, folder, "embeddings"), 0.95)


def op3_neighbour_votes(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    known = labels.where(~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").alias("label"))
    scores = quality.score(docs, quality.fit(docs, known))
    return scores.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op4_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, folder, "documents"), size=4)


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    cut_pieces = cut(packing.pieces(table(spark, folder, "documents"), path, 0, CAPACITY), "pieces")
    return packing.pack(cut_pieces, CAPACITY).drop("part")


def op6_vantage_trees(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vantage.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=1.0)


def op7_log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    return bilinear.score(table(spark, folder, "documents").select("doc_id", "text", held_out("doc_id", 7, 2).alias("held_out")))


def op8_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    written = sharding.write_shards(table(spark, folder, "documents"), 40, scratch_path(spark, "shards"))
    return sharding.sized(written).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_forced_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    return roundtrip.round_trip(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json")).drop("exact")


def op10_byte_network(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    params, languages = language.fit(docs.where(~held_out("doc_id", 4, 2)))
    found = language.predict(docs, params, languages)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op11_positional_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def moved_label():
    """The label, moved to the next one where vec_id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op12_residue_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, moved_label())


def op13_count_trie(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_wavelet_shards,
        op2_flat_graph,
        op3_neighbour_votes,
        op4_superminhash,
        op5_best_fit_packing,
        op6_vantage_trees,
        op7_log_bilinear,
        op8_feistel_shards,
        op9_forced_boundaries,
        op10_byte_network,
        op11_positional_licences,
        op12_residue_negatives,
        op13_count_trie,
    )
}
SQL: dict[str, str] = {
    "op12_residue_negatives": """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
}
