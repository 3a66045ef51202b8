"""Document quality by nearest-neighbour voting in a latent-semantic space.

A document is a bag of hashed terms: three-byte shapes (which kinds of
characters follow each other), and repetition of words and lines. Terms are
weighted by inverse document frequency over all documents, projected on the
leading singular directions of the labelled sample, and compared with every
labelled vector by cosine in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtwin.llm.arrays import mix, run_hashes, text_blocks, words
from gridtwin.llm.frames import hash_sample

SHAPES = 2048
REPEATS = 64
TERMS = SHAPES + REPEATS
DIRECTIONS = 40
SAMPLE = 1500
NEIGHBOURS = 25
POWER = 6
ACCEPT = 0.3

KINDS = np.full(256, 1, np.uint8)  # 1: lower case and bytes above ASCII
KINDS[0x00:0x20] = 2
KINDS[0x0A] = 3
KINDS[0x20] = 4
KINDS[0x30:0x3A] = 5
KINDS[0x41:0x5B] = 6
_marks = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
KINDS[_marks] = 7 + np.arange(len(_marks))
KIND_COUNT = 7 + len(_marks)
SHAPE_OF = (mix(np.arange(KIND_COUNT**3, dtype=np.uint64)) % np.uint64(SHAPES)).astype(np.int32)


def level(x: np.ndarray, low: float, high: float, levels: int) -> np.ndarray:
    """Which of ``levels`` equal steps between low and high a value falls in."""
    return np.clip((x - low) / (high - low) * levels, 0, levels - 1).astype(np.int64)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[documents, TERMS] counts."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    kinds = KINDS[data].astype(np.int32)  # small numbers: a block has as many as bytes
    out = np.zeros((docs, TERMS), np.float32)
    if len(kinds) > 2:
        shape = SHAPE_OF[(kinds[:-2] * KIND_COUNT + kinds[1:-1]) * KIND_COUNT + kinds[2:]]
        doc = np.repeat(np.arange(docs, dtype=np.int32), size)
        inside = doc[:-2] == doc[2:]
        keys = doc[:-2][inside] * SHAPES + shape[inside]
        out[:, :SHAPES] = np.bincount(keys, minlength=docs * SHAPES).reshape(docs, SHAPES)
    begin, length, first = words(data, offsets)
    if len(begin):
        hashes = run_hashes(data, begin, length)
        doc = np.repeat(np.arange(docs), np.diff(first))
        for gap in (1, 2, 3):  # a word said again after so many words
            again = (hashes[gap:] == hashes[:-gap]) & (doc[gap:] == doc[:-gap])
            out[:, SHAPES + gap] = np.bincount(doc[gap:][again], minlength=docs)
        counts = np.maximum(np.diff(first), 1)
        pairs = np.unique(mix(hashes + mix(doc.astype(np.uint64))), return_index=True)[1]
        fresh = np.bincount(doc[pairs], minlength=docs) / counts
        mean = np.bincount(doc, length, minlength=docs) / counts
        some = np.flatnonzero(np.diff(first))
        weight = np.sqrt(counts)[some]
        out[some, SHAPES + 8 + level(fresh, 0, 1, 12)[some]] = weight
        out[some, SHAPES + 24 + level(mean, 1, 16, 15)[some]] = weight
    return out


def fold(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every term, over all documents."""

    def run(batches):
        seen, n = np.zeros(TERMS + 1, np.int64), 0
        for data, offsets, _, rows in text_blocks(batches):
            seen[:-1] += (term_counts(data, offsets) > 0).sum(axis=0)
            n += len(rows)
        seen[-1] = n
        yield pa.record_batch([pa.array(np.arange(TERMS + 1)), pa.array(seen)], names=["term", "n"])

    totals = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = np.zeros(TERMS + 1)
    for r in totals.collect():  # one row per term
        found[r["term"]] = r["n"]
    return np.log((1 + found[-1]) / (1 + found[:-1])) + 0.3


def directions(matrix: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors [terms, count] by randomised subspace iteration."""
    draw = np.random.default_rng(seed)
    basis = draw.normal(size=(matrix.shape[1], count + 12)).astype(np.float32)
    for _ in range(3):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, vt = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ vt.T)[:, :count].astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The voting model from ``labels`` (doc_id, label 0 or 1) of ``docs``.

    At most about ``sample`` documents of each label vote, chosen by a hash
    of doc_id; a vote counts for as many labelled rows as it stands for.
    Contradictory labels of one doc_id count as their majority, a tie as 1.
    Term statistics cover all documents.
    """
    one = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = hash_sample(one, "doc_id", "label", sample)

    def run(batches):
        for data, offsets, _, rows in text_blocks(batches):
            counts = term_counts(data, offsets).astype(np.float32)
            yield pa.record_batch(
                [rows.column(0), rows.column(2), pa.array([c.tobytes() for c in counts], pa.binary())],
                names=["doc_id", "label", "counts"],
            )

    voters = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by the sample
    rows = voters.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, label int, counts binary")
    rows = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    idf = inverse_frequencies(docs)
    label = np.array([r["label"] for r in rows], np.float32)
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    folded = fold(counts, idf).astype(np.float32)
    axes = directions(folded, min(DIRECTIONS, max(1, len(rows) - 1))) if len(rows) else np.zeros((TERMS, 1), np.float32)
    share = {k: n / max(1.0, float((label == k).sum())) for k, n in sizes.items()}
    stands = np.array([share[int(k)] for k in label], np.float32)
    prior = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.5
    return {"idf": idf, "axes": axes, "voters": unit(folded @ axes), "label": label, "stands": stands, "prior": prior}


def vote(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of label 1 among the nearest voters of each document."""
    at = unit(fold(term_counts(data, offsets), model["idf"]).astype(np.float32) @ model["axes"])
    scores = np.full(len(at), model["prior"])
    k = min(NEIGHBOURS, len(model["voters"]))
    if not k:
        return scores
    for a in range(0, len(at), 256):
        cosine = at[a : a + 256] @ model["voters"].T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER * model["stands"][near]
        total = weight.sum(axis=1)
        some = total > 0
        scores[a : a + 256][some] = (weight * model["label"][near]).sum(axis=1)[some] / total[some]
    return np.clip(scores, 0.0, 1.0)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score, predicted`` of every row; texts without a term (null, under three bytes) get the share of label 1.

    Repeated rows are answered one by one; without any label all scores are 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the terms

    def run(batches):
        for data, offsets, _, rows in text_blocks(batches):
            scores = vote(shared.value, data, offsets)
            yield pa.record_batch(
                [rows.column(0), pa.array(scores, pa.float64()), pa.array((scores >= ACCEPT).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
