"""Connected groups of linked rows without a row that gathers a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtwin.session import cut_counting

EDGES_AT_ONCE = 200_000


def find_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the pairs: every value that occurs and the smallest value of its group."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        else:
            parent[x] = y
    roots = np.array(parent, np.int64) if parent else np.zeros(0, np.int64)
    while len(roots) and (roots[roots] != roots).any():
        roots = roots[roots]
    return nodes, nodes[roots] if len(nodes) else nodes


def thin(edges: DataFrame, count: int) -> DataFrame:
    """Replace the edges of each chunk by stars to the smallest node: at most one edge a node and chunk stays."""

    def run(batches):
        held_a, held_b, n = [], [], 0

        def star():
            nodes, roots = find_roots(np.concatenate(held_a), np.concatenate(held_b))
            moved = nodes != roots
            return pa.record_batch([pa.array(nodes[moved]), pa.array(roots[moved])], names=["a", "b"])

        for rows in batches:
            held_a.append(rows.column(0).to_numpy())
            held_b.append(rows.column(1).to_numpy())
            n += len(rows)
            if n >= 2 * EDGES_AT_ONCE:
                yield star()
                held_a, held_b, n = [], [], 0
        if n:
            yield star()

    return edges.select("a", "b").coalesce(chunks(count)).mapInArrow(run, "a bigint, b bigint")


def chunks(count: int) -> int:
    return max(1, -(-count // EDGES_AT_ONCE))


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge: the smallest node it is connected to.

    Edges are taken in chunks of bounded size and thinned by union-find. While
    there is more than one chunk, every node then points at its smallest
    neighbour and all its larger neighbours at that one, which joins the stars
    of different chunks, and what is left is thinned again. It is over when all
    edges fit one chunk or every group is a star. Each round is written out; a
    node with very many edges is spread by Spark's skew handling.
    """
    live, count = cut_counting(edges.select("a", "b").where(F.col("a") != F.col("b")), label="links")
    while True:
        alone = chunks(count) == 1
        live, count = cut_counting(thin(live, count), label="links")
        if alone:
            return _labels(live)
        live, count = cut_counting(live.distinct(), label="links")
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("low"))
        upward = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = least.where(F.col("low") < F.col("a")).select("a", F.col("low").alias("b"))
        live, count = cut_counting(upward.unionAll(own).where("a != b").distinct(), label="links")
        tops = live.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("_n"))
        above = tops.select(F.col("a").alias("b"), F.lit(True).alias("_more"))
        stars, unfinished = cut_counting(
            tops.join(above, "b", "left").select("a", "b", (F.col("_more").isNotNull() | (F.col("_n") > 1)).alias("_open")),
            F.col("_open"),
            "stars",
        )
        if not unfinished:
            return _labels(stars)


def _labels(stars: DataFrame) -> DataFrame:
    """Nodes and centres of finished stars."""
    centres = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(centres)
