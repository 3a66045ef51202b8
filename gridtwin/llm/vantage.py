"""Nearest neighbours by vantage-point trees, one per shard.

Largest inner products become smallest distances with one more dimension:
with all vectors divided by the largest norm and queries by their own, x gets sqrt(1 - |x|**2) and a query 0, so
distance**2 = 2 - 2 q.x. In a tree each node keeps how near and how far
the members of both halves are from its vantage point; a half is skipped
for a query when ``factor`` times the triangle inequality's lower bound
exceeds the distance of the worst neighbour kept. Factor one is exact, larger
factors skip more.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtwin.llm.arrays import ragged
from gridtwin.llm.vectors import as_bytes, common_width, length, matrix, unit
from gridtwin.session import cut

SHARD_ROWS = 16_384
QUERY_BLOCK = 1_024
LEAF = 64
SLACK = 1e-11  # rounding of products of unit length
FAR = 1e-7  # and of distances, whose squares are rounded


def build(ids: np.ndarray, x: np.ndarray, top: float, keep: int) -> dict:
    """A tree over the distinct vectors; of equal vectors the ``keep`` smallest ids are kept, in order."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, first, inverse = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    by_class = np.argsort(inverse, kind="stable")
    size = np.bincount(inverse)
    begin = np.cumsum(size) - size
    kept = np.minimum(size, keep)
    points = x[first]
    scaled = points / top
    lifted = np.column_stack([scaled, np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0.0))])
    place = np.arange(len(points))
    nodes: list[tuple] = []  # (low, high, children, spans) ; the vantage point of an inner node is at ``low``

    def split(low: int, high: int) -> int:
        number = len(nodes)
        nodes.append((low, high, None, None))
        if high - low <= LEAF:
            return number
        members = place[low:high]
        # the member farthest from the middle sees the others at the most varied distances
        middle = lifted[members].mean(axis=0)
        pick = int(np.argmax(((lifted[members] - middle) ** 2).sum(axis=1)))
        place[low], place[low + pick] = place[low + pick], place[low]
        rest = place[low + 1 : high]
        away = np.sqrt(((lifted[rest] - lifted[place[low]]) ** 2).sum(axis=1))
        half = len(rest) // 2
        order = np.argpartition(away, half)
        place[low + 1 : high], away = rest[order], away[order]
        spans = (away[:half].min(), away[:half].max(), away[half:].min(), away[half:].max())
        children = (split(low + 1, low + 1 + half), split(low + 1 + half, high))
        nodes[number] = (low, high, children, spans)
        return number

    split(0, len(points))
    kept, begin = kept[place], begin[place]
    same = ids[by_class[ragged(begin, kept)]]
    return {"nodes": nodes, "points": points[place], "same": same, "kept": kept, "top": top}


class Search:
    """The k best rows so far for a block of queries, carried from tree to tree.

    Rows are compared by their exact products (summed in order of the
    components) and then by id. A rounded product, or a distance made of one, only decides
    what is compared: whatever lies within the rounding of the k-th is.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.own, self.q, self.k, self.factor = ids, queries, k, factor
        self.unit = unit(queries)
        self.size = length(queries)
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), -1, np.int64)
        self.bar = np.full(len(queries), -np.inf)  # the k-th product, for unit lengths
        self.near = np.full(len(queries), np.inf)  # and the distance it stands for

    def offer(self, tree: dict, rows: np.ndarray, products: np.ndarray, low: int) -> None:
        i, j = np.nonzero(products >= self.bar[rows, None] - SLACK)
        if not len(i):
            return
        rows, j = rows[i], low + j
        exact = np.cumsum(self.q[rows] * tree["points"][j], axis=1)[:, -1]
        kept = tree["kept"][j]
        rows, exact = np.repeat(rows, kept), np.repeat(exact, kept)
        ids = tree["same"][ragged(tree["first"][j], kept)]
        other = ids != self.own[rows]
        rows, exact, ids = rows[other], exact[other], ids[other]
        touched, number = np.unique(rows, return_inverse=True)
        number = np.concatenate([np.repeat(np.arange(len(touched)), self.k), number])
        exact = np.concatenate([self.score[touched].ravel(), exact])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -exact, number))
        place = np.searchsorted(number[order], np.arange(len(touched)))[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = exact[order][place], ids[order][place]
        last = self.score[touched, -1]
        full = np.isfinite(last)
        touched = touched[full]
        self.bar[touched] = last[full] / self.size[touched] / tree["top"]
        self.near[touched] = np.sqrt(np.maximum(2 - 2 * self.bar[touched], 0.0))

    def tree(self, tree: dict) -> None:
        tree = {**tree, "scaled": tree["points"] / tree["top"], "first": np.cumsum(tree["kept"]) - tree["kept"]}
        nodes = tree["nodes"]
        seen = np.zeros((len(self.q), len(nodes)), bool)

        def products(rows: np.ndarray, low: int, high: int) -> np.ndarray:
            return self.unit[rows] @ tree["scaled"][low:high].T

        def leaf(number: int, rows: np.ndarray) -> None:
            rows = rows[~seen[rows, number]]
            if len(rows):
                seen[rows, number] = True
                low, high = nodes[number][:2]
                self.offer(tree, rows, products(rows, low, high), low)

        def descend(number: int, rows: np.ndarray) -> None:
            """Only towards the nearer half: gives every query good first neighbours."""
            low, _, children, spans = nodes[number]
            if children is None:
                leaf(number, rows)
            else:
                away = np.sqrt(np.maximum(2 - 2 * products(rows, low, low + 1)[:, 0], 0.0))
                inside = away < (spans[1] + spans[2]) / 2
                for child, own in zip(children, (rows[inside], rows[~inside])):
                    if len(own):
                        descend(child, own)

        def visit(number: int, rows: np.ndarray) -> None:
            low, _, children, spans = nodes[number]
            if children is None:
                leaf(number, rows)
                return
            found = products(rows, low, low + 1)
            self.offer(tree, rows, found, low)
            away = np.sqrt(np.maximum(2 - 2 * found[:, 0], 0.0))
            for child, least, most in ((children[0], *spans[:2]), (children[1], *spans[2:])):
                bound = np.maximum(np.maximum(away - most, least - away), 0.0) * self.factor
                own = rows[bound <= self.near[rows] + FAR]
                if len(own):
                    visit(child, own)

        everyone = np.arange(len(self.q))
        descend(0, everyone)
        visit(0, everyone)

    def results(self, row: int) -> list[tuple[int, float]]:
        """The k best (vec_id, inner product)."""
        kept = self.id[row] >= 0
        return list(zip(self.id[row][kept].tolist(), self.score[row][kept].tolist()))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``vectors`` with the largest inner product for each query.

    Ties go to the smaller vec_id; a query's own id is not among its
    neighbours. Null, empty, zero and non-finite vectors, and those of another
    length than most, take no part and get no rows. Rows that repeat a
    vec_id with the same vector count once. Empty tables give no rows.

    Vectors are dealt to shards by a hash of their id, so equal vectors spread
    evenly; one tree is built per shard and written out. Queries go in blocks
    against the shards; a block meets its shards one after another in one
    task, so the neighbours found so far prune the later trees.
    """
    raws = cut(as_bytes(vectors).dropDuplicates(), "vectors")
    width = common_width(raws)
    raws = raws.where(F.octet_length("raw") == 8 * width)
    asked = as_bytes(queries).dropDuplicates(["vec_id"]).where(F.octet_length("raw") == 8 * width)

    def norms(batches):
        for frame in batches:
            yield pd.DataFrame({"top": [length(matrix(frame["raw"])).max() if len(frame) else 0.0]})

    summary = raws.mapInPandas(norms, "top double").agg(F.max("top").alias("top")).first()
    rows = raws.count()
    shards = max(1, -(-rows // shard_rows))
    top = float(summary["top"] or 1.0) * (1 + 1e-12)

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        tree = build(group["vec_id"].to_numpy(np.int64), matrix(group["raw"]), top, k + 1)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "tree": [pickle.dumps(tree, protocol=5)]})

    placed = raws.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    trees = cut(placed.groupBy("shard").applyInPandas(plant, "shard int, tree binary"), "trees")

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        block = pickle.dumps((group["vec_id"].to_numpy(np.int64), matrix(group["raw"])), protocol=5)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "queries": [block]})

    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    grouped = dealt.groupBy("block").applyInPandas(gather, "block int, queries binary")
    meetings = grouped.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, "shard")

    def run(batches):
        state: tuple[int, np.ndarray, Search] | None = None

        def answers() -> pd.DataFrame:
            _, ids, search = state
            out = [(q, r, v, s) for i, q in enumerate(ids.tolist()) for r, (v, s) in enumerate(search.results(i), 1)]
            return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

        for frame in batches:
            for block, asked_, tree in zip(frame["block"], frame["queries"], frame["tree"]):
                if state is None or state[0] != block:
                    if state is not None:
                        yield answers()
                    ids, q = pickle.loads(asked_)
                    state = (block, ids, Search(ids, q, k, factor))
                state[2].tree(pickle.loads(tree))
        if state is not None:
            yield answers()

    ordered = meetings.repartition("block").sortWithinPartitions("block", "shard")
    return ordered.mapInPandas(run, "query_id bigint, rank int, vec_id bigint, score double")
