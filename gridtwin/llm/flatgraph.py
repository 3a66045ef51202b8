"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors go to the shards of their nearest centres, so shards overlap; in
each shard a graph is grown by greedy search and robust pruning; the
adjacency lists a vector got in its shards are united; then every vector
searches each of its shards from the medoids of groups far apart, widening as long
as it finds vectors in range, and cosines are confirmed in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtwin.llm.frames import hash_sample
from gridtwin.llm.groups import find_roots, smallest_reachable
from gridtwin.llm.vectors import as_bytes, common_width, matrix, unit, usable
from gridtwin.session import cut

PART_ROWS = 1_024
OVERLAP = 3
SAMPLE = 4_096
DEGREE = 24
BEAM = 32
STARTS = 32
ALPHA = 1.2
MARGIN = 0.02
AUDIT = 512
RECALL = 0.99
TRIES = 3
BLOCK_ROWS = 2_048


def centres(x: np.ndarray, count: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    draw = np.random.default_rng(seed)
    count = max(1, min(count, len(x)))
    found = x[draw.choice(len(x), count, replace=False)]
    for _ in range(rounds):
        own = (x @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        some = np.bincount(own, minlength=count) > 0
        found[some] = unit(sums[some] + 1e-12)
    return found


def medoids(x: np.ndarray, count: int = STARTS) -> np.ndarray:
    """Row numbers of the medoids of up to ``count`` groups of a shard.

    The first is the medoid of all; each further group begins at the vector farthest
    from the beginnings so far, so no dense group takes all of them.
    """
    begin = [int((x @ x.mean(axis=0)).argmax())]
    nearest = x @ x[begin[0]]
    own = np.zeros(len(x), np.int64)
    while len(begin) < count and nearest.min() < 1 - MARGIN:
        begin.append(int(nearest.argmin()))
        cosine = x @ x[begin[-1]]
        own[cosine > nearest] = len(begin) - 1
        nearest = np.maximum(nearest, cosine)
    middles = [np.flatnonzero(own == k) for k in range(len(begin))]
    found = [begin[0], *[m[(x[m] @ x[m].mean(axis=0)).argmax()] for m in middles if len(m)]]
    return np.array(list(dict.fromkeys(found)), np.int64)[:count]


class Walk:
    """Greedy search of many queries at once over one graph; remembers every cosine it computed."""

    def __init__(self, x: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int):
        self.x, self.links, self.q = x, links, queries
        rows = len(queries)
        self.cosine = np.full((rows, len(x)), -2.0, np.float32)
        self.opened = np.zeros((rows, len(x)), bool)
        starts = starts[:beam]
        first = queries @ x[starts].T
        self.cosine[:, starts] = first
        order = np.argsort(-first, axis=1, kind="stable")
        self.beam = np.full((rows, beam), -1, np.int64)
        self.beam[:, : len(starts)] = starts[order]
        self.value = np.full((rows, beam), -3.0, np.float32)
        self.value[:, : len(starts)] = np.take_along_axis(first, order, 1)

    def look(self, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compute the cosines not yet known; returns those (row, node) pairs."""
        good = nodes >= 0
        keys = np.unique(rows[good] * len(self.x) + nodes[good])
        rows, nodes = keys // len(self.x), keys % len(self.x)
        fresh = self.cosine[rows, nodes] == -2.0
        rows, nodes = rows[fresh], nodes[fresh]
        for a in range(0, len(rows), 200_000):
            r, n = rows[a : a + 200_000], nodes[a : a + 200_000]
            self.cosine[r, n] = np.einsum("ij,ij->i", self.q[r], self.x[n])
        return rows, nodes

    def greedy(self) -> None:
        """Open the best unopened node of each beam until every beam is opened."""
        while True:
            waiting = (self.beam >= 0) & ~np.take_along_axis(self.opened, np.maximum(self.beam, 0), 1)
            rows = np.flatnonzero(waiting.any(axis=1))
            if not len(rows):
                return
            node = self.beam[rows, waiting[rows].argmax(axis=1)]
            self.opened[rows, node] = True
            near = self.links[node]
            unknown = (near >= 0) & (np.take_along_axis(self.cosine[rows], np.maximum(near, 0), 1) == -2.0)
            self.look(np.repeat(rows, near.shape[1]), np.where(unknown, near, -1).ravel())
            values = np.where(unknown, self.cosine[rows[:, None], np.maximum(near, 0)], -3.0)
            both = np.concatenate([self.value[rows], values], axis=1)
            names = np.concatenate([self.beam[rows], np.where(unknown, near, -1)], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, : self.beam.shape[1]]
            self.value[rows] = np.take_along_axis(both, order, 1)
            self.beam[rows] = np.take_along_axis(names, order, 1)

    def widen(self, radius: float) -> None:
        """Open every node within the radius, and their neighbours within it, until none is left."""
        rows, nodes = np.nonzero((self.cosine >= radius) & ~self.opened)
        while len(rows):
            self.opened[rows, nodes] = True
            near = self.links[nodes]
            rows, nodes = self.look(np.repeat(rows, near.shape[1]), near.ravel())
            inside = self.cosine[rows, nodes] >= radius
            rows, nodes = rows[inside], nodes[inside]


def prune(x: np.ndarray, node: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning: take the nearest candidate, drop those ALPHA times nearer to it than to the node, repeat.

    ``candidates`` [rows, many] may hold -1 and the node itself; returns [rows, degree], -1 where fewer are left.
    """
    own = np.einsum("ijk,ik->ij", x[np.maximum(candidates, 0)], x[node])
    own[(candidates < 0) | (candidates == node[:, None])] = -3.0
    order = np.argsort(-own, axis=1, kind="stable")
    candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
    repeated = np.zeros_like(own, bool)
    ordered = np.sort(np.where(own > -3, candidates, -1), axis=1)
    if ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0)).any():
        for i in range(len(candidates)):
            repeated[i] = True
            repeated[i, np.unique(candidates[i], return_index=True)[1]] = False
    alive = (own > -3) & ~repeated
    vectors = x[np.maximum(candidates, 0)]
    away = np.sqrt(np.maximum(2 - 2 * own, 0))
    out = np.full((len(node), degree), -1, np.int64)
    rows = np.arange(len(node))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[some, k] = candidates[rows, pick][some]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("ijk,ik->ij", vectors, vectors[rows, pick]), 0))
        alive &= ALPHA * between > away
        alive[rows, pick] = False
    return out


def grow(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 1) -> np.ndarray:
    """The pruned graph of one shard as [rows, degree] neighbour numbers (-1: none)."""
    n = len(x)
    draw = np.random.default_rng(seed)
    degree = min(degree, max(1, n - 1))
    links = draw.integers(0, n, (n, degree))
    starts = medoids(x)
    for batch in np.array_split(draw.permutation(n), max(1, n // 128)):
        walk = Walk(x, links, x[batch], starts, beam)
        walk.greedy()
        opened = np.where(walk.opened, walk.cosine, -3.0)
        width = min(n, 2 * beam)
        top = np.argpartition(-opened, width - 1, axis=1)[:, :width]
        met = np.where(np.take_along_axis(opened, top, 1) > -3, top, -1)
        links[batch] = prune(x, batch, np.concatenate([met, links[batch]], axis=1), degree)
        # let the new neighbours point back, pruning lists that become too long
        to, back = links[batch].ravel(), np.repeat(batch, degree)
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, begin, size = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(nodes), min(int(size.max()), 4 * degree)), -1, np.int64)
        for i, (b, s) in enumerate(zip(begin.tolist(), size.tolist())):
            own = back[b : b + s]
            more[i, : min(s, more.shape[1])] = own if s <= more.shape[1] else draw.choice(own, more.shape[1], replace=False)
        links[nodes] = prune(x, nodes, np.concatenate([more, links[nodes]], axis=1), degree)
    return mend(x, links, starts, beam)


def mend(x: np.ndarray, links: np.ndarray, starts: np.ndarray, beam: int, rounds: int = 3) -> np.ndarray:
    """Let each vector that a search for it does not meet be pointed at from where that search ended; lists may become longer."""
    for _ in range(rounds):
        lost, ends = [], []
        for a in range(0, len(x), 256):
            walk = Walk(x, links, x[a : a + 256], starts, beam)
            walk.greedy()
            unmet = np.flatnonzero(walk.cosine[np.arange(len(walk.q)), a + np.arange(len(walk.q))] == -2.0)
            lost.append(a + unmet)
            ends.append(walk.beam[unmet, 0])
        lost, ends = np.concatenate(lost), np.concatenate(ends)
        if not len(lost):
            break
        order = np.argsort(ends, kind="stable")
        lost, ends = lost[order], ends[order]
        nodes, begin, size = np.unique(ends, return_index=True, return_counts=True)
        more = np.full((len(x), int(size.max())), -1, np.int64)
        more[ends, np.arange(len(ends)) - np.repeat(begin, size)] = lost
        links = np.concatenate([links, more], axis=1)
    return links


def local_links(lists: list, ids: np.ndarray) -> np.ndarray:
    """United neighbour lists of ids as row numbers among ``ids`` (ascending); others are left out."""
    width = max((len(n) for n in lists), default=1)
    out = np.full((len(ids), max(1, width)), -1, np.int64)
    for i, names in enumerate(lists):
        names = np.asarray(names, np.int64)
        at = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
        at = at[ids[at] == names]
        out[i, : len(at)] = at
    return out


def _linked(x, x64, links, queries, q64, threshold: float, beam: int) -> np.ndarray:
    """[queries, rows] mask of links that the search found and double precision confirms."""
    out = np.zeros((len(queries), len(x)), bool)
    starts = medoids(x)
    for a in range(0, len(queries), 256):
        walk = Walk(x, links, queries[a : a + 256], starts, beam)
        walk.greedy()
        walk.widen(threshold - MARGIN)
        rows, nodes = np.nonzero(walk.cosine >= threshold - 1e-4)
        _confirm(out, rows + a, nodes, q64, x64, threshold)
    return out


def _confirm(out, rows, nodes, q64, x64, threshold: float) -> None:
    """Mark the links among the candidate pairs, in double precision."""
    for b in range(0, len(rows), 200_000):
        r, n = rows[b : b + 200_000], nodes[b : b + 200_000]
        out[r, n] = np.einsum("ij,ij->i", q64[r], x64[n]) >= threshold


def _tally(found: np.ndarray, counted: np.ndarray, sides: list[pd.DataFrame]) -> pd.DataFrame:
    """``rep, links, root`` of every vector with a link in ``found``: its links in ``counted``, and the smallest of its group."""
    ids = [s["rep"].to_numpy(np.int64) for s in sides]
    copies = [s["copies"].to_numpy(np.float64) for s in sides]
    last = len(sides) - 1
    names, roots = [], []
    for a in range(0, len(found), 512):
        rows, nodes = np.nonzero(found[a : a + 512])
        if len(rows):
            some = find_roots(ids[0][a + rows], ids[last][nodes])
            names.append(some[0])
            roots.append(some[1])
    if not names:
        return pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    names, roots = find_roots(np.concatenate(names), np.concatenate(roots))
    parts = [(ids[0][found.any(axis=1)], (counted @ copies[last])[found.any(axis=1)])]
    if last:
        parts.append((ids[last][found.any(axis=0)], (copies[0] @ counted)[found.any(axis=0)]))
    out = pd.DataFrame({"rep": np.concatenate([p[0] for p in parts]), "links": np.concatenate([p[1] for p in parts]).astype(np.int64)})
    out["root"] = roots[np.searchsorted(names, out["rep"].to_numpy())]
    return out


def _meet(group: pd.DataFrame, threshold: float, beam: int) -> pd.DataFrame:
    """Links inside one part or between two parts of a shard: count per vector, and a star per local group."""
    sides = [g.sort_values("rep", ignore_index=True) for _, g in group.groupby("side")]
    x64 = [unit(matrix(s["raw"])) for s in sides]
    x = [v.astype(np.float32) for v in x64]
    ids = [s["rep"].to_numpy(np.int64) for s in sides]
    graphs = [local_links(list(s["near"]), i) for s, i in zip(sides, ids)]
    last = len(sides) - 1
    found = _linked(x[last], x64[last], graphs[last], x[0], x64[0], threshold, beam)
    other = found if last == 0 else _linked(x[0], x64[0], graphs[0], x[last], x64[last], threshold, beam)
    found |= other.T
    if last == 0:
        np.fill_diagonal(found, False)
    homes = [np.array(s["homes"].tolist(), np.int64) for s in sides]
    shard = int(group["shard"].iloc[0])
    # a pair that shares several shards is counted in the smallest of them, and joined wherever it is found
    rows, nodes = np.nonzero(found)
    common = (homes[0][rows][:, :, None] == homes[last][nodes][:, None, :]) & (homes[0][rows][:, :, None] < shard)
    mine = ~common.any(axis=(1, 2))
    rows, nodes = rows[mine], nodes[mine]
    counted = np.zeros_like(found)
    counted[rows, nodes] = True
    return _tally(found, counted, sides)


def _links(reps: DataFrame, rows: int, threshold: float, overlap: int, beam: int, part_rows: int) -> DataFrame:
    spark = reps.sparkSession
    sample = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("raw").collect()
    count = max(1, min(-(-rows * overlap // part_rows), SAMPLE // 8))
    middles = spark.sparkContext.broadcast(centres(unit(matrix(r["raw"] for r in sample)), count))  # at most SAMPLE / 8 vectors
    homes = min(overlap, len(middles.value))

    def place(batches):
        for frame in batches:
            near = unit(matrix(frame["raw"])) @ middles.value.T if len(frame) else np.zeros((0, homes))
            frame["homes"] = np.sort(np.argpartition(-near, homes - 1, axis=1)[:, :homes], axis=1).tolist()
            yield frame

    placed = reps.mapInPandas(place, "rep bigint, copies bigint, raw binary, homes array<int>").withColumn("shard", F.explode("homes"))
    placed = cut(placed, "placed")
    # shards with too many vectors are dealt to parts by a hash of the id
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(sizes), "shard").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def adjacency(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", ignore_index=True)
        ids = group["rep"].to_numpy(np.int64)
        links = grow(unit(matrix(group["raw"])).astype(np.float32)) if len(ids) > 1 else np.zeros((1, 0), np.int64)
        return pd.DataFrame({"rep": ids, "near": [ids[n[n >= 0]] for n in links]})

    lists = placed.groupBy("shard", "part").applyInPandas(adjacency, "rep bigint, near array<bigint>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # one list per shard
    nodes = cut(placed.join(united, "rep"), "graph")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = nodes.select("*", other).select(
        "shard",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"),
        "rep",
        "copies",
        "raw",
        "homes",
        "near",
    )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        return _meet(group, threshold, beam)

    return cut(met.groupBy("shard", "low", "high").applyInPandas(meet, "rep bigint, links bigint, root bigint"), "links")


def _level(links):
    """Class of a number of links: 0, then 1 to 3, 4 to 15, 16 to 63 and so on; numbers or a column."""
    if isinstance(links, Column):
        return F.when(links > 0, F.floor(F.log2(links) / 2).cast("int") + 1).otherwise(0)
    return np.where(links > 0, np.floor(np.log2(np.maximum(links, 1)) / 2).astype(np.int64) + 1, 0)


def audit(reps: DataFrame, links: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """The least mean recall per vector of any class of vectors with about as many true links.

    About ``sample`` vectors are drawn of every class of found links, so that
    those with none and those of small groups are looked at beside a dense group; each
    stands for its share of that class. Exact products against all vectors, in blocks.
    """
    seen = links.groupBy("rep").agg(F.sum("links").alias("found"))
    found = reps.join(seen, "rep", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    found = cut(found.select("rep", "raw", "found", _level(F.col("found")).alias("level")), "audit")
    sizes = {r["level"]: r["n"] for r in found.groupBy("level").agg(F.count("*").alias("n")).collect()}
    chosen = hash_sample(found, "rep", "level", sample).collect()  # bounded by the classes
    if not chosen:
        return 1.0
    ids = np.array([r["rep"] for r in chosen])
    asked = reps.sparkSession.sparkContext.broadcast((ids, unit(matrix(r["raw"] for r in chosen))))

    def run(batches):
        ids, q = asked.value
        true = np.zeros(len(ids))
        for frame in batches:
            for a in range(0, len(frame), 1024):
                part = frame.iloc[a : a + 1024]
                hit = (q @ unit(matrix(part["raw"])).T >= threshold) & (ids[:, None] != part["rep"].to_numpy()[None, :])
                true += hit.astype(np.float64) @ part["copies"].to_numpy(np.float64)
        yield pd.DataFrame({"rep": ids, "true": true.astype(np.int64)})

    sums = reps.mapInPandas(run, "rep bigint, true bigint").groupBy("rep").agg(F.sum("true").alias("true")).collect()
    truth = {r["rep"]: r["true"] for r in sums}
    true = np.array([truth[i] for i in ids.tolist()], np.int64)
    got, level = np.array([r["found"] for r in chosen], np.int64), np.array([r["level"] for r in chosen], np.int64)
    weight = np.array([sizes[k] for k in level.tolist()]) / np.bincount(level)[level]
    share, group = np.minimum(1.0, got / np.maximum(true, 1)), _level(true)
    return min((float(np.average(share[group == k], weights=weight[group == k])) for k in np.unique(group[group > 0])), default=1.0)


def _multiply(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside one block or between two blocks by exact products: count per vector, and a star per local group."""
    sides = [g.sort_values("rep", ignore_index=True) for _, g in group.groupby("side")]
    x = [unit(matrix(s["raw"])) for s in sides]
    last = len(sides) - 1
    found = np.concatenate([x[0][a : a + 512] @ x[last].T >= threshold for a in range(0, len(x[0]), 512)])
    if last == 0:
        np.fill_diagonal(found, False)
    return _tally(found, found, sides)


def _exact(reps: DataFrame, rows: int, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All links by products of every block with every block: quadratic in the table, a task holds two blocks."""
    blocks = -(-rows // block_rows)
    placed = reps.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select(
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"),
        "rep",
        "copies",
        "raw",
    )

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        return _multiply(group, threshold)

    return cut(met.groupBy("low", "high").applyInPandas(multiply, "rep bigint, links bigint, root bigint"), "links")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, overlap: int = OVERLAP, part_rows: int = PART_ROWS, recall: float = RECALL
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row, linking cosines of at least ``threshold``.

    Equal vectors form one class that counts with its number of rows and
    searches once. When the audit finds less than ``recall`` in any class of
    group sizes, the search is repeated with twice the overlap and beam; after
    ``TRIES`` failed tries all links come from exact products. Vectors that are null, empty, zero, non-finite or of another length
    than most link with nothing, as do rows without vec_id. Rows are linked as rows: two
    rows with the same vec_id and vector link with each other, with different
    vectors only if those are near. An empty table gives no rows.

    Links are counted, never written as pairs; the counting itself is
    quadratic inside one dense group, spread over tasks of two parts each.
    """
    named = vectors.where(F.col("vec_id").isNotNull())
    raws = cut(as_bytes(named), "vectors")
    width = common_width(raws)
    raws = raws.where(F.octet_length("raw") == 8 * width)
    lonely = vectors.where(F.col("vec_id").isNull() | ~usable(F.col("embedding")) | (F.size("embedding") != width)).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    classes = raws.groupBy("raw").agg(F.count("*").alias("copies"))
    # numbered once and written, so the numbers hold
    reps = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "copies", "raw"), "classes")
    rows = reps.count()
    beam = BEAM
    if not rows:
        return lonely.withColumn("kept", F.lit(True))
    for _ in range(TRIES):
        links = _links(reps, rows, threshold, overlap, beam, part_rows)
        if audit(reps, links, threshold) >= recall:
            break
        overlap, beam = 2 * overlap, 2 * beam
    else:
        links = _exact(reps, rows, threshold)
    groups = smallest_reachable(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    found = (
        reps.join(counts, "rep", "left")
        .join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(
            "raw",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("_group"),
        )
    )
    members = cut(raws.join(found, "raw").select("vec_id", "n_links", "_group"), "members")
    least = members.groupBy("_group").agg(F.min("vec_id").alias("component_id"))
    return (
        members.join(least, "_group")
        .select("vec_id", "n_links", "component_id")
        .unionByName(lonely)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
