"""Vector operators against exact products."""

import numpy as np
import pandas as pd
import pytest

from gridtwin.llm import flatgraph, vantage
from test_duplicates import brute_groups  # noqa: F401

SCHEMA = "vec_id bigint, embedding array<double>, label int, raw string, rep int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)


ODD = [
    (1, None),
    (2, []),
    (3, [0.0, 0.0, 0.0]),
    (4, [1.0, None, 0.0]),
    (5, [1.0, float("nan"), 0.0]),
    (6, [1.0, float("inf"), 0.0]),
    (7, [1.0, 2.0]),
    (8, [1e-200, 0.0, 0.0]),
    (9, [1e200, 0.0, 0.0]),
    (10, [1.0, 0.0, -0.0]),
    (11, [1.0, 0.0, 0.0]),
    (12, [0.0, 3.0, 0.0]),
    (13, [0.1, 3.0, 0.0]),
]


def clustered(draw, n, width=24):
    x = draw.normal(size=(n, width))
    x[n // 2 : n // 2 + n // 4] = x[0] + draw.normal(size=(n // 4, width)) * 0.04  # a dense group
    for k in range(0, n // 4, 5):  # pairs
        x[n - 1 - k] = x[k + 1] * 2 + draw.normal(size=width) * 0.05
    x[10:14] = x[9]
    return x


def brute_links(rows, threshold):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = list(range(len(ids)))
    changed = True
    while changed:
        low = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        changed, label = low != label, low
    return {ids[i]: (int(near[i].sum()), ids[label[i]]) for i in range(len(ids))}


def test_flat_graph_finds_the_links(spark):
    draw = np.random.default_rng(6)
    rows = [(int(i) * 3, v.tolist()) for i, v in enumerate(clustered(draw, 900))]
    want = brute_links(rows, 0.95)
    assert max(n for n, _ in want.values()) > 100
    got = flatgraph.near_duplicates(frame(spark, rows), 0.95, part_rows=100).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_flat_graph_on_odd_rows(spark):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in flatgraph.near_duplicates(frame(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    assert all(got[i] == (0, i, True) for i in range(1, 8))
    assert [got[i][:2] for i in range(8, 14)] == [(3, 8)] * 4 + [(1, 12)] * 2
    assert flatgraph.near_duplicates(frame(spark, [])).count() == 0
    assert flatgraph.near_duplicates(frame(spark, ODD[:3])).count() == 3
    twice = flatgraph.near_duplicates(frame(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [0.0, 1.0])]))
    assert sorted(map(tuple, twice.collect()), key=str) == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]


def test_grown_graph_reaches_every_vector():
    x = np.random.default_rng(2).normal(size=(500, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    links = flatgraph.grow(x)
    walk = flatgraph.Walk(x, links, x, flatgraph.medoids(x), 32)
    walk.greedy()
    assert (walk.cosine[np.arange(500), np.arange(500)] > 0.999).mean() > 0.98
    assert ((walk.cosine > -2).sum(axis=1) < 500).mean() > 0.9  # without looking at everything


@pytest.mark.parametrize("dense, pairs, width", [(400, 300, 64), (900, 50, 64), (0, 500, 64), (300, 60, 24), (3, 1, 8)])
def test_the_graph_alone_reaches_isolated_pairs_beside_a_dense_group(dense, pairs, width):
    x64 = skewed(np.random.default_rng(dense), dense, pairs, width)
    x64 /= np.linalg.norm(x64, axis=1, keepdims=True)
    x = x64.astype(np.float32)
    found = flatgraph._linked(x, x64, flatgraph.grow(x), x, x64, 0.95, flatgraph.BEAM)
    found |= found.T
    true = x64 @ x64.T >= 0.95
    assert not (found & ~true).any()
    assert ((found & true).sum(axis=1) / true.sum(axis=1)).mean() >= 0.99


def test_medoids_of_equal_vectors_and_of_one():
    assert flatgraph.medoids(np.ones((5, 1), np.float32)).tolist() == [0]
    assert flatgraph.medoids(np.ones((1, 1), np.float32)).tolist() == [0]
    assert sorted(flatgraph.medoids(np.eye(3, dtype=np.float32)).tolist()) == [0, 1, 2]


def brute_nearest(rows, queries, k):
    x = np.array([v for _, v in rows])
    out = []
    for q in queries:
        own = next(v for i, v in rows if i == q)
        scores = [(-float(np.cumsum(np.array(own) * v)[-1]), i) for (i, _), v in zip(rows, x) if i != q]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_vantage_trees_are_exact_at_factor_one(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(1500, 8)) * draw.uniform(0.2, 3, (1500, 1))
    x[100:400] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = frame(spark, rows)
    want = brute_nearest(rows, range(0, 1500, 50), 20)
    for shard_rows in (2000, 300):
        got = vantage.nearest(vectors, vectors.where("vec_id % 50 = 0"), 20, 1.0, shard_rows).collect()
        assert sorted(map(tuple, got)) == want
    relaxed = vantage.nearest(vectors, vectors.where("vec_id % 50 = 0"), 20, 1.5).collect()
    assert len({(r.query_id, r.vec_id) for r in relaxed} & {w[::2][:1] + (w[2],) for w in want}) > 0.9 * len(want)


def test_pruning_skips_work():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(40, 6))[draw.integers(0, 40, 4000)] + draw.normal(size=(4000, 6)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = vantage.build(np.arange(4000), x, 1.0 + 1e-12, 21)
    looked = []
    for factor in (1.0, 3.0):
        search = vantage.Search(np.arange(50), x[:50], 20, factor)
        real, seen = search.offer, [0]
        search.offer = lambda t, rows, found, low, real=real, seen=seen: (seen.__setitem__(0, seen[0] + found.size), real(t, rows, found, low))
        search.tree(tree)
        looked.append(seen[0] / (50 * 4000))
    assert looked[1] < looked[0] < 0.5


def test_ties_go_to_the_smallest_ids(spark):
    """500 different vectors in several shards have one product with the query; some more are copies."""
    draw = np.random.default_rng(8)
    rows = [(i, [1.0, *draw.normal(size=3)]) for i in range(500)]
    rows += [(500, [1.0, 0.0, 0.0, 0.0]), (501, [2.0, 0.0, 0.0, 0.0]), (502, [2.0, 5.0, 0.0, 0.0]), *((i, [1.0, 7.0, 7.0, 7.0]) for i in range(503, 560))]
    draw.shuffle(rows)
    rows = [(int(i), [float(c) for c in v]) for i, v in rows]
    vectors = frame(spark, rows)
    for shard_rows in (5000, 60):
        got = vantage.nearest(vectors, vectors.where("vec_id = 500"), 20, 1.0, shard_rows).collect()
        assert sorted(map(tuple, got)) == brute_nearest(rows, [500], 20)
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [501, 502, *range(18)]


def test_search_on_odd_rows(spark):
    odd = frame(spark, ODD)
    got = vantage.nearest(odd, odd, 3).collect()
    assert {r.query_id for r in got} == {*range(8, 14)}
    first = [(r.rank, r.vec_id) for r in got if r.query_id == 10]
    assert sorted(first)[0] == (1, 9)
    assert vantage.nearest(frame(spark, []), odd, 3).count() == 0
    assert vantage.nearest(odd, frame(spark, []), 3).count() == 0
    assert vantage.nearest(frame(spark, ODD + ODD[8:]), odd.where("vec_id = 12"), 50).count() == 5


def skewed(draw, dense=300, pairs=60, width=24):
    """A dense group and isolated pairs."""
    group = draw.normal(size=width) + draw.normal(size=(dense, width)) * 0.03
    one = draw.normal(size=(pairs, width))
    return np.concatenate([group, one, one * 2 + draw.normal(size=one.shape) * 0.03])


def test_audit_sees_lost_pairs_beside_a_dense_group(spark):
    x = skewed(np.random.default_rng(8))
    reps = spark.createDataFrame([(i, 1, v.astype("<f8").tobytes()) for i, v in enumerate(x)], "rep bigint, copies bigint, raw binary")
    full = [(i, n, 0) for i, (n, _) in brute_links(list(enumerate(x)), 0.95).items() if n]
    links = spark.createDataFrame(full, "rep bigint, links bigint, root bigint")
    assert flatgraph.audit(reps, links, 0.95) == 1.0
    assert flatgraph.audit(reps, links.where("rep < 300"), 0.95) < 0.5  # all pairs are lost, and 99.8% of the links are there


def test_links_are_exact_where_the_search_fails(spark, monkeypatch):
    rows = [(int(i) * 3, v.tolist()) for i, v in enumerate(skewed(np.random.default_rng(9)))]
    search = flatgraph._links
    monkeypatch.setattr(flatgraph, "_links", lambda *a: search(*a).where("links > 100"))
    monkeypatch.setattr(flatgraph._exact, "__defaults__", (100,))
    got = flatgraph.near_duplicates(frame(spark, rows), 0.95, part_rows=100).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows, 0.95)


def test_a_pair_of_several_shards_needs_one_find():
    x = np.array([[1.0, 0, 0], [1.0, 0.2, 0], [0.9, -0.3, 0], [0.0, 0.1, 1.0], [0.0, 0.0, 1.0]])

    def shard(number, near):
        rows = [(number, 0, i, 1, v.astype("<f8").tobytes(), [2, 7], near[i]) for i, v in enumerate(x)]
        return pd.DataFrame(rows, columns=["shard", "side", "rep", "copies", "raw", "homes", "near"])

    full = [[j for j in range(5) if j != i] for i in range(5)]
    broken = [[j for j in near if j < 3] for near in full[:3]] + [[], []]  # nothing leads to the last pair
    got = pd.concat([flatgraph._meet(shard(2, broken), 0.99, 32), flatgraph._meet(shard(7, full), 0.99, 32)])
    assert got.groupby("rep")["links"].sum().to_dict() == {3: 1, 4: 1}
    assert set(got[got.rep == 4]["root"]) == {3}
