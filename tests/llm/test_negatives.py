"""Hard negatives and residue products against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtwin.llm import negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, block int, score string, bars string"


def brute(rows, every=100):
    good = {}
    for i, e, y in rows:
        if i is None or y is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        q = [math.floor(256 * float(np.float32(x))) for x in e]
        if i not in good or (y, q) < good[i]:
            good[i] = (y, q)
    out = []
    for a, (y, q) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(u * v for u, v in zip(q, p)), i, z == y) for i, (z, p) in good.items() if i != a)
        for s, i, _ in [x for x in scored if x[2]][:5]:
            inside = [x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out.extend((a, i, r, n, -s, -t) for r, (t, n, _) in enumerate(inside, 1))
    return sorted(out)


def check(spark, rows, **sizes):
    table = spark.createDataFrame([(i, e, y, 1, "s", "b") for i, e, y in rows], SCHEMA)
    got = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, queries.moved_label(), **sizes)
    assert dict(got.dtypes)["rank"] == "int"
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want
    return want


@pytest.mark.parametrize("columns,peak", [(3, 5), (64, 256), (300, 4000), (700, 2**25)])
def test_products_are_exact(columns, peak):
    draw = np.random.default_rng(columns)
    a, b = (draw.integers(-peak, peak, (n, columns), endpoint=True) for n in (7, 9))
    a[0], b[0], b[1] = peak, peak, -peak
    primes = negatives.primes_for(columns * peak * peak, columns)
    got = negatives.products(negatives.Residues(a, primes), negatives.Residues(b, primes))
    assert got.tolist() == [[sum(x * y for x, y in zip(u, v)) for v in b.tolist()] for u in a.tolist()]


def test_best_keeps_the_first_of_ties():
    best = negatives.Best(2, 3)
    best.offer(np.array([0, 0, 1]), np.array([5, 7, 1]), np.array([10, 11, 12]))
    best.offer(np.array([0, 0, 0]), np.array([7, 7, 7]), np.array([20, 21, 22]))
    assert best.id.tolist() == [[11, 20, 21], [12, -1, -1]]


def test_hard_negatives(spark):
    draw = random.Random(2)
    middle = [[draw.gauss(0, 0.3) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(900):
        e = [x + draw.gauss(0, 0.1) for x in draw.choice(middle)]
        rows.append((i, e, draw.randrange(3)))
    rows += [(i, middle[0], i % 2) for i in range(900, 1300)]  # one vector said very often: ties
    rows += [(1300, None, 1), (1400, middle[0], None), (None, middle[0], 1), (1500, [0.0] * 8, 1), (1600, [float("nan")] * 8, 1)]
    rows += [(1700, [None] * 8, 1), (1800, [float("inf")] * 8, 1), (1900, [-x for x in middle[0]], 2), (2000, [40.0] * 8, 9), (2001, [41.0] * 8, 9)]
    rows += rows[:50] + [(100, middle[1], 7)]  # repeated rows, and an id with two vectors
    whole = check(spark, rows)
    assert len({r[0] for r in whole}) > 10
    assert check(spark, rows, anchor_block=4, strip_rows=100) == whole


def test_no_vectors_and_lone_ones(spark):
    assert check(spark, []) == []
    assert check(spark, [(0, [1.0, 2.0], 1)]) == []
    assert check(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, [], 1), (3, None, 1)]) == []


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.0], 2), (3, [1.0, 2.0, 3.0], 1), (4, [], 2)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), F.col("vec_id") == 0)
    assert list(map(tuple, got.collect())) == [(0, 1, 1, 2, 327680, 163840)]
