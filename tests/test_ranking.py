"""Ranks, running totals and medians against plain sorting, with one hot group."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtwin.functions.rng import draw
from gridtwin.operators import ranking, sampling, scoring


def hot_rows(spark):
    """Three groups; one holds nine rows in ten and many equal values."""
    key = F.col("id")
    return spark.range(5000).select(
        "id", F.when(key % 10 == 0, key % 20).otherwise(7).alias("g"), F.floor(draw(key, 9) * 40).alias("v"), draw(key, 8).alias("x")
    )


def test_seeded_rank_equals_one_big_window(spark):
    rows = hot_rows(spark)
    ranked = ranking.seeded_rank(rows, 3, "id", "r", ["g"], total="n", buckets=64)
    expected = ranked.withColumn("e", F.row_number().over(Window.partitionBy("g").orderBy(draw(3, F.col("id")), "id")))
    expected = expected.withColumn("m", F.count("*").over(Window.partitionBy("g")))
    assert expected.count() == 5000
    assert expected.where((F.col("r") != F.col("e")) | (F.col("n") != F.col("m"))).isEmpty()


def test_rank_does_not_depend_on_partitions(spark):
    once = ranking.seeded_rank(hot_rows(spark), 3, "id", "r").orderBy("id").collect()
    again = ranking.seeded_rank(hot_rows(spark).repartition(13), 3, "id", "r").orderBy("id").collect()
    assert once == again


def test_running_total(spark):
    rows = hot_rows(spark)
    summed = ranking.running_total(rows, ["g"], F.floor(F.col("id") / 100), ["id"], F.col("v"), "t")
    plain = F.sum("v").over(Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    assert summed.withColumn("e", plain).where(F.col("t") != F.col("e")).isEmpty()


def test_upper_median_is_exact(spark):
    rows = hot_rows(spark).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("x")))
    plain = {}
    for r in rows.collect():
        for name in ("v", "x"):
            if r[name] is not None:
                plain.setdefault((name, r["g"]), []).append(r[name])
                plain.setdefault((name, "all"), []).append(r[name])
    middle = {k: sorted(v)[len(v) // 2] for k, v in plain.items()}
    for at_once in (4096, 40, 1):
        for name in ("v", "x"):
            got = {r["g"]: r["m"] for r in ranking.upper_median(rows, ["g"], name, "m", at_once).collect()}
            assert got == {g: m for (n, g), m in middle.items() if n == name and g != "all"}
            assert ranking.upper_median(rows, [], name, "m", at_once).first()[0] == middle[(name, "all")]


def test_upper_median_of_odd_numbers(spark):
    """Infinities, NaN (last), subnormal, huge and equal values, and longs that doubles cannot tell apart."""
    values = [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.5, 1.5, 1.5, 2.0, 3.0, -7.25, 1e-300]
    for n in (3, 8, 14, 15):
        rows = spark.createDataFrame([(0, v) for v in values[:n]] + [(1, None)], "g int, v double")
        got = ranking.upper_median(rows, ["g"], "v", "m", 2).collect()
        assert [(r.g, r.m) for r in got] == [(0, sorted(values[:n])[n // 2])]
    rows = spark.createDataFrame([(float("nan"),), (float("nan"),), (1.0,)], "v double")
    assert str(ranking.upper_median(rows, [], "v", "m", 1).first().m) == "nan"
    longs = [(1 << 62) + k for k in (5, 3, 1, 4, 2)]
    assert ranking.upper_median(spark.createDataFrame([(v,) for v in longs], "v long"), [], "v", "m", 1).first().m == (1 << 62) + 3


def test_split_plan_sizes_and_labels(spark):
    plan = sampling.split_plan(spark.range(25).select(F.col("id").alias("k")), "k", (0.5, 0.1, 0.4), 1)
    got = {r["split"]: (r["n"], r["p"]) for r in plan.groupBy("split").agg(F.count("*").alias("n"), F.count_if("label").alias("p")).collect()}
    # 12.5 and 2.5 both round to even
    assert got == {"train": (12, 6), "val": (2, 1), "test": (11, 6)}


def test_pair_sample_keeps_at_least_one_pair(spark):
    items = spark.range(40).select("id", F.floor(F.col("id") / 2).alias("pair"), (F.col("id") % 2 == 0).alias("solvable"))
    assert sampling.pair_sample(items, 5, 1).count() == 2
    assert sampling.pair_sample(items, 5, 0).count() == 40
    trials = sampling.pair_sample(items, 5, 10)
    assert trials.count() == 10 and trials.select("pair").distinct().count() == 5
    assert sorted(r["trial"] for r in trials.collect()) == list(range(10))


def test_null_keys_and_groups_keep_every_row(spark):
    rows = [(None if k % 2 else k, None if k % 3 else "g", k) for k in range(100)]
    df = spark.createDataFrame(rows, "key bigint, team string, id int")
    for groups in (["team"], []):
        assert ranking.seeded_rank(df, 7, "key", "place", groups).count() == 100
    medians = {r.team: r.m for r in ranking.upper_median(df, ["team"], "id", "m").collect()}
    for team in (None, "g"):
        own = sorted(r[2] for r in rows if r[1] == team)
        assert medians[team] == own[len(own) // 2]


def test_slices_without_path_lengths(spark):
    from gridtwin.operators import scoring

    schema = "solvable boolean, answer string, pocket_frac double, edit_type string, tags array<string>, tree_path_length int, team string"
    rows = [(True, "yes", 0.1, "wall", ["t"], None, None), (False, "no", 0.3, None, None, None, "a")]
    df = spark.createDataFrame(rows, schema)
    report = {(r["slice"], r["slice_value"]): r["n"] for r in scoring.slice_report(df).collect()}
    assert report[("overall", "all")] == 2 and ("tag", "t") in report and not any(k[0] == "path" for k in report)
    assert scoring.by_path_length(df, ["team"]).count() == 0
    assert scoring.with_path_class(df, ["team"]).count() == 2


def test_bottom_k_equals_a_full_rank(spark):
    rows = hot_rows(spark)
    for groups in ([], ["g"]):
        ranked = ranking.seeded_rank(rows, 9, "id", "r", groups)
        for k in (1, 37, 100_000):
            want = {r.id for r in ranked.where(F.col("r") <= k).collect()}
            assert {r.id for r in ranking.lowest_draws(rows, 9, "id", k, groups).collect()} == want
    numbers = [-5, 3, 1 << 40, 7, 8, 9, 1 << 41, 0]
    df = spark.createDataFrame([(n,) for n in numbers], "s long")
    for k in (1, 3, 20):
        got = sorted((r.i, r.s) for r in ranking.lowest_numbers(df, "s", k, "i").collect())
        assert got == list(enumerate(sorted(numbers)[:k], 1))
    assert ranking.lowest_numbers(df.limit(0), "s", 3, "i").count() == 0


def test_summary_after_each_ends_with_the_summary(spark):
    rows = [(k, f"{k % 5}", k % 3 == 0, ["yes", "no", "error", "refused"][k % 4], k, None) for k in range(200)]
    results = spark.createDataFrame(rows, "id long, team string, solvable boolean, answer string, input_tokens long, output_tokens long")
    for by in ([], ["team"]):
        each = scoring.summary_after_each(results, F.floor(F.col("id") / 16), ["id"], by).collect()
        assert len(each) == 200 and sorted(r.id for r in each) == list(range(200))
        last = {}
        for r in sorted(each, key=lambda r: r.id):
            last[r["team"] if by else None] = r
        for r in scoring.summarize(results, by).collect():
            found = last[r["team"] if by else None]
            assert all(r[c] == found[c] for c in r.asDict())
