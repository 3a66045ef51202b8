"""From parameters to a saved, balanced corpus of maze pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtwin import VERSION
from gridtwin.operators import mazes, minimal_pairs, sampling
from gridtwin.operators.scoring import corpus_statistics
from gridtwin.session import cut
from gridtwin.sources import writers

SPLITS = (0.8, 0.1, 0.1)
OVERRIDES = {
    "width": "int", "height": "int", "algorithm": "string", "placement": "string", "cut": "string", "loops": "int",
    "min_distance": "int",
}


def preset_params(spark: SparkSession, first_seed: int, seeds: int, preset: str | None = None, **overrides) -> DataFrame:
    """One row of parameters for each of the ``seeds`` seeds from ``first_seed``, all alike; wrong ones are an error."""
    unknown = set(overrides) - set(OVERRIDES)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    given = [F.lit(overrides.get(name)).cast(kind).alias(name) for name, kind in OVERRIDES.items()]
    numbers = spark.range(first_seed, first_seed + seeds)
    asked = numbers.select(
        F.col("id").alias("graph_id"), F.lit(preset).alias("preset"), F.col("id").cast("string").alias("seed_text"), *given
    )
    resolved = minimal_pairs.resolve_params(asked)
    wrong = minimal_pairs.rejected(resolved.limit(1)).first()  # all rows have the same parameters
    if wrong:
        raise ValueError(wrong["reason"])
    return minimal_pairs.accepted(resolved)


def build_corpus(
    params: DataFrame,
    root: str,
    n: int,
    fractions: tuple[float, float, float] = SPLITS,
    both: bool = True,
    min_path: int = 0,
    seed: int = 0,
    preset: str | None = None,
) -> DataFrame:
    """Write ``n`` seeds' worth of maze pairs below ``root`` and return statistics per split.

    ``params`` (see ``minimal_pairs.accepted``, :func:`preset_params`) has one
    row per candidate seed; the first ``n`` whose tree path is long enough are taken.
    """
    return write_corpus(minimal_pairs.build_pairs(params), root, n, fractions, both, min_path, seed, preset)


def build_from_preset(
    spark: SparkSession,
    root: str,
    n: int,
    preset: str | None = None,
    fractions: tuple[float, float, float] = SPLITS,
    both: bool = True,
    min_path: int = 0,
    seed: int = 0,
    rounds: int = 8,
    **overrides,
) -> DataFrame:
    """:func:`build_corpus` of ``n`` items, trying the seeds from ``seed`` on until enough have a path of ``min_path``.

    Each round tries as many new seeds as the share of valid ones so far asks
    for, at least twice the missing ones; ``rounds`` without enough are an error.
    """
    if n < 2 or n % 2:
        raise ValueError("n must be an even number of at least 2")
    wanted = n // 2 if both else n
    pairs: dict[str, DataFrame] = {}
    tried = valid = 0
    ask = wanted
    for _ in range(rounds):
        more = minimal_pairs.build_pairs(preset_params(spark, seed + tried, ask, preset, **overrides))
        pairs = {name: pairs[name].unionByName(more[name]) for name in pairs} or more
        tried += ask
        valid += more["chosen"].where(F.col("path_length") >= min_path).count()
        if valid >= wanted:
            return write_corpus(pairs, root, wanted, fractions, both, min_path, seed, preset)
        missing = wanted - valid
        ask = max(2 * missing, missing * tried // max(valid, 1))
    raise ValueError(f"of {tried} seeds only {valid} have a path of at least {min_path}")


def write_corpus(
    pairs: dict[str, DataFrame],
    root: str,
    n: int,
    fractions: tuple[float, float, float] = SPLITS,
    both: bool = True,
    min_path: int = 0,
    seed: int = 0,
    preset: str | None = None,
) -> DataFrame:
    """Write the corpus of pairs that are built already: ``labels`` (CSV), ``records`` (JSON lines by split), ``config``.

    ``config`` names the parameters (all but the seed) where all mazes have the same, else null; records name their own.
    """
    paths = pairs["params"].select("graph_id", "seed").join(
        pairs["chosen"].select("graph_id", F.col("path_length").alias("tree_path_length")), "graph_id"
    )
    paths = cut(paths, "paths")
    chosen = cut(sampling.first_valid_seeds(paths, n, min_path), "chosen")
    plan = sampling.split_plan(chosen.select("idx"), "idx", fractions, seed)
    members = chosen.withColumn("solvable", F.explode(F.array(F.lit(True), F.lit(False))))
    emitted = cut(sampling.emit_members(plan, members, both), "emitted")
    objects = cut(mazes.maze_objects(pairs, emitted), "objects")

    labels = cut(mazes.label_rows(objects), "labels")
    writers.write_labels(labels, f"{root}/labels")
    writers.write_records(objects.drop("idx"), root)
    skipped = sampling.skipped_seeds(paths, n, min_path).first()["skipped"]
    alike = F.struct(F.col("params").dropFields("seed").alias("p"))
    text = F.to_json(alike)
    head = objects.agg(
        F.count("*").alias("n"),
        F.when(F.min(text) == F.max(text), F.min(text)).alias("_params"),
    )
    kind = objects.select(alike.alias("s")).schema["s"].dataType
    head = head.select("n", F.from_json("_params", kind)["p"].alias("maze_params"))
    writers.write_config(
        head,
        root,
        pairs=F.lit(both),
        seeds_skipped_for_min_path=F.lit(skipped),
        base_seed=F.lit(seed),
        min_path=F.lit(min_path),
        splits=F.array(*[F.lit(float(f)) for f in fractions]),
        preset=F.lit(preset).cast("string"),
        version=F.lit(VERSION),
    )
    return corpus_statistics(labels.withColumn("solvable", F.col("solvable") == 1))
