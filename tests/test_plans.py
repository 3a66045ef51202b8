"""Whole jobs on small input."""

import pytest
from pyspark.sql import functions as F

from gridtwin import schemas
from gridtwin.operators import rooms
from gridtwin.plans import corpus, edit_pairs, evaluation
from gridtwin.sources import readers, writers


def test_corpus(spark, tmp_path):
    params = corpus.preset_params(spark, 0, 40, "easy", cut="0.25")
    stats = {r.split: (r.n, r.solvable) for r in corpus.build_corpus(params, str(tmp_path), 20, min_path=6, preset="easy").collect()}
    assert stats == {"train": (32, 16), "val": (4, 2), "test": (4, 2), "all": (40, 20)}
    labels = writers.read_csv(spark, str(tmp_path / "labels"), schemas.LABEL)
    assert labels.count() == 40 and labels.where("solvable = 0 AND solution_length IS NOT NULL").isEmpty()
    mazes = {r.id: r for r in readers.read_mazes(spark, str(tmp_path)).collect()}
    assert sorted(mazes) == [f"{i:06d}" for i in range(40)]
    assert len(readers.read_mazes(spark, str(tmp_path), "val").collect()) == 4
    for row in labels.collect():
        maze = mazes[row.id]
        check_maze(maze.asDict(recursive=True))
        assert (maze.seed, int(maze.solvable), maze.split, *maze.start, *maze.goal) == (
            row.seed, row.solvable, row.split, row.start_x, row.start_y, row.goal_x, row.goal_y
        )
        assert (maze.meta.treePathLength, maze.meta.solutionLength, min(maze.meta.componentSizes), maze.meta.cutIndex) == (
            row.tree_path_length, row.solution_length, row.component_min, row.cut_index
        )
    # members of a pair differ in the cut and the opened edge alone
    for i in range(0, 40, 2):
        yes, no = mazes[f"{i:06d}"], mazes[f"{i + 1:06d}"]
        assert yes.solvable and not no.solvable and yes.seed == no.seed
        moved = open_edges(yes.asDict(recursive=True)) ^ open_edges(no.asDict(recursive=True))
        recorded = {as_edge(yes.meta.cutEdge)} | ({as_edge(yes.meta.openedEdge)} if yes.meta.openedEdge else set())
        assert moved == recorded
    config = readers.read_config(spark, str(tmp_path), schemas.CORPUS_CONFIG).first()
    assert (config.n, config.min_path, config.preset, list(config.splits)) == (40, 6, "easy", [0.8, 0.1, 0.1])
    assert config.seeds_skipped_for_min_path >= 0
    assert (config.maze_params.width, config.maze_params.loops, config.maze_params.cut.toPython()) == (6, 1, 0.25)


def as_edge(points):
    return frozenset(tuple(p) for p in points)


def open_edges(maze):
    right = {frozenset({(x, y), (x + 1, y)}) for y, row in enumerate(maze["right"]) for x, v in enumerate(row) if v}
    return right | {frozenset({(x, y), (x, y + 1)}) for y, row in enumerate(maze["down"]) for x, v in enumerate(row) if v}


def check_maze(maze):
    """The object against a plain flood of its passages."""
    edges, meta = open_edges(maze), maze["meta"]
    assert len(edges) == meta["passages"]
    assert all(0 <= x < maze["width"] and 0 <= y < maze["height"] for edge in edges for x, y in edge)
    dist, front = {tuple(maze["start"]): 0}, [tuple(maze["start"])]
    while front:
        after = []
        for x, y in front:
            for cell in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if frozenset({(x, y), cell}) in edges and cell not in dist:
                    dist[cell] = dist[(x, y)] + 1
                    after.append(cell)
        front = after
    goal = tuple(maze["goal"])
    assert (goal in dist) == maze["solvable"] and dist.get(goal) == meta["solutionLength"]
    if maze["solvable"]:
        way = [tuple(p) for p in meta["solution"]]
        assert way[0] == tuple(maze["start"]) and way[-1] == goal and len(way) == dist[goal] + 1
        assert all(frozenset(step) in edges for step in zip(way, way[1:]))
    else:
        assert meta["solution"] is None and len(dist) == meta["componentSizes"][0]
    assert sum(meta["componentSizes"]) == maze["width"] * maze["height"]
    assert len(meta["treePath"]) == meta["treePathLength"] + 1 and len(meta["loopEdges"]) == meta["loops"]
    k = meta["cutIndex"]
    assert meta["cutEdge"] == meta["treePath"][k : k + 2]
    assert all(as_edge(e) in edges for e in meta["loopEdges"])


def test_corpus_from_preset_one_of_each_pair(spark, tmp_path):
    """Rounds of new seeds until enough have a long path; labels alternate in the splits."""
    root = str(tmp_path / "small")
    stats = corpus.build_from_preset(spark, root, 10, "easy", both=False, min_path=12, seed=100, placement="corners")
    assert {r.split: (r.n, r.solvable) for r in stats.collect()} == {"train": (8, 4), "val": (1, 1), "test": (1, 1), "all": (10, 6)}
    mazes = [r.asDict(recursive=True) for r in readers.read_mazes(spark, root).collect()]
    for maze in mazes:
        check_maze(maze)
        assert maze["start"] == [0, 0] and maze["meta"]["treePathLength"] >= 12
    assert len({m["seed"] for m in mazes}) == 10 and min(m["seed"] for m in mazes) >= 100
    config = readers.read_config(spark, root, schemas.CORPUS_CONFIG).first()
    assert config.seeds_skipped_for_min_path == max(m["seed"] for m in mazes) - 100 + 1 - 10
    assert config.maze_params.placement == "corners" and config.maze_params.cut.toPython() == "random"


def test_wrong_parameters_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="between 3 and 100"):
        corpus.preset_params(spark, 0, 2, width=2)
    with pytest.raises(ValueError, match="unknown parameters"):
        corpus.preset_params(spark, 0, 2, depth=2)
    with pytest.raises(ValueError, match="even"):
        corpus.build_from_preset(spark, str(tmp_path), 3)


def test_edit_pairs_and_evaluation(spark):
    room = ". . .+p\n.+# . .\n.+G i .\n"
    levels = spark.createDataFrame([(name, room) for name in "abc"], "room_id string, text string")
    tries = edit_pairs.plan_tries(levels, 3, 4)
    verdicts = tries.select("edit_id", F.when(F.col("try_no") % 2 == 0, "solved").otherwise("unsolved").alias("status"), F.lit(5).alias("moves"))
    base = spark.createDataFrame([("a", None, "solved", 4), ("b", None, "capped", None)], "room_id string, world string, status string, moves int")
    records = edit_pairs.pairs_from_verdicts(levels, tries, verdicts, base)
    assert records.count() == 4 and records.where("solvable").count() == 2
    assert {r.room for r in records.collect()} == {"a"}
    assert {(r.room_id, r.reason) for r in rooms.skipped_rooms(levels, base).collect()} == {("b", "capped"), ("c", "no result")}
    replies = records.select("id", F.lit("ANSWER: YES").alias("reply"), F.lit(None).cast("string").alias("stop_reason"), F.lit(None).cast("string").alias("error"))
    results = evaluation.judge_replies(records.select("id", "solvable", "tags"), replies)
    results = results.withColumn("pocket_frac", F.lit(0.5)).withColumn("edit_type", F.lit("")).withColumn("tree_path_length", F.lit(4))
    overall = evaluation.report(results).where("slice = 'overall'").first()
    assert (overall.n, overall.correct, overall.hit_rate, overall.fa_rate) == (4, 2, 1.0, 1.0)
