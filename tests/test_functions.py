"""Fixed constants and small cases of the column functions."""

import statistics

import pytest
from pyspark.sql import functions as F

from gridtwin.functions import cells as C
from gridtwin.functions.answers import outcome, parse_answer
from gridtwin.functions.images import image_paths, normalise_angles
from gridtwin.functions.prompts import maze_prompt, room_prompt
from gridtwin.functions.rng import coin, draw, draw_int, fnv1a32, seed_from_boolean, seed_from_number, seed_from_text, trial_seed
from gridtwin.functions.signal import probit


def values(spark, column, rows=None, schema="s string"):
    df = spark.createDataFrame(rows, schema) if rows is not None else spark.range(1)
    return [r[0] for r in df.select(column.alias("v")).collect()]


def test_first_draws(spark):
    got = [r[0] for r in spark.range(3).select(draw(12345, F.col("id"))).collect()]
    assert got == [0.9797282677609473, 0.3067522644996643, 0.484205421525985]


def test_draws_are_uniform_and_integers_in_range(spark):
    rows = spark.range(20000).select(draw(F.col("id")).alias("u"), draw_int(F.col("id"), 1, 6).alias("n"), coin(F.col("id"), 2).alias("c"))
    stats = rows.agg(F.avg("u"), F.min("n"), F.max("n"), F.avg(F.col("c").cast("int"))).first()
    assert abs(stats[0] - 0.5) < 0.01 and (stats[1], stats[2]) == (0, 5) and abs(stats[3] - 0.5) < 0.02


def test_text_seeds(spark):
    given = [("42", 42), ("-1", 4294967295), ("hello", 1335831723), ("99999999999", 1215752191), (" \t7\n", 7), (None, 2166136261), ("", 2166136261)]
    assert values(spark, seed_from_text(F.col("s")), [(g,) for g, _ in given]) == [e for _, e in given]
    assert values(spark, trial_seed("run", F.lit(3))) == values(spark, fnv1a32(F.lit("run:3")))


def test_hash_of_unicode_text(spark):
    def reference(text):
        h = 2166136261
        for octet in text.encode():
            h = ((h ^ octet) * 16777619) % 2**32
        return h

    texts = ["mäze ✓", "a", "é" * 50, "日本"]
    assert values(spark, fnv1a32(F.col("s")), [(t,) for t in texts]) == [reference(t) for t in texts]


def test_number_seeds(spark):
    given = [(42.0, 42), (-1.0, 4294967295), (float(2**40 + 5), 5), (-2.7, 4294967294)]
    assert values(spark, seed_from_number(F.col("n")), [(g,) for g, _ in given], "n double") == [e for _, e in given]
    assert values(spark, seed_from_boolean(F.lit(True))) == values(spark, fnv1a32(F.lit("true")))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("blah\nANSWER: NO", "no"),
        ("yes it is.\nANSWER: YES", "yes"),
        ("I think no", "no"),
        ("unclear", "unparsed"),
        ("ANSWER: yes\nANSWER: no", "no"),
        ("", "unparsed"),
        (None, "unparsed"),
        ("Yes and no", "unparsed"),
        ("answer:\n\tYes.", "yes"),
        ("ANSWER: NOPE", "unparsed"),
        ("no\nnot sure\n\n", "unparsed"),
        ("yes ", "yes"),
        ("éyes", "unparsed"),
    ],
)
def test_answers(spark, text, expected):
    assert values(spark, parse_answer(F.col("s")), [(text,)]) == [expected]


def test_outcome_precedence(spark):
    rows = [("ANSWER: YES", "refusal", "boom", "error"), ("ANSWER: YES", "refusal", None, "refused"), ("ANSWER: YES", None, None, "yes")]
    got = values(spark, outcome(F.col("r"), F.col("s"), F.col("e")), [r[:3] for r in rows], "r string, s string, e string")
    assert got == [r[3] for r in rows]


def test_probit(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.975, 0.999]
    got = values(spark, probit(F.col("p")), [(p,) for p in ps], "p double")
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], abs=1e-7)
    assert values(spark, probit(F.lit(0.0))) == [None]


def test_cells(spark):
    given = [("+M0", ["", "M0"]), (".", ["."]), ("", [""]), ("+", [""]), (".+h+#", [".", "", "#"]), (None, [""])]
    assert values(spark, C.split_cell(F.col("s")), [(g,) for g, _ in given]) == [e for _, e in given]
    stacks = [([".", "", ""], "."), ([""], "+"), (["", ""], "+"), (["", "M0"], "+M0"), ([".", "#"], ".+#")]
    assert values(spark, C.join_cell(F.col("t")), [(g,) for g, _ in stacks], "t array<string>") == [e for _, e in stacks]
    grid = values(spark, C.level_grid(F.col("s")), [("\n a  b\n\n c\n",), ("   ",)])
    assert grid == [[["a", "b"], ["c", "+"]], []]
    assert values(spark, C.turned_slope(F.lit("SlO"))) == ["SrO"]


def test_prompts(spark):
    text = values(spark, maze_prompt("both", "dots", False, "dark"))[0]
    assert text.startswith("The image shows a maze. Walls are drawn as white lines on a black background. Two identical discs")
    assert text.endswith('"ANSWER: NO" if it is not.') and "text form below" in text
    legend = F.create_map(F.lit("W"), F.lit("wall"), F.lit("G"), F.lit("gem"))
    room = values(spark, room_prompt("Tower", "ascii", legend, "top"))[0]
    assert 'Legend: "G" = gem, "W" = wall.' in room and "The image shows" not in room
    several = values(spark, room_prompt("Tower", "image", None, "perspective", 2))[0]
    assert "The 2 images show the room from the game camera rotated in 90-degree steps" in several


def test_images(spark):
    images = F.struct(
        F.lit("p.png").alias("perspective"), F.lit(None).cast("string").alias("top"), F.create_map(F.lit("180"), F.lit("p180.png")).alias("yaws")
    )
    assert values(spark, image_paths(images, "perspective", "0,180,90")) == [["p.png", "p180.png"]]
    assert values(spark, image_paths(images, "perspective", "all")) == [["p180.png"]]
    assert values(spark, image_paths(images, "top")) == [[]]
    assert values(spark, normalise_angles(F.lit("-90,450, 45,0"))) == [[270, 90, 0]]
