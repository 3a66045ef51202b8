"""Messages for a model, rows for an evaluation, and rewards of its replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtwin.functions.answers import parse_answer
from gridtwin.functions.prompts import JSON_INTRO


def message_content(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content blocks of each item, and the items that lack a required part.

    Items have ``id, representation, prompt`` and, as the representation
    needs, ``images`` (array of data URIs), ``ascii`` and ``json``. Images come
    first, then one text block with the text form appended.
    """
    shown = F.when(
        F.col("representation").isin("image", "both"), F.coalesce("images", F.array().cast("array<string>"))
    ).otherwise(F.array().cast("array<string>"))
    text = F.concat(
        "prompt",
        F.when(F.col("representation").isin("ascii", "both"), F.concat(F.lit("\n\n"), F.coalesce("ascii", F.lit(""))))
        .when(F.col("representation") == "json", F.concat(F.lit(JSON_INTRO), F.coalesce("json", F.lit(""))))
        .otherwise(""),
    )
    nothing = F.lit(None).cast("string")
    blocks = F.concat(
        F.transform("_shown", lambda url: F.struct(F.lit("image").alias("type"), nothing.alias("text"), url.alias("url"))),
        F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), nothing.alias("url"))),
    )
    reason = F.when(
        F.col("representation").isin("image", "both") & (F.size("_shown") == 0), "no image for this view"
    ).when((F.col("representation") == "json") & (F.coalesce("json", F.lit("")) == ""), "no JSON observation")
    rows = items.withColumn("_shown", shown).withColumn("reason", reason)
    ready = rows.where(F.col("reason").isNull()).withColumn("content", blocks).drop("_shown", "reason")
    return ready, rows.where(F.col("reason").isNotNull()).select("id", "reason")


def evaluation_rows(items: DataFrame, *info: str) -> DataFrame:
    """Prompt, expected answer and info of each item with ``content`` and ``solvable``."""
    message = F.struct(F.lit("user").alias("role"), F.col("content"))
    return items.select(
        F.array(message).alias("prompt"),
        F.when(F.col("solvable"), "YES").otherwise("NO").alias("answer"),
        F.struct("id", "solvable", *info).alias("info"),
    )


def last_replies(conversations: DataFrame) -> DataFrame:
    """The last assistant message of each conversation."""
    said = conversations.where(F.col("role") == "assistant")
    return said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("reply"))


def rewards() -> dict[str, tuple[Column, float]]:
    """Named 0/1 rewards of rows with ``reply`` and the expected ``answer``, and their weights."""
    parsed = F.upper(parse_answer(F.col("reply")))
    said = F.when(parsed.isin("YES", "NO"), parsed)
    number = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    return {
        "correct": (number(said == F.col("answer")), 1.0),
        "answered": (number(said.isNotNull()), 0.0),
        "said_yes": (number(said == "YES"), 0.0),
    }


def score(rows: DataFrame, functions: dict[str, tuple[Column, float]] | None = None) -> DataFrame:
    """Each reward as a column and their weighted sum as ``reward``."""
    functions = functions or rewards()
    scored = rows.select("*", *[column.alias(name) for name, (column, _) in functions.items()])
    total = F.lit(0.0)
    for name, (_, weight) in functions.items():
        total = total + F.col(name) * weight
    return scored.withColumn("reward", total)


def mean_rewards(scored: DataFrame, by: tuple[str, ...] = (), names: tuple[str, ...] = ("correct", "answered", "said_yes")) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(name).alias(name) for name in (*names, "reward")])
