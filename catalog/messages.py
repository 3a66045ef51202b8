"""Prompts, messages, replies and their rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs, sqltext as sql
from catalog.registry import query
from gridtwin.functions import prompts
from gridtwin.functions.answers import is_correct, outcome, parse_answer
from gridtwin.functions.rng import draw
from gridtwin.operators import messages, scoring

GAME = "Blockfall"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- prompts --------------------------------------------------------------------------
STYLES = """SELECT doc_id, text, n_chars, (['image', 'ascii', 'both'])[doc_id % 3 + 1] AS representation,
  (['sg', 'letters', 'dots'])[n_chars % 3 + 1] AS markers, n_chars % 2 = 0 AS grayscale,
  CASE WHEN doc_id % 5 < 2 THEN 'dark' ELSE 'light' END AS theme FROM documents"""
PICTURE = f"""'The image shows a maze. Walls are drawn as ' || (CASE theme WHEN 'dark' THEN {text(prompts.WALLS_DARK)}
  ELSE {text(prompts.WALLS_LIGHT)} END) || '. ' || (CASE WHEN markers = 'letters' THEN {text(prompts.MARKER_LETTERS)}
  WHEN markers = 'dots' THEN {text(prompts.MARKER_DOTS)} WHEN grayscale THEN {text(prompts.MARKER_GRAY)}
  ELSE {text(prompts.MARKER_COLOUR)} END) || ' '"""
MAZE_PROMPT = f"""((CASE representation WHEN 'ascii' THEN {text(prompts.MAZE_TEXT_FORM)} WHEN 'both' THEN {PICTURE} || {text(prompts.MAZE_BOTH_FORMS)}
  ELSE {PICTURE} END) || {text(prompts.MAZE_QUESTION)})"""


def styled(spark, sf_dir):
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        "n_chars",
        pick(("image", "ascii", "both"), F.col("doc_id") % 3).alias("representation"),
        pick(("sg", "letters", "dots"), F.col("n_chars") % 3).alias("markers"),
        (F.col("n_chars") % 2 == 0).alias("grayscale"),
        F.when(F.col("doc_id") % 5 < 2, "dark").otherwise("light").alias("theme"),
    )


def maze_prompt_column():
    return prompts.maze_prompt(F.col("representation"), F.col("markers"), F.col("grayscale"), F.col("theme"))


@query("maze_prompts", f"SELECT doc_id, {MAZE_PROMPT} AS prompt FROM ({STYLES})")
def maze_prompts(spark, sf_dir):
    return styled(spark, sf_dir).select("doc_id", maze_prompt_column().alias("prompt"))


ROOM_STYLES = f"""SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'top' ELSE 'perspective' END AS view, n_chars % 4 AS images,
  CASE WHEN doc_id % 2 = 0 THEN {text(prompts.LEGEND_INTRO)} || '"G" = gem, "W" = ' || lang || '.' ELSE '' END AS legend
  FROM ({STYLES.replace('text, n_chars,', 'text, n_chars, lang,')})"""
CAMERA = "(CASE view WHEN 'top' THEN ' from directly above' ELSE ' from the game camera' END)"
SHOWN = f"(CASE WHEN images > 1 THEN 'The ' || images || ' ' || {text(prompts.SEVERAL_IMAGES)} ELSE {text(prompts.ONE_IMAGE)} END)"
ROOM_PROMPT = f"""('This is one room from {GAME}, a 3D block-puzzle game. ' || {text(prompts.ROOM_RULES)} || ' ' ||
  (CASE representation WHEN 'ascii' THEN {text(prompts.ROOM_TEXT_FORM)} || legend || ' '
   WHEN 'both' THEN {SHOWN} || {CAMERA} || {text(prompts.ROOM_BOTH_FORMS)} || legend || ' ' ELSE {SHOWN} || {CAMERA} || '. ' END)
  || {text(prompts.ROOM_QUESTION)})"""


@query("room_prompts", f"SELECT doc_id, {ROOM_PROMPT} AS prompt FROM ({ROOM_STYLES})")
def room_prompts(spark, sf_dir):
    """Legends come from the document's language; several images change the sentence."""
    documents = styled(spark, sf_dir).join(
        inputs.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"
    )
    legend = F.when(
        F.col("doc_id") % 2 == 0, F.create_map(F.lit("W"), F.col("lang"), F.lit("G"), F.lit("gem"))
    )
    view = F.when(F.col("doc_id") % 4 == 0, "top").otherwise("perspective")
    prompt = prompts.room_prompt(GAME, F.col("representation"), legend, view, F.col("n_chars") % 4)
    return documents.select("doc_id", prompt.alias("prompt"))


CONTENT = f"""SELECT doc_id, representation, quality, {MAZE_PROMPT} ||
  (CASE WHEN representation IN ('ascii', 'both') THEN chr(10) || chr(10) || text ELSE '' END) AS body,
  CASE WHEN representation = 'ascii' THEN 0 ELSE n_chars % 3 END AS shown FROM ({STYLES}) LEFT JOIN labels USING (doc_id)"""


def contents(spark, sf_dir):
    number = (F.col("n_chars") % 3).cast("int")
    uri = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("theme", "UTF-8")))
    items = styled(spark, sf_dir).join(inputs.table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "representation",
        maze_prompt_column().alias("prompt"),
        F.array_repeat(uri, number).alias("images"),
        F.col("text").alias("ascii"),
        F.lit(None).cast("string").alias("json"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("solvable"),
        "theme",
    )
    return messages.message_content(items)


@query(
    "message_contents",
    f"""SELECT doc_id AS id, shown::INTEGER AS images, body AS text FROM ({CONTENT}) WHERE representation = 'ascii' OR shown > 0""",
)
def message_contents(spark, sf_dir):
    """Whole document texts in the text block."""
    ready, _ = contents(spark, sf_dir)
    return ready.select(
        "id",
        F.size(F.filter("content", lambda b: b["type"] == "image")).alias("images"),
        F.element_at("content", -1)["text"].alias("text"),
    )


@query(
    "rejected_contents",
    f"SELECT doc_id AS id, 'no image for this view' AS reason FROM ({CONTENT}) WHERE representation <> 'ascii' AND shown = 0",
)
def rejected_contents(spark, sf_dir):
    return contents(spark, sf_dir)[1]


@query(
    "evaluation_rows",
    f"""SELECT 'user' AS role, (shown + 1)::INTEGER AS blocks, CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END AS answer, doc_id AS id,
    coalesce(quality, 0) = 1 AS solvable, representation FROM ({CONTENT}) WHERE representation = 'ascii' OR shown > 0""",
)
def evaluation_rows(spark, sf_dir):
    rows = messages.evaluation_rows(contents(spark, sf_dir)[0], "representation")
    return rows.select(
        F.col("prompt")[0]["role"].alias("role"),
        F.size(F.col("prompt")[0]["content"]).alias("blocks"),
        "answer",
        "info.id",
        "info.solvable",
        "info.representation",
    )


# --- replies ------------------------------------------------------------------------------
LAST = "SELECT conv_id, arg_max(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id"
U = sql.draw("conv_id", "4")
CLOSED = f"""SELECT conv_id, truth, CASE WHEN u < 0.3 THEN reply || chr(10) || 'Answer:  yes' WHEN u < 0.6 THEN reply || chr(10) || 'ANSWER: NO. '
    WHEN u < 0.7 THEN 'ANSWER: no' || chr(10) || reply || ' ANSWER: YES' WHEN u < 0.8 THEN reply || chr(10) || 'I think yes' WHEN u < 0.9 THEN reply END AS reply,
  CASE WHEN u > 0.95 THEN 'timeout' END AS error, CASE WHEN u > 0.05 AND u < 0.1 THEN 'refusal' ELSE 'end_turn' END AS stop_reason
  FROM (SELECT *, {U} AS u, {sql.draw('conv_id', '5')} < 0.5 AS truth FROM ({LAST}))"""


def closed_replies(spark, sf_dir):
    """Last replies with a seeded closing line, error or refusal, so that every branch occurs."""
    u, reply = F.col("u"), F.col("reply")
    last = messages.last_replies(inputs.table(spark, sf_dir, "conversations"))
    return last.withColumn("u", draw(F.col("conv_id"), 4)).select(
        "conv_id",
        (draw(F.col("conv_id"), 5) < 0.5).alias("truth"),
        F.when(u < 0.3, F.concat(reply, F.lit("\nAnswer:  yes")))
        .when(u < 0.6, F.concat(reply, F.lit("\nANSWER: NO. ")))
        .when(u < 0.7, F.concat(F.lit("ANSWER: no\n"), reply, F.lit(" ANSWER: YES")))
        .when(u < 0.8, F.concat(reply, F.lit("\nI think yes")))
        .when(u < 0.9, reply)
        .alias("reply"),
        F.when(u > 0.95, "timeout").alias("error"),
        F.when((u > 0.05) & (u < 0.1), "refusal").otherwise("end_turn").alias("stop_reason"),
    )


@query("last_replies", LAST)
def last_replies(spark, sf_dir):
    return messages.last_replies(inputs.table(spark, sf_dir, "conversations"))


@query("parsed_turns", f"SELECT conv_id, turn, {sql.parse_answer('text')} AS answer FROM conversations")
def parsed_turns(spark, sf_dir):
    """Every turn as it is."""
    turns = inputs.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", parse_answer(F.col("text")).alias("answer"))


@query("parsed_documents", f"SELECT doc_id, {sql.parse_answer('text')} AS answer FROM documents")
def parsed_documents(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", parse_answer(F.col("text")).alias("answer"))


@query("parsed_replies", f"SELECT conv_id, {sql.parse_answer('reply')} AS answer FROM ({CLOSED})")
def parsed_replies(spark, sf_dir):
    return closed_replies(spark, sf_dir).select("conv_id", parse_answer(F.col("reply")).alias("answer"))


OUTCOMES = f"""SELECT conv_id, truth, answer, answer IN ('yes', 'no') AND (answer = 'yes') = truth AS correct FROM (SELECT *,
  CASE WHEN error IS NOT NULL THEN 'error' WHEN stop_reason = 'refusal' THEN 'refused' ELSE {sql.parse_answer('reply')} END AS answer FROM ({CLOSED}))"""


def outcomes_of(spark, sf_dir):
    judged = closed_replies(spark, sf_dir).withColumn("answer", outcome(F.col("reply"), F.col("stop_reason"), F.col("error")))
    return judged.select("conv_id", "truth", "answer", is_correct(F.col("answer"), F.col("truth")).alias("correct"))


@query("reply_outcomes", OUTCOMES)
def reply_outcomes(spark, sf_dir):
    return outcomes_of(spark, sf_dir)


@query(
    "summary_of_replies",
    sql.summary(f"SELECT truth AS solvable, answer, 0 AS input_tokens, 0 AS output_tokens FROM ({OUTCOMES})"),
)
def summary_of_replies(spark, sf_dir):
    from catalog.scoring import rounded

    return rounded(scoring.summarize(outcomes_of(spark, sf_dir).withColumnRenamed("truth", "solvable")))


REWARDED = f"""SELECT *, (said = answer)::INTEGER::DOUBLE AS correct, (said IN ('YES', 'NO'))::INTEGER::DOUBLE AS answered,
  (said = 'YES')::INTEGER::DOUBLE AS said_yes FROM (SELECT conv_id, CASE WHEN truth THEN 'YES' ELSE 'NO' END AS answer,
  upper({sql.parse_answer('reply')}) AS said FROM ({CLOSED}))"""


def scored_of(spark, sf_dir):
    expected = F.when(F.col("truth"), "YES").otherwise("NO")
    return messages.score(closed_replies(spark, sf_dir).withColumn("answer", expected))


@query("rewarded_replies", f"SELECT conv_id, answer, correct, answered, said_yes, correct AS reward FROM ({REWARDED})")
def rewarded_replies(spark, sf_dir):
    return scored_of(spark, sf_dir).select("conv_id", "answer", "correct", "answered", "said_yes", "reward")


@query(
    "mean_rewards_by_truth",
    f"""SELECT answer, count(*) AS n, round(avg(correct), 6) AS correct, round(avg(answered), 6) AS answered,
    round(avg(said_yes), 6) AS said_yes, round(avg(correct), 6) AS reward FROM ({REWARDED}) GROUP BY answer""",
)
def mean_rewards_by_truth(spark, sf_dir):
    from catalog.scoring import rounded

    means = messages.mean_rewards(scored_of(spark, sf_dir), ("answer",))
    return rounded(means, ("correct", "answered", "said_yes", "reward"))


@query(
    "known_tags",
    f"SELECT DISTINCT tag FROM (SELECT unnest(tags) AS tag FROM ({inputs.TRIAL_RESULTS}))",
)
def known_tags(spark, sf_dir):
    return scoring.explode_tags(inputs.trial_results(spark, sf_dir)).select("tag").distinct()
