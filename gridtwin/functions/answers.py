"""Reading yes/no answers out of replies and judging them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtwin.functions.text import SPACE, strip

# Fixed pattern: the answer line a reply is asked to end with.
ANSWER_LINE = rf"(?i)ANSWER:{SPACE}*(YES|NO)(?:\z|[^\p{{L}}\p{{N}}_])"


def _has_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?i)(?:\A|[^\p{{L}}\p{{N}}_]){word}(?:\z|[^\p{{L}}\p{{N}}_])")


def parse_answer(text: Column) -> Column:
    """``yes``, ``no`` or ``unparsed``.

    The last answer line wins; without one, the last line of the reply counts
    if it holds just one of the two words. Null reads as an empty reply.
    """
    reply = F.coalesce(text, F.lit(""))
    stated = F.lower(F.try_element_at(F.regexp_extract_all(reply, F.lit(ANSWER_LINE), F.lit(1)), F.lit(-1)))
    last_line = F.element_at(F.split(strip(reply), "\n"), -1)
    says_yes, says_no = _has_word(last_line, "yes"), _has_word(last_line, "no")
    return (
        F.when(stated.isNotNull(), stated)
        .when(says_yes & ~says_no, F.lit("yes"))
        .when(says_no & ~says_yes, F.lit("no"))
        .otherwise(F.lit("unparsed"))
    )


def outcome(reply: Column, stop_reason: Column, error: Column) -> Column:
    """``error`` before ``refused`` before the parsed answer."""
    return (
        F.when(error.isNotNull(), F.lit("error"))
        .when(F.coalesce(stop_reason, F.lit("")) == "refusal", F.lit("refused"))
        .otherwise(parse_answer(reply))
    )


def answered(answer: Column) -> Column:
    """Only a plain yes or no is an answer; null is none."""
    return F.coalesce(answer.isin("yes", "no"), F.lit(False))


def is_correct(answer: Column, truth: Column) -> Column:
    """True only for a yes/no that agrees with the label."""
    return answered(answer) & F.coalesce((answer == "yes") == truth, F.lit(False))


__all__ = ["ANSWER_LINE", "answered", "is_correct", "outcome", "parse_answer"]
