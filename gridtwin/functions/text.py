"""Whitespace handling shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace of every kind, as characters and as a pattern.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"


def strip(text: Column) -> Column:
    """Remove surrounding whitespace of every kind (plain ``trim`` only removes blanks)."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Every run of whitespace becomes one blank."""
    return F.regexp_replace(text, rf"{SPACE}+", " ")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]
