"""Cells of a room: stacks of tokens, bottom first, written ``.+#+p``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtwin.functions.text import bind, strip

# Fixed values of the level text format.
LAYER = "+"
FLOOR, WALL, ICE, AIR, GEM, PLAYER = ".", "#", "i", "", "G", "p"
LIFT_LOW, LIFT_HIGH = "l", "L"
BOX_TOKEN = r"^(M[0-9]+|b|f)$"
SLOPE_TOKEN = r"^S([rlud])(#|O)?$"
OPPOSITE = {"r": "l", "l": "r", "u": "d", "d": "u"}


def split_cell(cell: Column) -> Column:
    """Token stack of a cell; air is the empty token, and ``h`` stands for it too."""
    def tokens(text: Column) -> Column:
        parts = F.transform(F.split(text, r"\+"), lambda token: F.when(token == "h", F.lit("")).otherwise(strip(token)))
        return F.when((text == "") | (text == LAYER), F.array(F.lit(""))).otherwise(parts)

    return bind(strip(F.coalesce(cell, F.lit(""))), tokens)


def join_cell(tokens: Column) -> Column:
    """Cell of a token stack: air on top is dropped, lone air is ``+``."""
    def joined(stack: Column) -> Column:
        top = F.array_max(F.transform(stack, lambda token, i: F.when(token != "", i + 1).otherwise(F.lit(1))))
        return F.array_join(F.slice(stack, F.lit(1), top), LAYER)

    return bind(bind(tokens, joined), lambda cell: F.when(cell == "", F.lit(LAYER)).otherwise(cell))


def level_grid(text: Column) -> Column:
    """Level text as rows of cells; blank lines are dropped and short rows padded with air."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    rows = F.transform(lines, lambda line: F.filter(F.split(line, " "), lambda cell: cell != ""))

    def padded(grid: Column, width: Column) -> Column:
        return F.transform(grid, lambda row: F.concat(row, F.array_repeat(F.lit(LAYER), width - F.size(row))))

    widest = lambda grid: F.array_max(F.transform(grid, lambda row: F.size(row)))
    return bind(rows, lambda grid: bind(widest(grid), lambda width: padded(grid, width)))


def grid_text(grid: Column) -> Column:
    """Rows of cells as level text, every line ended."""
    return F.concat(F.array_join(F.transform(grid, lambda row: F.array_join(row, " ")), "\n"), F.lit("\n"))


def is_plain_floor(tokens: Column) -> Column:
    return (F.size(tokens) == 1) & (tokens[0] == FLOOR)


def is_ice(tokens: Column) -> Column:
    return (F.size(tokens) == 1) & (tokens[0] == ICE)


def is_air(tokens: Column) -> Column:
    return (F.size(tokens) == 1) & (tokens[0] == AIR)


def is_wall_stack(tokens: Column) -> Column:
    return (F.size(tokens) >= 2) & (F.element_at(tokens, -1) == WALL) & (tokens[0] == FLOOR)


def is_single_wall(tokens: Column) -> Column:
    return (F.size(tokens) == 2) & (tokens[0] == FLOOR) & (F.element_at(tokens, -1) == WALL)


def is_box(tokens: Column) -> Column:
    return (F.size(tokens) >= 2) & F.element_at(tokens, -1).rlike(BOX_TOKEN) & (tokens[0] == FLOOR)


def without_top(tokens: Column) -> Column:
    return F.slice(tokens, F.lit(1), F.size(tokens) - 1)


def without_first(tokens: Column, token: str) -> Column:
    """Stack with the lowest ``token`` taken out."""
    at = F.array_position(tokens, token).cast("int")
    return F.filter(tokens, lambda t, i: i != at - 1)


def replaced(tokens: Column, layer: Column, token: Column) -> Column:
    """Stack with the token at ``layer`` (from 0) exchanged."""
    return F.transform(tokens, lambda t, i: F.when(i == layer, token).otherwise(t))


def turned_slope(token: Column) -> Column:
    """Slope facing the other way."""
    facing = F.substring(token, 2, 1)
    other = facing
    for way, back in OPPOSITE.items():
        other = F.when(facing == way, F.lit(back)).otherwise(other)
    return F.concat(F.lit("S"), other, F.regexp_extract(token, SLOPE_TOKEN, 2))


def zoom_of(tallest: Column) -> Column:
    """Camera zoom for the tallest stack of a room."""
    return F.when(tallest <= 3, 1.4).when(tallest <= 5, 1.15).otherwise(0.9)
