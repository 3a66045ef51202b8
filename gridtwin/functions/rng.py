"""Seeded randomness as column expressions.

The generator keeps a counter as its state, so its k-th number is a pure
function of (seed, k): no row order, partition layout or retry can change it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtwin.functions.text import strip

# Fixed values of the generator and of the 32-bit FNV-1a hash.
STEP = 0x6D2B79F5
TWO32 = 4294967296
MASK = 0xFFFFFFFF
FNV_BASIS = 0x811C9DC5
FNV_PRIME = 0x01000193


def _long(value: Column | int) -> Column:
    return F.lit(value).cast("bigint") if isinstance(value, int) else value.cast("bigint")


def _signed(value: Column) -> Column:
    """The low 32 bits read as a signed number, so products stay inside 64 bits."""
    return F.shiftright(F.shiftleft(value, 32), 32)


def _times(left: Column, right: Column) -> Column:
    return (_signed(left) * _signed(right)).bitwiseAND(F.lit(MASK))


def draw(seed: Column | int, k: Column | int = 0) -> Column:
    """The k-th uniform number in [0, 1) of ``seed`` (both taken modulo 2^32)."""
    counter = (_long(k).bitwiseAND(F.lit(MASK)) + 1) * F.lit(STEP)
    state = (_long(seed).bitwiseAND(F.lit(MASK)) + counter.bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))
    mixed = _times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    again = _times(mixed.bitwiseXOR(F.shiftright(mixed, 7)), mixed.bitwiseOR(F.lit(61)))
    mixed = mixed.bitwiseXOR((mixed + again).bitwiseAND(F.lit(MASK)))
    return mixed.bitwiseXOR(F.shiftright(mixed, 14)) / F.lit(float(TWO32))


def draw_inside(seed: Column, k: Column) -> Column:
    """:func:`draw` for use inside functions of arrays, where Spark does not share common subexpressions."""

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def scrambled(state: Column) -> Column:
        return _times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))

    def finished(mixed: Column) -> Column:
        again = _times(mixed.bitwiseXOR(F.shiftright(mixed, 7)), mixed.bitwiseOR(F.lit(61)))
        return let(
            mixed.bitwiseXOR((mixed + again).bitwiseAND(F.lit(MASK))),
            lambda m: m.bitwiseXOR(F.shiftright(m, 14)) / F.lit(float(TWO32)),
        )

    counter = (_long(k).bitwiseAND(F.lit(MASK)) + 1) * F.lit(STEP)
    state = (_long(seed).bitwiseAND(F.lit(MASK)) + counter.bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))
    return let(state, lambda s: let(scrambled(s), finished))


def draws(seed: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """:func:`draw` of whole numbers in numpy."""
    low = lambda value: (np.asarray(value, np.int64) & MASK).astype(np.uint32)
    state = low(seed) + (low(k) + np.uint32(1)) * np.uint32(STEP)
    mixed = (state ^ (state >> np.uint32(15))) * (state | np.uint32(1))
    again = (mixed ^ (mixed >> np.uint32(7))) * (mixed | np.uint32(61))
    mixed = mixed ^ (mixed + again)
    return (mixed ^ (mixed >> np.uint32(14))) / float(TWO32)


def draw_int(seed: Column | int, k: Column | int, n: Column | int) -> Column:
    """The k-th draw of ``seed`` as an integer in [0, n)."""
    return F.floor(draw(seed, k) * n).cast("int")


def coin(seed: Column | int, k: Column | int = 0) -> Column:
    """A fair yes/no label."""
    return draw(seed, k) < 0.5


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    # one Latin-1 character per byte, whose code point is the byte
    octets = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")

    def absorb(acc: Column, octet: Column) -> Column:
        return (acc.bitwiseXOR(F.ascii(octet).cast("bigint")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK))

    basis = F.lit(FNV_BASIS).cast("bigint")
    return F.when(F.length(text) == 0, basis).otherwise(F.aggregate(octets, basis, absorb))


def fnv1a32_of(texts: pa.Array) -> np.ndarray:
    """:func:`fnv1a32` of an Arrow array in numpy, one byte of all texts at a time; what a null gives means nothing."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    octets = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    # longest first, so those with a byte at a place lead
    order = np.argsort(-size, kind="stable")
    start = ends[:-1][order]
    longer = len(size) - np.cumsum(np.bincount(size)) if len(size) else []
    state = np.full(len(size), FNV_BASIS, np.uint32)
    for place, n in enumerate(longer):
        state[:n] = (state[:n] ^ octets[start[:n] + place]) * np.uint32(FNV_PRIME)
    out = np.empty_like(state)
    out[order] = state
    return out


def fnv1a32_of_rows(text: Column) -> Column:
    """:func:`fnv1a32` of a column of many rows: in numpy, a batch at a time."""

    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(fnv1a32_of(texts).astype(np.int64), mask=~texts.is_valid().to_numpy(zero_copy_only=False))

    return F.arrow_udf(hashed, "bigint")(text)


def seed_from_number(value: Column) -> Column:
    """Truncate, then take modulo 2^32 (never negative); NaN hashes its name."""
    whole = F.pmod(F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)), F.lit(TWO32))
    return F.when(F.isnan(value.cast("double")), fnv1a32(F.lit("NaN"))).otherwise(whole).cast("bigint")


def seed_from_text(value: Column) -> Column:
    """Digit strings keep their exact value modulo 2^32, anything else is hashed."""
    text = strip(F.coalesce(value, F.lit("")))
    digits = F.regexp_extract_all(text, F.lit(r"(\d)"), F.lit(1))
    magnitude = F.aggregate(
        digits,
        F.lit(0).cast("bigint"),
        lambda acc, digit: F.pmod(acc * 10 + digit.cast("bigint"), F.lit(TWO32)),
    )
    number = F.when(text.startswith("-"), F.pmod(F.lit(TWO32) - magnitude, F.lit(TWO32))).otherwise(magnitude)
    return F.when(text.rlike(r"\A-?[0-9]+\z"), number).otherwise(fnv1a32(text))


def seed_from_boolean(value: Column) -> Column:
    """Booleans count as the words true and false."""
    return fnv1a32(F.when(value, F.lit("true")).otherwise(F.lit("false")))


def trial_seed(session: Column | str, index: Column) -> Column:
    """Seed of trial ``index`` in a session: the text ``session:index`` normalised."""
    session = F.lit(session) if isinstance(session, str) else session
    return seed_from_text(F.concat_ws(":", session, index.cast("string")))
