"""Kernel of :func:`gridtwin.operators.edits.apply_edits`: texts of many edited levels put together from pieces of the levels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridtwin.functions import cells as C
from gridtwin.functions.text import SPACES

MOST_BYTES = 1 << 22  # of the texts that are put together at once


@lru_cache(1 << 10)
def _laid_out(text: str) -> tuple[bytes, np.ndarray, int]:
    """Level text as :func:`cells.grid_text` writes it, where its cells begin and end, and its width."""
    lines = [line for line in (line.strip(SPACES) for line in text.split("\n")) if line]
    rows = [[cell for cell in line.split(" ") if cell] for line in lines]
    width = max(map(len, rows), default=0)
    rows = [[*row, *[C.LAYER] * (width - len(row))] for row in rows]
    size = np.array([len(cell.encode()) for row in rows for cell in row], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    return ("\n".join(" ".join(row) for row in rows) + "\n").encode(), np.stack([begin, begin + size]), width


def edited_texts(text: pa.Array, changes: pa.Array) -> pa.Array:
    """Each level ``text`` after its ``changes``: of several at one cell the last one counts, one without ``after`` changes nothing."""
    coded = text.dictionary_encode()
    known = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)
    laid = [_laid_out(level) for level in coded.dictionary.to_pylist()] or [_laid_out("")]
    flat = changes.flatten()
    numbers = lambda name: flat.field(name).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    after = flat.field("after").cast(pa.large_string())
    edit = np.repeat(np.arange(len(text)), changes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    x, y, level = numbers("x"), numbers("y"), known[edit]
    # texts and cells of all levels, one level after another
    bodies = np.array([len(body) for body, _, _ in laid], np.int64)
    base = np.cumsum(bodies) - bodies
    cells = np.array([ends.shape[1] for _, ends, _ in laid], np.int64)
    first = np.cumsum(cells) - cells
    begin, end = (np.concatenate([ends[i] for _, ends, _ in laid]) + np.repeat(base, cells) for i in (0, 1))
    width = np.array([w for _, _, w in laid], np.int64)[level]
    inside = (x >= 0) & (y >= 0) & (x < width) & (y * width < cells[level]) & flat.is_valid().to_numpy(zero_copy_only=False)
    cell = first[level] + y * width + x
    order = np.flatnonzero(inside)
    order = order[np.lexsort((order, cell[order], edit[order]))]
    if len(order):
        order = order[np.append((np.diff(edit[order]) != 0) | (np.diff(cell[order]) != 0), True)]
    order = order[after.is_valid().to_numpy(zero_copy_only=False)[order]]
    edit, cell = edit[order], cell[order]
    # pieces of an edit: text before the first change, new cell, text up to the next, ..., the rest
    of_edit = np.bincount(edit, minlength=len(text))
    last = np.arange(len(text)) + 2 * np.cumsum(of_edit)
    before, new = edit + 2 * np.arange(len(edit)), edit + 2 * np.arange(len(edit)) + 1
    start = np.zeros(len(text) + 2 * len(edit), np.int64)
    stop = np.zeros_like(start)
    ends = np.frombuffer(after.buffers()[1], np.int64)[after.offset : after.offset + len(after) + 1]
    source = np.concatenate([np.frombuffer(b"".join(body for body, _, _ in laid), np.uint8), np.frombuffer(after.buffers()[2] or b"", np.uint8)])
    start[last - 2 * of_edit], stop[last] = base[known], (base + bodies)[known]
    stop[before], start[new + 1] = begin[cell], end[cell]
    start[new], stop[new] = int(bodies.sum()) + ends[order], int(bodies.sum()) + ends[order + 1]
    size = stop - start
    total = np.cumsum(size)
    out = source[np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
    offsets = np.append(0, total[last]).astype(np.int32)
    made = pa.StringArray.from_buffers(len(text), pa.py_buffer(offsets), pa.py_buffer(out))
    return pc.if_else(text.is_valid(), made, pa.scalar(None, pa.string()))


def edited_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``..., _changes, _text`` to the columns before them and ``level``."""
    for taken in batches:
        kept = taken.num_columns - 2
        text = taken.column(kept + 1)
        before = np.cumsum(np.append(0, pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False)))
        at = 0
        while at < taken.num_rows:
            to = max(int(np.searchsorted(before, before[at] + MOST_BYTES, "right")) - 1, at + 1)
            part = taken.slice(at, to - at)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:kept], edited_texts(part.column(kept + 1), part.column(kept))], names=[*taken.schema.names[:kept], "level"]
            )
            at = to
