"""Kernels that write words of open passages as bit boards and draw mazes as text, many grids at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa

from gridtwin.operators.lattice import Lattice, cells_of_rows, numbers, ragged, row_blocks

WORD = 50  # cells in a word of open sides


def _column(block: pa.RecordBatch, name: str) -> pa.Array:
    return block.column(block.schema.get_field_index(name))


def _entries(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each entry of an array column, and all entries one after another."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten()


def _field(entries: pa.Array, name: str, empty: int = 0) -> np.ndarray:
    return entries.field(name).cast(pa.int64()).fill_null(empty).to_numpy(zero_copy_only=False)


def _bits(grids: Lattice, owner: np.ndarray, word: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each cell of the block whether its bit is set in the words given for its grid."""
    each = np.repeat(np.arange(len(word)), WORD)
    place = np.tile(np.arange(WORD), len(word))
    node = word[each] * WORD + place
    here = ((bits[each] >> place) & 1 == 1) & (word[each] >= 0) & (node < grids.count[owner[each]])
    found = np.zeros(grids.size, bool)
    found[grids.base[owner[each[here]]] + node[here]] = True
    return found


# --- boards ---------------------------------------------------------------------------
def boards_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``width, height, ..., _words`` to the columns before the last, ``words``, ``right`` and ``down`` (bit boards)."""
    for block in row_blocks(batches, cells_of_rows):
        width, height = numbers(block, "width"), numbers(block, "height")
        grids = Lattice(width, height)
        owner, entries = _entries(_column(block, "_words"))
        word = _field(entries, "_word", -1)
        of_row = -(-np.maximum(width, 0) // WORD)
        size = np.where(grids.count > 0, of_row * np.maximum(height, 0), 0)
        at = (np.cumsum(size) - size)[grids.grid] + grids.y * of_row[grids.grid] + grids.x // WORD
        absent = _column(block, "width").is_null().to_numpy(zero_copy_only=False) | _column(block, "height").is_null().to_numpy(zero_copy_only=False)
        sides = []
        for side in ("r", "d"):
            board = np.zeros(int(size.sum()), np.int64)
            if grids.size:
                firsts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                set_ = _bits(grids, owner, word, _field(entries, side)).astype(np.int64) << (grids.x % WORD)
                board[at[firsts]] = np.bitwise_or.reduceat(set_, firsts)
            sides.append(ragged(board, size, pa.int64(), absent))
        words = pa.array(of_row, mask=_column(block, "width").is_null().to_numpy(zero_copy_only=False)).cast(pa.int32())
        yield pa.RecordBatch.from_arrays([*block.columns[:-1], words, *sides], names=[*block.schema.names[:-1], "words", "right", "down"])


# --- drawings -------------------------------------------------------------------------
FLOOR, WALL, START, GOAL, MARK = range(5)


def drawn(signs: tuple[str, str, str, str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``graph_id, width, height, start, goal, _others, _words, _path`` to the lines ``graph_id, line, text``.

    A graph of several grids has all of them in ``_others`` and is drawn by itself.
    """
    sign = [s.encode() for s in signs]
    source = np.frombuffer(b"".join(sign), np.uint8)
    length = np.array([len(s) for s in sign], np.int64)
    begin = np.cumsum(length) - length

    def lines(block: pa.RecordBatch) -> pa.RecordBatch:
        width, height = numbers(block, "width"), numbers(block, "height")
        grids = Lattice(width, height)
        here = np.flatnonzero(grids.count > 0)
        # every grid is drawn as 2h+1 rows of 2w+1 signs, one after another
        across, rows = 2 * width + 1, np.where(grids.count > 0, 2 * height + 1, 0)
        canvas_base = np.cumsum(across * rows) - across * rows
        canvas = np.full(int((across * rows).sum()), WALL, np.int8)
        wide = across[grids.grid]
        spot = canvas_base[grids.grid] + (2 * grids.y + 1) * wide + 2 * grids.x + 1
        owner, entries = _entries(_column(block, "_words"))
        step, word, bits = _field(entries, "step"), _field(entries, "_word", -1), _field(entries, "bits")
        open_ = lambda of: _bits(grids, owner[of], word[of], bits[of])
        right, down = open_(step == 1), open_(step == width[owner])
        on, to_right, to_down = _marks(block, grids)
        canvas[spot] = np.where(on, MARK, FLOOR)
        for name, kind in (("start", START), ("goal", GOAL)):
            node = numbers(block, name, -1)
            there = (node >= 0) & (node < grids.count)
            canvas[spot[(grids.base + node)[there]]] = kind
        canvas[(spot + 1)[right]] = np.where(to_right, MARK, FLOOR)[right]
        canvas[(spot + wide)[down]] = np.where(to_down, MARK, FLOOR)[down]
        size = length[canvas]
        total = np.cumsum(size)
        text = source[np.repeat(begin[canvas] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
        graph = np.repeat(here, rows[here])
        line = np.arange(len(graph)) - np.repeat((np.cumsum(rows) - rows)[here], rows[here])
        ends = np.append(0, total[np.cumsum(across[graph]) - 1]) if len(graph) else np.zeros(1)
        texts = pa.StringArray.from_buffers(len(graph), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text))
        return pa.record_batch([_column(block, "graph_id").take(pa.array(graph)), pa.array(line, pa.int32()), texts], names=["graph_id", "line", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, cells_of_rows):
            lone = _column(block, "_others").is_null().to_numpy(zero_copy_only=False) & ~_repeated(_column(block, "_path"))
            yield lines(block.filter(pa.array(lone)))
            for row in block.filter(pa.array(~lone)).to_pylist():
                found = list(_lines_of_several(row, signs))
                yield pa.record_batch(
                    [
                        pa.array([row["graph_id"]] * len(found), block.schema.field("graph_id").type),
                        pa.array([number for number, _ in found], pa.int32()),
                        pa.array([text for _, text in found], pa.string()),
                    ],
                    names=["graph_id", "line", "text"],
                )

    return run


def _in_order(path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and node (-1 for none) of all steps, by row and number."""
    owner, entries = _entries(path)
    k, node = _field(entries, "k", -1), _field(entries, "node", -1)
    order = np.lexsort((k, owner))
    return owner[order], k[order], node[order]


def _repeated(path: pa.Array) -> np.ndarray:
    """Rows whose path has a number twice or a step without number."""
    owner, k, _ = _in_order(path)
    again = np.append(False, (owner[1:] == owner[:-1]) & (k[1:] == k[:-1]))
    found = np.zeros(len(path), bool)
    found[owner[again | (k < 0)]] = True
    return found


def _marks(block: pa.RecordBatch, grids: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell whether its path visits it, and goes on to its right or below."""
    owner, k, node = _in_order(_column(block, "_path"))
    on, to_right, to_down = (np.zeros(grids.size, bool) for _ in range(3))
    inside = (node >= 0) & (node < grids.count[owner])
    on[(grids.base[owner] + node)[inside]] = True
    follows = np.flatnonzero((owner[1:] == owner[:-1]) & (k[1:] == k[:-1] + 1) & (node[1:] >= 0) & (node[:-1] >= 0))
    own, low, high = owner[follows], np.minimum(node[follows], node[follows + 1]), np.maximum(node[follows], node[follows + 1])
    low_inside = low < grids.count[own]
    width = numbers(block, "width")[own]
    for marks, step in ((to_right, 1), (to_down, width)):
        marks[(grids.base[own] + low)[low_inside & (high == low + step)]] = True
    return on, to_right, to_down


def _lines_of_several(row: dict, signs: tuple[str, str, str, str, str]) -> Iterator[tuple[int, str]]:
    """Lines of all grids of one graph: those of equal width share their lines, cell by cell."""
    floor, wall, start, goal, mark = signs
    grids = row["_others"] or [{name: row[name] for name in ("width", "height", "start", "goal")}]
    grids = [g for g in grids if g["width"] and g["height"] and g["width"] > 0 and g["height"] > 0]
    open_ = {(w["step"], w["_word"] * WORD + i) for w in row["_words"] or [] for i in range(WORD) if w["bits"] >> i & 1}
    path = row["_path"] or []
    after: dict = {}
    for step in path:
        if step["k"] is not None:
            after.setdefault(step["k"], []).append(step["node"])
    on, met = {step["node"] for step in path}, set()
    for step in path:
        for other in after.get(step["k"] + 1, []) if step["k"] is not None else []:
            met |= {(step["node"], other), (other, step["node"])}
    widths = {g["width"] for g in grids}
    for width, same in groupby(sorted(grids, key=lambda g: g["width"]), key=lambda g: g["width"]):
        of_row: dict[int, list[tuple[int, str, str]]] = {}
        for g in same:
            for node in range(width * g["height"]):
                inside = goal if node == g["goal"] else start if node == g["start"] else mark if node in on else floor
                passage = lambda step, there: wall if (step, node) not in open_ else mark if there else floor  # noqa: B023, E731
                right = passage(1, (node, node + 1) in met)
                down = passage(width, any((node, node + w) in met for w in widths))
                of_row.setdefault(node // width, []).append((node % width, inside + right, down + wall))
        yield 0, wall * (2 * width + 1)
        for y, cells in sorted(of_row.items()):
            cells.sort()
            yield 2 * y + 1, wall + "".join(middle for _, middle, _ in cells)
            yield 2 * y + 2, wall + "".join(below for _, _, below in cells)
