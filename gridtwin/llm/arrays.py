"""Texts as flat byte arrays, and the word and hash arithmetic the operators share.

Everything works on one bounded block of documents at a time, so memory
follows the block and the longest single document, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 3 << 20
BLOCK_ROWS = 1_000
LANE = 8
LANE_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(LANE + 1)], np.uint64)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LONG_RUN = 64


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_blocks(batches, limit: int = BLOCK_BYTES, most_rows: int = BLOCK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(bytes, offsets, null mask, rows) of runs of documents holding about ``limit`` bytes each.

    Column ``text`` may hold nulls; they count as empty. A document larger
    than the limit is a block of its own, always whole. A block has at most
    ``most_rows`` documents, however large the session's Arrow batches are.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        nulls = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
        filled = column.fill_null("").cast(pa.large_string())
        if not len(filled):
            continue
        offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
        data = filled.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(filled):
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), at + most_rows, len(filled))
            yield (
                whole[offsets[at] : offsets[to]],
                offsets[at : to + 1] - offsets[at],
                nulls[at:to],
                batch.slice(at, to - at),
            )
            at = to


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every run of solid (by default non-space) bytes, and the first word number of each document."""
    solid = ~SPACE[data] if solid is None else solid
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = solid[firsts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    lasts = firsts[1:] - 1
    ends[lasts] = solid[lasts]
    begin = np.flatnonzero(starts)
    length = np.flatnonzero(ends) + 1 - begin
    return begin, length, np.searchsorted(begin, offsets)


def lanes_of(data: np.ndarray) -> np.ndarray:
    """For every position the 8 bytes from there on as one number (zeros past the end); a view, one byte apart."""
    padded = np.concatenate([data, np.zeros(LANE, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def run_hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run ``data[begin : begin + length]``.

    The run is read in lanes of 8 bytes; each lane is scrambled together with its
    place and the seed, so the sum over lanes has no algebra that regular texts
    could cancel. Runs of up to 8 bytes and one length never collide. Where results must be exact,
    :func:`distinct_runs` and :func:`same_runs` compare the bytes as well.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = np.asarray(length, np.int64)
    lanes = lanes_of(data)
    keys = mix(np.arange(-(-int(length.max()) // LANE) + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed))
    out = mix((lanes[begin] & LANE_MASKS[np.minimum(length, LANE)]) ^ keys[0])
    more = np.flatnonzero(length > LANE)
    if len(more):
        count = (length[more] - 1) // LANE  # lanes after the first
        at = np.cumsum(count) - count
        place = np.arange(int(count.sum()), dtype=np.int64) - np.repeat(at, count) + 1
        left = np.repeat(length[more], count) - LANE * place
        values = lanes[np.repeat(begin[more], count) + LANE * place] & LANE_MASKS[np.minimum(left, LANE)]
        out[more] += np.add.reduceat(mix(values ^ keys[place]), at)
    return mix(out ^ (length.astype(np.uint64) * GOLDEN))


def same_runs(data: np.ndarray, begin: np.ndarray, other: np.ndarray, other_begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each run of ``data`` has the bytes of the run of the same length in ``other``."""
    same = np.ones(len(begin), bool)
    for i in np.flatnonzero(length > LONG_RUN).tolist():
        a, b, n = int(begin[i]), int(other_begin[i]), int(length[i])
        same[i] = data[a : a + n].tobytes() == other[b : b + n].tobytes()
    left, right = lanes_of(data), lanes_of(other)
    live = np.flatnonzero((length > 0) & (length <= LONG_RUN))
    done = 0
    while len(live):
        mask = LANE_MASKS[np.minimum(length[live] - done, LANE)]
        same[live] &= (left[begin[live] + done] & mask) == (right[other_begin[live] + done] & mask)
        done += LANE
        live = live[same[live] & (length[live] > done)]
    return same


def distinct_runs(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of one run of each different content, and for every run the place of its content among those.

    Hashes only bring equal runs together: the bytes are compared, and a run
    whose hash is shared by other bytes is a content of its own.
    """
    _, first, inverse = np.unique(run_hashes(data, begin, length), return_index=True, return_inverse=True)
    model = first[inverse]
    odd = np.flatnonzero(length != length[model])
    equal = np.flatnonzero((length == length[model]) & (model != np.arange(len(begin))))
    odd = np.concatenate([odd, equal[~same_runs(data, begin[equal], data, begin[model[equal]], length[equal])]])
    if len(odd):
        inverse = inverse.copy()
        known: dict[bytes, int] = {}
        extra = []
        for i in odd.tolist():
            raw = data[begin[i] : begin[i] + length[i]].tobytes()
            if raw not in known:
                known[raw] = len(first) + len(extra)
                extra.append(i)
            inverse[i] = known[raw]
        first = np.concatenate([first, extra]).astype(np.int64)
    return first, inverse


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of all runs, one after another."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(np.asarray(begin, np.int64) - (np.cumsum(length) - length), length)
