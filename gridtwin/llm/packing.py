"""Best-fit packing of documents into sequences, with lower bounds that certify how good it is."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtwin.llm.arrays import text_blocks
from gridtwin.llm.fragments import encoder
from gridtwin.session import cut

PIECES_PER_PART = 1 << 14
PIECE_BYTES = 1 << 20  # texts encoded together; the arrays on the way take some 60 bytes a byte
MOST_ROUNDS = 40  # each joins twice as many parts


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every text's ids and ``end_id``, cut only where longer than ``capacity``.

    Null texts count as empty and give one piece holding ``end_id`` alone.
    """

    def run(batches):
        coder = encoder(path)
        for data, offsets, _, rows in text_blocks(batches, PIECE_BYTES):
            found, before = coder.encode(data, offsets)
            raw = np.insert(found, before[1:], np.uint32(end_id)).astype("<u4").tobytes()
            counts = np.diff(before) + 1
            begins = np.cumsum(counts) - counts
            cuts = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(capacity, counts[doc] - start)
            at = begins[doc] + start
            digests = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.record_batch(
                [
                    rows.column(0).take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(digests, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item by best-fit decreasing, and the number of bins.

    ``open_rooms`` has bit r set while some bin has exactly r places left, so
    the tightest bin that still fits is found by one shift.
    """
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, bin_ = capacity, used
            used += 1
        bins[i], offsets[i] = bin_, capacity - room
        left = room - size
        if left:
            if not rooms[left]:
                open_rooms |= 1 << left
            rooms[left].append(bin_)
    return bins, offsets, used


def least_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing needs fewer bins than this, by dual feasible functions.

    Two families are tried at every parameter: items above ``capacity - e``
    count as whole bins and those below e as nothing; and, for k up to 20, an
    item x counts as x where (k+1)x is a multiple of the capacity, else as
    floor((k+1)x / capacity) / k.
    """
    if not len(lengths):
        return 0
    order = np.argsort(lengths)
    x, n = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    number = np.concatenate([[0], np.cumsum(n)])
    mass = np.concatenate([[0], np.cumsum(n * x)])
    e = np.arange(0, capacity // 2 + 1)
    whole = np.searchsorted(x, capacity - e, "right")
    small = np.searchsorted(x, e, "left")
    best = int(np.max(number[-1] - number[whole] - (-(mass[whole] - mass[small]) // capacity)))
    for k in range(1, 21):
        steps = (k + 1) * x
        scaled = np.where(steps % capacity == 0, x * k, steps // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, int(-(-int((scaled * n).sum()) // (k * capacity))))
    return best


def pack(cut_pieces: DataFrame, capacity: int, per_part: int = PIECES_PER_PART, rounds: int = MOST_ROUNDS) -> DataFrame:
    """Add ``sequence_id, offset`` (and ``part``, ``part_bound``, ``total_bound``) to pieces so that few sequences are used.

    Pieces are dealt evenly to parts, each packed best-fit decreasing in one
    task and certified by a lower bound of its own. Parts whose count exceeds
    the bound send the pieces of their unfilled sequences to an exchange: those
    of neighbouring parts are packed together, and the new packing is taken where
    it saves sequences. Full sequences never move again. This goes on, each
    time with twice as many parts in a group, until every part meets its bound or
    no two groups are left; a group whose unfilled sequences hold more than
    four parts' pieces is done, so that no task ever gets more.
    ``part_bound`` is the bound of the part that packed the piece last, ``total_bound``
    the bound of all pieces together: no packing has fewer sequences. Pieces are dealt by
    their place in the written table, so equal rows spread over all parts.
    """
    total = cut_pieces.count()
    parts = max(1, -(-total // per_part))
    schema = (
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, pool bigint, "
        "part bigint, bin bigint, offset bigint, load bigint, gap bigint, part_bound bigint"
    )
    stable = ["doc_id", "piece", "start", "ids_crc32"]

    def settle(group: pd.DataFrame, part: int) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        group["bin"], group["offset"], used = best_fit(lengths, capacity)
        sizes, counts = np.unique(lengths, return_counts=True)
        group["part"], group["part_bound"] = part, least_bins(sizes, counts, capacity)
        group["gap"] = used - group["part_bound"]
        group["load"] = group.groupby("bin")["length"].transform("sum")
        return group

    def first(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(stable, ignore_index=True)
        return settle(group, int(group["pool"].iloc[0]))

    def exchange(turn: int):
        def together(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(stable, ignore_index=True)
            group["pool"] //= 2
            before = len(group[["part", "bin"]].drop_duplicates())
            new = settle(group.copy(), (turn << 32) + int(group["pool"].iloc[0]))
            return new if new["bin"].max() + 1 < before else group

        return together

    counted = cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most one row a length
    total_bound = least_bins(np.array([r["length"] for r in counted]), np.array([r["n"] for r in counted]), capacity)
    dealt = cut_pieces.withColumn("pool", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    packed = cut(dealt.groupBy("pool").applyInPandas(first, schema), "packed")
    open_bins = (F.col("gap") > 0) & (F.col("load") < capacity)
    fixed: list[DataFrame] = []
    for turn in range(1, rounds + 1):
        if packed.where(open_bins).select("pool").distinct().limit(2).count() < 2:
            break

        pairs = F.shiftright("pool", 1).alias("_pair")
        open_rows = packed.where(open_bins).groupBy(pairs).agg(F.count("*").alias("_rows"))
        tagged = packed.withColumn("_pair", pairs).join(open_rows, "_pair", "left")
        moving = open_bins & (F.col("_rows") <= 4 * per_part)
        fixed.append(tagged.where(~moving).drop("_pair", "_rows"))
        packed = cut(tagged.where(moving).drop("_pair", "_rows").groupBy(pairs).applyInPandas(exchange(turn), schema), "packed")
    for done in fixed:
        packed = packed.unionByName(done)
    return packed.select(
        *stable[:3],
        "length",
        "ids_crc32",
        (F.shiftleft("part", 24) + F.col("bin")).alias("sequence_id"),
        "offset",
        "part",
        "part_bound",
        F.lit(total_bound).cast("bigint").alias("total_bound"),
    )
