"""Hard negatives by exact integer products in a residue number system.

Component matrices are reduced modulo several small primes and multiplied in
float32, where every partial sum stays below 2**24 and so is exact. The
products modulo the primes determine the signed scores (Chinese remainders, as
digits centred on zero). Anchors in blocks meet all rows in strips; a first
pass keeps each anchor's best rows of its own label, a second one the best rows of
other labels inside the window each of those opens.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtwin.llm.vectors import common_width
from gridtwin.session import cut

ANCHOR_BLOCK = 8_192
ANCHORS_AT_ONCE = 512
ROWS_AT_ONCE = 4_096
FIRST_ROWS = 64
STRIP_ROWS = 4_096
TASKS = 64
COLUMNS_AT_ONCE = 256
EXACT = 1 << 24
MOST_SCORE = 1 << 62
LOWEST = -(1 << 63) + 1


def primes_for(bound: int, columns: int) -> list[int]:
    """The largest odd primes whose centred residues multiply exactly in float32, enough for scores up to ``bound``."""
    most = 2 * math.isqrt(EXACT // max(1, min(columns, COLUMNS_AT_ONCE))) + 1
    out: list[int] = []
    for p in range(min(most, 1021), 2, -1):
        if p % 2 and all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            if math.prod(out) > 2 * bound:
                return out
    raise ValueError("components too large")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p as a number from -(p - 1) / 2 to (p - 1) / 2."""
    return x - p * ((x + (p - 1) // 2) // p)


class Residues:
    """Rows of integers modulo each prime, as float32 matrices."""

    def __init__(self, q: np.ndarray, primes: list[int]):
        self.primes, self.rows = primes, len(q)
        self.parts = [centred(q, p).astype(np.float32) for p in primes]

    def some(self, low: int, high: int) -> Residues:
        out = object.__new__(Residues)
        out.primes, out.rows, out.parts = self.primes, high - low, [m[low:high] for m in self.parts]
        return out


def products(a: Residues, b: Residues) -> np.ndarray:
    """[rows of a, rows of b] exact signed inner products."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(a.primes):
        x, y = a.parts[k], b.parts[k]
        total = np.zeros((a.rows, b.rows), np.int32)
        for at in range(0, x.shape[1], COLUMNS_AT_ONCE):
            total += centred((x[:, at : at + COLUMNS_AT_ONCE] @ y[:, at : at + COLUMNS_AT_ONCE].T).astype(np.int32), p)
        for q, digit in zip(a.primes, digits):
            total = centred((centred(total, p) - digit) * np.int32(pow(q, -1, p)), p)
        digits.append(centred(total, p))
    out = digits[-1].astype(np.int64)
    for p, digit in zip(a.primes[-2::-1], digits[-2::-1]):
        out *= p
        out += digit
    return out


class Best:
    """The ``keep`` best (score, id) of each of many groups; of equal scores the one offered first stays."""

    def __init__(self, groups: int, keep: int):
        self.score = np.full((groups, keep), LOWEST, np.int64)
        self.id = np.full((groups, keep), -1, np.int64)

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        keep = self.score.shape[1]
        touched, number = np.unique(group, return_inverse=True)
        number = np.concatenate([np.repeat(np.arange(len(touched)), keep), number])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((-score, number))  # stable: what was held or offered earlier comes first
        number, score, ids = number[order], score[order], ids[order]
        first = np.searchsorted(number, np.arange(len(touched)))
        place = first[:, None] + np.arange(keep)
        self.score[touched], self.id[touched] = score[place], ids[place]


class Anchors:
    """A block of anchors that rows stream past, ascending in id."""

    def __init__(self, ids, labels, q, primes, windows, keep):
        self.ids, self.labels, self.q = ids, labels, Residues(q, primes)
        self.windows = windows  # None: best of the same label; else (low, high) of [anchors, windows] scores
        self.best = Best(len(ids) * (1 if windows is None else windows[0].shape[1]), keep)
        self.step = FIRST_ROWS

    def meet(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            to = min(at + self.step, len(ids))
            self.step = min(2 * self.step, ROWS_AT_ONCE)  # few rows first: they raise the bar for the rest
            rows = Residues(q[at:to], self.q.primes)
            for low in range(0, len(self.ids), ANCHORS_AT_ONCE):
                self._meet(low, min(low + ANCHORS_AT_ONCE, len(self.ids)), ids[at:to], labels[at:to], rows)
            at = to

    def _meet(self, low: int, high: int, ids: np.ndarray, labels: np.ndarray, rows: Residues) -> None:
        scores = products(self.q.some(low, high), rows)
        same = self.labels[low:high, None] == labels[None, :]
        if self.windows is None:
            bar = self.best.score[low:high, -1]
            i, j = np.nonzero(same & (scores > bar[:, None]) & (self.ids[low:high, None] != ids[None, :]))
            self.best.offer(low + i, scores[i, j], ids[j])
            return
        count = self.windows[0].shape[1]
        for k in range(count):
            least, most = (w[low:high, k] for w in self.windows)
            bar = np.maximum(self.best.score[low * count + k : high * count : count, -1], least - 1)
            i, j = np.nonzero(~same & (scores > bar[:, None]) & (scores <= most[:, None]))
            self.best.offer((low + i) * count + k, scores[i, j], ids[j])


def prepared(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """``vec_id, label, raw``: one row a vector that takes part, components floor(scale * x) as 4-byte integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)

    def run(batches):
        for rows in batches:
            lists = rows.column(2)
            q = np.floor(scale * np.asarray(lists.flatten().cast(pa.float64())))
            ends = np.cumsum(np.asarray(lists.value_lengths()))
            begins = np.concatenate([[0], ends[:-1]])
            # larger components have no score that fits a long
            most = np.array([np.abs(q[a:b]).max(initial=0) for a, b in zip(begins, ends)])
            fits = (most < 2**31) & (most**2 * np.maximum(ends - begins, 1) < MOST_SCORE)
            data = np.where(np.abs(q) < 2**31, q, 0).astype("<i4").tobytes()
            raw = [data[4 * a : 4 * b] for a, b in zip(begins[fits].tolist(), ends[fits].tolist())]
            kept = pa.array(np.flatnonzero(fits))
            yield pa.record_batch(
                [rows.column(0).take(kept), rows.column(1).take(kept), pa.array(raw, pa.binary()), pa.array(most[fits].astype(np.int64))],
                names=["vec_id", "label", "raw", "peak"],
            )

    quantised = good.select("vec_id", label.cast("bigint").alias("label"), "embedding").mapInArrow(
        run, "vec_id bigint, label bigint, raw binary, peak bigint"
    )
    return quantised.groupBy("vec_id").agg(F.min(F.struct("label", "raw", "peak")).alias("_r")).select("vec_id", "_r.*")


def _best(anchors: DataFrame, rows: DataFrame, size: tuple[int, int], primes: list[int], keep: int) -> DataFrame:
    """``anchor_id, slot, score, other_id``: the best rows for each anchor (and window) of every strip.

    ``anchors`` has vec_id, label, raw and, for windows, an array ``bars`` of
    positive scores. Rows go once to every block of anchors, anchors once to
    every strip of rows.
    """
    blocks, strips = size
    windowed = "bars" in anchors.columns
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    strip = F.pmod(F.xxhash64(F.lit("strip"), "vec_id"), F.lit(strips)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.select(
        block.alias("block"), every(strips).alias("strip"), F.lit(0).alias("role"), "vec_id", "label", "raw",
        (F.col("bars") if windowed else F.lit(None).cast("array<bigint>")).alias("bars"),
    )
    right = rows.select(
        every(blocks).alias("block"), strip.alias("strip"), F.lit(1).alias("role"), "vec_id", "label", "raw",
        F.lit(None).cast("array<bigint>").alias("bars"),
    )
    keys = ["block", "strip"]
    together = left.unionAll(right).repartition(blocks * strips, *keys).sortWithinPartitions(*keys, "role", "vec_id")

    def numbers(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = piece.column(5).to_pylist()
        q = np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), -1).astype(np.int64)
        return piece.column(3).to_numpy(), piece.column(4).to_numpy(), q

    def bars(pieces: list[pa.RecordBatch]):
        """Least and most score of each window: 30 % and 90 % of the positive score, exactly; empty ones where there are fewer."""
        if not windowed:
            return None
        lists = [x for p in pieces for x in p.column(6).to_pylist()]
        count = max(map(len, lists))
        least = np.full((len(lists), count), 1, np.int64)
        most = np.full((len(lists), count), 0, np.int64)
        for i, scores in enumerate(lists):
            for k, score in enumerate(scores):
                least[i, k], most[i, k] = -(-30 * score // 100), 90 * score // 100
        return least, most

    def run(batches):
        here, held, block = None, [], None

        def answers():
            if block is None:
                return
            group, place = np.nonzero(block.best.id >= 0)
            per = len(block.best.id) // len(block.ids)
            yield pa.record_batch(
                [
                    pa.array(block.ids[group // per]),
                    pa.array((group % per).astype(np.int32)),
                    pa.array(block.best.score[group, place]),
                    pa.array(block.best.id[group, place]),
                ],
                names=["anchor_id", "slot", "score", "other_id"],
            )

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *ends.tolist()], [*ends.tolist(), len(key)]):
                if low == high:
                    continue
                if here != tuple(key[low, :2]):
                    yield from answers()
                    here, held, block = tuple(key[low, :2]), [], None
                piece = batch.slice(low, high - low)
                if key[low, 2] == 0:
                    held.append(piece)
                elif held:
                    if block is None:
                        ids, labels, q = (np.concatenate(x) for x in zip(*map(numbers, held)))
                        block = Anchors(ids, labels, q, primes, bars(held), keep)
                    block.meet(*numbers(piece))
        yield from answers()

    return together.mapInArrow(run, "anchor_id bigint, slot int, score bigint, other_id bigint")


def _first(found: DataFrame, groups: list[str], keep: int) -> DataFrame:
    """The ``keep`` best of all strips, with their rank from 1."""
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column | str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    anchor_block: int = ANCHOR_BLOCK,
    strip_rows: int = STRIP_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(scale * x); a score is the integer inner product
    with the anchor. An anchor's positives are the ``positives`` best other rows
    of its label; the negatives of a positive are the ``negatives`` best rows of
    other labels whose score is 30 % to 90 % of the positive's (inclusive,
    compared as integers). Higher scores come first, ties by smaller vec_id.

    ``anchors`` is a condition on vec_id, ``label`` an expression. Null ids, labels, vectors
    and components, non-finite components, vectors of another length than
    most, and components whose scores need not fit a long take no part. Zero vectors do. Of rows that
    repeat a vec_id the one with the smallest label (then components) counts.
    Anchors without positives or negatives have no rows, nor does an empty
    table. Further columns are ignored.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = cut(prepared(vectors, scale, label), "rows")
    width = common_width(rows.select(F.concat("raw", "raw").alias("raw")))  # counted in 8-byte numbers there
    rows = rows.where(F.octet_length("raw") == 4 * width)
    chosen = rows.where(anchors)
    facts = rows.agg(F.max("peak").alias("peak"), F.count("*").alias("n"), F.count_if(anchors).alias("anchors")).first()
    if not width or not facts["anchors"]:
        facts = {"peak": 0, "n": 1, "anchors": 1}
    primes = primes_for(max(1, width * facts["peak"] ** 2), width)
    blocks = max(1, -(-facts["anchors"] // anchor_block))
    strips = max(1, min(-(-facts["n"] // strip_rows), -(-TASKS // blocks)))
    size = (blocks, strips)
    best = _first(_best(chosen, rows, size, primes, positives), ["anchor_id"], positives)
    slots = cut(best.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bars = F.array_sort(F.collect_list(F.struct("slot", "positive_score")))  # at most ``positives`` an anchor
    windows = slots.groupBy(F.col("anchor_id").alias("vec_id")).agg(bars.getField("positive_score").alias("bars"))
    found = _best(chosen.join(windows, "vec_id"), rows, size, primes, negatives)
    ranked = _first(found, ["anchor_id", "slot"], negatives)
    return ranked.join(slots, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
