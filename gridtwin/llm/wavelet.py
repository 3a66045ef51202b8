"""Token files as wavelet matrices: one compressed shard answers access, rank, select and occurrences.

Layout of a shard (little endian): the 4 bytes ``WMX1``; uint32 planes,
uint32 documents, uint64 ids; the compressed document table (int64 id,
int64 count of ids, one byte whether the id is null); then for each plane from the highest bit down:
uint64 zeros, uint32 blocks, uint32 compressed length of each block, uint32
ones before each block, and the blocks. A block holds ``BLOCK_BITS`` bits,
packed lowest bit first and zstd-compressed on its own, so a single lookup
reads one block per plane. Plane k keeps the bits of the ids in the order
that plane k-1 leaves: all rows with a 0 before all rows with a 1, both in
their earlier order.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtwin.llm.arrays import BLOCK_BYTES, text_blocks
from gridtwin.llm.fragments import encoder
from gridtwin.session import cut

MAGIC = b"WMX1"
BLOCK_BITS = 1 << 17
SHARD_IDS = 1 << 20
HEAD = struct.Struct("<4sIIQ")
SHARD_SCHEMA = (
    "part int, seq int, first_doc bigint, last_doc bigint, n_docs bigint, n_tokens bigint, shard binary"
)


def pack(ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> bytes:
    """One shard of the given documents; null document ids are kept as such."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    table = np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes()
    table += np.asarray(counts, np.int64).tobytes() + bytes(d is None for d in doc_ids)
    table = squeeze(table)
    out = [HEAD.pack(MAGIC, planes, len(doc_ids), len(ids)), struct.pack("<I", len(table)), table]
    values = ids.astype(np.uint32)
    for plane in range(planes - 1, -1, -1):
        ones = (values >> np.uint32(plane) & np.uint32(1)).astype(bool)
        cuts = range(0, len(values), BLOCK_BITS)
        blocks = [squeeze(np.packbits(ones[c : c + BLOCK_BITS], bitorder="little").tobytes()) for c in cuts]
        before = np.cumsum([0] + [int(np.count_nonzero(ones[c : c + BLOCK_BITS])) for c in cuts])[:-1]
        out.append(struct.pack("<QI", len(values) - int(np.count_nonzero(ones)), len(blocks)))
        out.append(np.array([len(b) for b in blocks], np.uint32).tobytes() + before.astype(np.uint32).tobytes())
        out.extend(blocks)
        values = np.concatenate([values[~ones], values[ones]])
    return b"".join(out)


class Plane:
    def __init__(self, data: memoryview, at: int, size: int):
        self.size = size
        self.zeros, n = struct.unpack_from("<QI", data, at)
        at += 12
        lengths = np.frombuffer(data, np.uint32, n, at).astype(np.int64)
        self.before = np.frombuffer(data, np.uint32, n, at + 4 * n).astype(np.int64)
        self.starts = at + 8 * n + np.concatenate([[0], np.cumsum(lengths)])
        self.data, self.end = data, int(self.starts[-1])
        self.block = lru_cache(maxsize=8)(self._block)

    def _block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        raw = zstandard.ZstdDecompressor().decompress(self.data[self.starts[k] : self.starts[k + 1]])
        count = min(BLOCK_BITS, self.size - k * BLOCK_BITS)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count, bitorder="little")
        return bits.view(bool), np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    def bits(self) -> np.ndarray:
        squeezed = zstandard.ZstdDecompressor()
        raw = b"".join(squeezed.decompress(self.data[a:b]) for a, b in zip(self.starts[:-1], self.starts[1:]))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.size, bitorder="little").view(bool)

    def bit(self, i: int) -> bool:
        return bool(self.block(i // BLOCK_BITS)[0][i % BLOCK_BITS])

    def ones(self, i: int) -> int:
        """Ones before position i."""
        if i >= self.size:
            return self.size - self.zeros
        k = i // BLOCK_BITS
        return int(self.before[k] + self.block(k)[1][i % BLOCK_BITS])

    def find(self, which: bool, k: int) -> int:
        """Position of the k-th (from 0) one or zero."""
        before = self.before if which else np.arange(len(self.before)) * BLOCK_BITS - self.before
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self.block(block)[0] == which)[k - before[block]])


class WaveletMatrix:
    """A shard opened for lookups; blocks are unpacked only when touched."""

    def __init__(self, shard: bytes):
        data = memoryview(shard)
        magic, planes, docs, self.size = HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        (length,) = struct.unpack_from("<I", data, HEAD.size)
        at = HEAD.size + 4
        table = zstandard.ZstdDecompressor().decompress(data[at : at + length])
        numbers = np.frombuffer(table, np.int64, 2 * docs)
        missing = np.frombuffer(table, bool, docs, 16 * docs)
        self.doc_ids = [None if m else d for d, m in zip(numbers[:docs].tolist(), missing)]
        self.counts = numbers[docs:]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        at += length
        self.planes = []
        for _ in range(planes):
            self.planes.append(Plane(data, at, self.size))
            at = self.planes[-1].end

    def __getitem__(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            one = plane.bit(i)
            value = value << 1 | one
            i = plane.zeros + plane.ones(i) if one else i - plane.ones(i)
        return value

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for shift, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes):
            a, b = plane.ones(lo), plane.ones(hi)
            lo, hi = (plane.zeros + a, plane.zeros + b) if token >> shift & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the id occurs at positions lo to hi - 1."""
        a, b = self._span(token, lo, self.size if hi is None else hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        """Occurrences before position i."""
        return self.count(token, 0, i)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        a, b = self._span(token, 0, self.size)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for shift, plane in enumerate(reversed(self.planes)):
            one = bool(token >> shift & 1)
            at = plane.find(one, at - plane.zeros if one else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all(self) -> np.ndarray:
        """Every id in order: the planes are undone from the lowest bit up."""
        values = np.zeros(self.size, np.uint32)
        for shift, plane in enumerate(reversed(self.planes)):
            ones = plane.bits()
            earlier = np.empty_like(values)
            earlier[~ones] = values[: plane.zeros]
            earlier[ones] = values[plane.zeros :] | np.uint32(1 << shift)
            values = earlier
        return values


def write_shards(docs: DataFrame, path: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all texts in ascending doc_id order into wavelet shards; returns the shards read back.

    Documents are dealt by range of doc_id, so every task writes consecutive
    documents; a shard is closed once it holds ``shard_ids`` ids and a
    document is never split. Null texts count as empty (their only id is
    ``end_id``); a null doc_id sorts first; rows with the same doc_id are
    ordered by text. Shards are rows of Parquet files, so Spark's commit
    protocol covers lost executors.
    """

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        coder = encoder(path)
        ids, names, counts, held = [], [], [], 0

        def close():
            blob = pack(np.concatenate(ids), names, np.concatenate(counts))
            known = [n for n in names if n is not None]
            values = [part, seq, known[0] if known else None, known[-1] if known else None, len(names), held, blob]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array([v], k) for v, k in zip(values, kinds)]
            return pa.record_batch(columns, names=["part", "seq", "first_doc", "last_doc", "n_docs", "n_tokens", "shard"])

        for data, offsets, _, rows in text_blocks(batches, min(BLOCK_BYTES, 2 * shard_ids)):
            found, before = coder.encode(data, offsets)
            ids.append(np.insert(found, before[1:], np.uint32(end_id)))
            counts.append(np.diff(before) + 1)
            names.extend(rows.column(0).to_pylist())
            held += len(ids[-1])
            if held >= shard_ids:
                yield close()
                ids, names, counts, held, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, SHARD_SCHEMA), "wavelet")


def document_digests(shards: DataFrame) -> DataFrame:
    """Read every shard and digest its documents.

    ``doc_id, start`` (ids of all documents before it), ``n_tokens,
    ids_crc32`` (of the ids as little-endian uint32).
    """

    def run(batches):
        for rows in batches:
            for part, seq, shard in zip(*(rows.column(i).to_pylist() for i in range(3))):
                matrix = WaveletMatrix(shard)
                raw = matrix.all().astype("<u4").tobytes()
                digests = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(matrix.starts[:-1], matrix.starts[1:])]
                n = len(digests)
                yield pa.record_batch(
                    [
                        pa.array([part] * n, pa.int32()),
                        pa.array([seq] * n, pa.int32()),
                        pa.array(matrix.doc_ids, pa.int64()),
                        pa.array(matrix.starts[:-1], pa.int64()),
                        pa.array(matrix.counts, pa.int64()),
                        pa.array(digests, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    read = shards.select("part", "seq", "shard").mapInArrow(
        run, "part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    sizes = shards.groupBy("part", "seq").agg(F.sum("n_tokens").alias("_n"))
    parts = sizes.groupBy("part").agg(F.sum("_n").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(upto, F.lit(0)).alias("_part_start"))  # one row per range of documents
    inner = F.sum("_n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", "seq", F.coalesce(inner, F.lit(0)).alias("_shard_start")).join(parts, "part")
    return read.join(starts, ["part", "seq"]).select(
        "doc_id",
        (F.col("_part_start") + F.col("_shard_start") + F.col("inside")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
