"""Encoding, wavelet files and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridtwin.llm import arrays, fragments, packing, roundtrip, superminhash, wavelet
from gridtwin.session import cut

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_fragments_give_the_library_ids(spark, path):
    draw = random.Random(3)
    parts = list("ab'sStT .,!\n\t \r01 　éΣß́\x1c\x85日🎉<|>-") + ["<|endoftext|>", "'re", "''s", "  "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in roundtrip.encode(docs, path).collect()}
    assert [got[i] for i in range(len(texts))] == library(path, texts)


def regular(size, a="a", b="b"):
    """A word of ``size`` letters in which each half is the other one with the letters exchanged, and its exchange."""
    word = a
    while len(word) < size:
        word += word.translate(str.maketrans(a + b, b + a))
    return [word, word.translate(str.maketrans(a + b, b + a))]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_long_regular_words(spark, path):
    texts = [t for n in (64, 1024, 2048, 4096, 65536) for t in regular(n)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in roundtrip.encode(docs, path).collect()}
    assert [got[i] for i in range(len(texts))] == library(path, texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_fragments_of_one_hash_keep_their_ids(path, monkeypatch):
    for module in (arrays, fragments):
        monkeypatch.setattr(module, "run_hashes", lambda data, begin, length, seed=0: np.asarray(length, np.uint64) % np.uint64(3))
    texts = ["one two three four five", "two one, three! for fife", "eins zwei drei", *regular(300)] * 3
    coder = fragments.FragmentEncoder(path)
    for some in (texts[:4], texts, texts[::-1]):
        raw = [t.encode() for t in some]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, before = coder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == library(path, some)


def test_blocks_bound_rows_whatever_the_session_says(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('word', id % 70) AS text").coalesce(1)
    spark.conf.set(key, "0")
    try:
        rows = superminhash.near_duplicates(docs, 4).collect()
        assert spark.conf.get(key) == "0"
    finally:
        spark.conf.set(key, before)
    assert len(rows) == 5000 and all((r.n_shingles, r.component_id) == (1, r.doc_id % 70) for r in rows)


def test_regular_words_are_different_shingles(spark):
    docs = spark.createDataFrame(list(enumerate(regular(1024) + regular(4096))), "doc_id bigint, text string")
    assert sorted(r.component_id for r in superminhash.near_duplicates(docs, 4).collect()) == [0, 1, 2, 3]


def test_round_trip(spark, odd, small_docs, nothing):
    for docs in (odd, small_docs):
        rows = {r.doc_id: r for r in docs.collect()}
        want = dict(zip(rows, library(BYTES, [r.text for r in rows.values()])))
        got = roundtrip.round_trip(docs, BYTES).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.exact and r.n_tokens == len(want[r.doc_id])
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id].text or "").encode()).hexdigest()
    back = roundtrip.decode(roundtrip.encode(odd, BYTES), BYTES).collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.text or "" for r in odd.collect()}
    assert roundtrip.round_trip(nothing, BYTES).count() == 0
    assert roundtrip.round_trip(odd.unionAll(odd), BYTES).count() == 2 * odd.count()


def test_wavelet_lookups():
    ids = np.array(random.Random(1).choices([0, 1, 2, 7, 9, 50_000], k=5000), np.uint32)
    matrix = wavelet.WaveletMatrix(wavelet.pack(ids, [4, None, 6], np.array([3000, 0, 2000])))
    assert (matrix.all() == ids).all() and matrix.doc_ids == [4, None, 6]
    for token in (0, 7, 50_000, 3, 1 << 20):
        places = np.flatnonzero(ids == token).tolist()
        assert matrix.count(token) == len(places) and matrix.rank(token, 2500) == sum(p < 2500 for p in places)
        assert [matrix.select(token, k) for k in range(min(20, len(places)))] == places[:20]
    assert [matrix[i] for i in range(0, 5000, 97)] == ids[::97].tolist()
    assert wavelet.WaveletMatrix(wavelet.pack(ids[:3], [1], np.array([3]))).occurrences(int(ids[0]))[0] == 0


def test_wavelet_shards(spark, odd, small_docs, nothing):
    for docs, limit in ((odd, 50), (small_docs, 20_000)):
        shards = wavelet.write_shards(docs.unionByName(docs.limit(1)) if docs is odd else docs, BYTES, 2, limit)
        assert shards.count() > 3
        rows = sorted((docs.collect() + (docs.limit(1).collect() if docs is odd else [])), key=lambda r: r.doc_id)
        start, want = 0, []
        for r, ids in zip(rows, library(BYTES, [r.text for r in rows])):
            ids = [*ids, 2]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, wavelet.document_digests(shards).collect())) == want
    assert wavelet.document_digests(wavelet.write_shards(nothing, BYTES, 2)).count() == 0


def check_packing(rows, docs, capacity):
    text = {r.doc_id: r.text for r in docs}
    ids = dict(zip(text, library(WORDS, list(text.values()))))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(text)
    for doc, own in by_doc.items():
        whole = [*ids[doc], 0]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(whole) // capacity)))
        for r in own:
            assert r.start == r.piece * capacity and r.length == min(capacity, len(whole) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= capacity
    lengths, counts = np.unique([r.length for r in rows], return_counts=True)
    return len(by_sequence), packing.least_bins(lengths, counts, capacity)


def test_packing(spark, odd, small_docs, nothing):
    for docs, capacity, per_part in ((odd, 64, 1000), (small_docs, 2048, 1000), (small_docs, 256, 100)):
        packed = packing.pack(cut(packing.pieces(docs, WORDS, 0, capacity)), capacity, per_part)
        used, least = check_packing(packed.collect(), docs.collect(), capacity)
        assert least <= used <= max(least + 1, 1.02 * least)
    assert packing.pack(packing.pieces(nothing, WORDS, 0, 64), 64).count() == 0


def test_exchange_between_parts(spark):
    """Parts of few, large pieces waste room alone; together they pack better."""
    draw = random.Random(2)
    rows = [(i, 0, 0, draw.randint(200, 480), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    alone = packing.pack(frame, 1000, 8, rounds=0)
    packed = packing.pack(frame, 1000, 8)
    rows = packed.collect()
    assert len({r.sequence_id for r in rows}) < alone.select("sequence_id").distinct().count()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    for sequence in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == sequence)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1000


def test_lower_bound_is_never_above_an_optimal_packing():
    draw = random.Random(9)
    for _ in range(200):
        bins = draw.randint(1, 5)
        lengths = []
        for _ in range(bins):  # a packing into ``bins`` full bins exists by construction
            cuts = sorted(draw.sample(range(1, 30), draw.randint(0, 3)))
            lengths += np.diff([0, *cuts, 30]).tolist()
        values, counts = np.unique(lengths, return_counts=True)
        assert packing.least_bins(values, counts, 30) == bins
        placed, offsets, used = packing.best_fit(np.array(lengths), 30)
        assert used >= bins and all(np.bincount(placed, np.array(lengths)) <= 30)
