"""Near-duplicate documents and shards against brute force."""

import random
import zlib

import numpy as np

from gridtwin.llm import groups, sharding, superminhash
from conftest_words import word_list


def brute_sets(texts, size):
    out = {}
    for doc, text in texts.items():
        w = word_list(text)
        out[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute_groups(sets, percent=80):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    return {i: top(i) for i in ids}


def compare(docs, size):
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = brute_sets(texts, size)
    want = brute_groups(sets)
    got = superminhash.near_duplicates(docs, size).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates(spark, odd, small_docs, nothing):
    compare(odd, 4)
    compare(small_docs, 4)
    compare(small_docs, 5)
    assert superminhash.near_duplicates(nothing).count() == 0
    rows = superminhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id bigint, text string"))
    assert sorted(map(tuple, rows.collect()), key=str) == [(3, 1, 3, True), (None, 1, None, True), (None, 1, None, True)]


def test_chains_of_copies_and_rows_said_twice(spark):
    """Each text changes one word of the last: the ends are linked only through the middle."""
    draw = random.Random(4)
    words = [f"w{draw.randint(0, 500)}" for _ in range(120)]
    texts = []
    for k in range(40):
        words = list(words)
        words[(7 * k) % 120] = f"new{k}"
        texts.append((k, " ".join(words)))
    docs = spark.createDataFrame(texts + texts[:5] + [(100 + k, t) for k, t in texts[:9]], "doc_id bigint, text string")
    compare(docs, 4)


def test_copies_linked_only_through_their_original(spark, monkeypatch):
    """Every copy is near the original, hardly any near another copy; the original has the largest id."""
    draw = random.Random(6)
    words = [f"w{draw.randint(0, 900)}" for _ in range(200)]
    texts = []
    for k in range(60):
        own = list(words)
        for _ in range(4):
            own[draw.randrange(200)] = f"n{draw.randint(0, 99_999)}"
        texts.append((k, " ".join(own)))
    docs = spark.createDataFrame([*texts, (99, " ".join(words))], "doc_id bigint, text string")
    compare(docs, 4)
    monkeypatch.setattr(superminhash, "HUB_ROUNDS", 1)
    compare(docs.where("doc_id != 99"), 4)


def test_signature_estimates():
    draw = np.random.default_rng(2)
    pool = draw.integers(1, 1 << 53, 900, np.uint64)
    a, b = pool[:600], pool[100:700]
    both = superminhash.signatures(np.concatenate([a, b, pool[:3]]), np.array([0, 600, 1200, 1203]), 125)
    assert abs((both[0] == both[1]).mean() - 500 / 700) < 0.12
    # the same values whatever the other documents are, and each element in steps of a permutation
    alone = superminhash.signatures(a, np.array([0, 600]), 125)
    assert (alone[0] == both[0]).all()
    assert sorted(np.bincount((both[2] >> np.uint64(32)).astype(int))) and (both[2] != superminhash.EMPTY).all()


def test_parity_maps_never_differ_more_than_the_sets():
    draw = np.random.default_rng(5)
    pool = draw.integers(1, 1 << 53, 3000, np.uint64)
    sets = [np.unique(draw.choice(pool, n)) for n in (1, 5, 60, 300, 2900, 300)] + [pool[:0]]
    first = np.cumsum([0, *map(len, sets)])
    maps = superminhash.parity_maps(np.concatenate(sets), first)
    for a, m in zip(sets, maps):
        for b, n in zip(sets, maps):
            apart = sum(int(w).bit_count() for w in (m ^ n).view(np.uint64))
            assert apart <= len(np.setxor1d(a, b)) and (len(a) > 300 or len(b) > 300 or 2 * apart >= len(np.setxor1d(a, b)))


def test_groups(spark, monkeypatch):
    draw = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, 1000 + k) for k in range(1, 400)]
    pairs += [(draw.randint(2000, 2100), draw.randint(2000, 2100)) for _ in range(60)]
    nodes, roots = groups.find_roots(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    want = {n: r for n, r in zip(nodes.tolist(), roots.tolist()) if any(n in p and p[0] != p[1] for p in pairs)}
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7)
    for at_once in (groups.EDGES_AT_ONCE, 100):
        monkeypatch.setattr(groups, "EDGES_AT_ONCE", at_once)
        got = groups.smallest_reachable(edges).collect()
        assert dict(map(tuple, got)) == want and len(got) == len(want)


def test_shards(spark, odd, small_docs, nothing):
    for docs in (odd, small_docs, odd.limit(1)):
        rows = sharding.shard(docs, 7).collect()
        total = len(rows)
        assert sorted(r.row_number for r in rows) == list(range(total))
        assert [r.doc_id for r in sorted(rows, key=lambda r: r.row_number)] == sorted(r.doc_id for r in rows)
        texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
        slots = {}
        for r in rows:
            place = sharding.place_of(r.row_number, total)
            assert (r.place, r.shard, r.slot) == (place, place % 7, place // 7) and sharding.row_of(place, total) == r.row_number
            assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(7)) <= 1
    assert sharding.shard(nothing, 7).count() == 0


def test_permutation_at_many_sizes():
    for rows in (*range(1, 60), 1000, 1023, 4097):
        assert sorted(sharding.place_of(x, rows) for x in range(rows)) == list(range(rows))


def test_written_shards(spark, odd, nothing, tmp_path, monkeypatch):
    """Repeated and null ids, repeated rows and clashing columns: every row is in one place of one file."""
    monkeypatch.setattr(sharding, "FILE_ROWS", 4)
    nameless = spark.createDataFrame([(None, "no id"), (None, None), (7, "another text of seven")], "doc_id bigint, text string")
    docs = odd.unionByName(odd.limit(6)).unionByName(odd.limit(6)).unionByName(nameless, allowMissingColumns=True)
    docs = docs.withColumnsRenamed({"pool": "Shard", "a": "slot"})
    back = sharding.write_shards(docs, 3, str(tmp_path / "s")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    assert sorted(map(key, back)) == sorted(map(key, docs.collect()))
    assert {r.input_slot for r in back if r.lang} == {"b"} and {r.input_Shard for r in back if r.lang} == {1}
    for number in range(3):
        slots = sorted(r.slot for r in back if r.shard == number)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(back) / 3) < 1
    files = [f for f in (tmp_path / "s").rglob("*.parquet")]
    assert max(spark.read.parquet(str(f)).count() for f in files) == 4
    alone = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.shard(odd, 3).collect()}
    again = sharding.sized(sharding.write_shards(odd, 3, str(tmp_path / "odd"))).collect()
    assert {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in again} == alone
    assert sharding.write_shards(nothing, 3, str(tmp_path / "none")).count() == 0
