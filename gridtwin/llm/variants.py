"""Spelling variants: near words found in a trie of letter-group counts.

Letters fall into groups; a word's path in the trie is its length and then how
often each group occurs in it, one count a level. One inserted, deleted or
replaced code point adds at most one to one count and takes at most one from
one count. A depth-first search therefore walks from the root with a budget of
one surplus and one deficit, spends it on counts that are off by one, and
compares the words of the leaves it reaches with the word it came for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtwin.llm.arrays import LOWER, distinct_runs, mix, ragged, text_blocks
from gridtwin.session import cut, cut_counting

SHORTEST = 6
FEWEST = 5
DAMAGE = 199
RATIO = 5

#: Groups of letters of about equal weight; every other letter belongs to one more group.
GROUPS = ("e", "a", "i", "n", "r", "t", "s", "o", "l", "h", "u", "dc", "gm", "pbf")
GROUP_OF = np.full(256, len(GROUPS), np.int64)
for _number, _letters in enumerate(GROUPS):
    GROUP_OF[[ord(x) for x in _letters]] = _number
LEVELS = 1 + len(GROUPS) + 1  # the length, the groups, the rest

COUNT_BYTES = 8 << 20
SHARD_WORDS = 50_000
DEEPEST = 6
LEAF = 24
WIDTH = 32
PAIRS_AT_ONCE = 1 << 20
QUESTIONS_AT_ONCE = 40_000

SOLID = np.zeros(256, bool)
SOLID[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more; elsewhere it does not occur

def crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = crc_table()


def run_crcs(data: np.ndarray, begin: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run, continued from the crc32 ``before`` of what stands before it."""
    order = np.argsort(-length, kind="stable")
    at, size = begin[order], length[order]
    state = ~before[order].astype(np.uint32)
    for k in range(int(min(size[0], 64)) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, "left"))  # runs longer than k
        own = state[:live]
        state[:live] = CRC_TABLE[(own ^ data[at[:live] + k]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
    out = np.empty(len(begin), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(length > 64).tolist():
        out[i] = zlib.crc32(data[begin[i] : begin[i] + length[i]].tobytes(), int(before[i]))
    return out


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in bytes of every run of letters, and the document it is in."""
    solid = SOLID[data]
    lead = data == LEAD
    solid |= lead
    solid[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[0], edge[-1] = True, True
    edge[offsets] = True
    marks = np.flatnonzero(edge)
    kept = solid[marks[:-1]] if len(data) else np.zeros(0, bool)
    begin, length = marks[:-1][kept], np.diff(marks)[kept]
    return begin, length, np.searchsorted(offsets, begin, "right") - 1


def word_counts(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``word, n``: how often each word of at least ``shortest`` code points occurs.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. A run
    whose crc32 of ``<doc_id>:<run>`` is divisible by 199 loses the code point
    that this number modulo the run's length names; a null doc_id counts as
    the empty text. Null texts have no words; repeated rows count each.
    """

    def run(batches):
        for raw, offsets, _, rows in text_blocks(batches, COUNT_BYTES, 10_000):
            data = LOWER[raw]
            begin, length, doc = text_words(data, offsets)
            leads = np.concatenate([[0], np.cumsum(data == LEAD)])
            points = length - (leads[begin + length] - leads[begin])
            some = points >= shortest
            begin, length, doc, points = begin[some], length[some], doc[some], points[some]
            ids = rows.column(0).to_pylist()
            before = np.array([zlib.crc32(b":" if i is None else b"%d:" % i) for i in ids], np.uint32)
            crc = run_crcs(data, begin, length, before[doc])
            hit = crc % DAMAGE == 0
            damaged = []
            for b, n, p, h in zip(begin[hit].tolist(), length[hit].tolist(), points[hit].tolist(), crc[hit].tolist()):
                if p > shortest:
                    word = data[b : b + n].tobytes().decode("utf-8")
                    damaged.append(word[: h % p] + word[h % p + 1 :])
            begin, length = begin[~hit], length[~hit]
            first, inverse = distinct_runs(data, begin, length)
            counts = np.bincount(inverse, minlength=len(first))
            flat = data[ragged(begin[first], length[first])]
            ends = np.concatenate([[0], np.cumsum(length[first])]).astype(np.int32)
            found = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat)))
            yield pa.record_batch([found, pa.array(counts, pa.int64())], names=["word", "n"])
            if damaged:
                yield pa.record_batch([pa.array(damaged, pa.string()), pa.array([1] * len(damaged), pa.int64())], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """Words as Latin-1 bytes in a padded matrix, with their letter counts; longer words are kept aside whole."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("latin-1") for t in texts]
        self.raw = raw
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(raw)), self.size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        width = int(min(WIDTH, self.size.max())) + 1 if len(raw) else 1
        self.letters = np.zeros((len(raw), width), np.uint8)
        inside = place < width
        self.letters[owner[inside], place[inside]] = flat[inside]
        path = np.bincount(owner * LEVELS + 1 + GROUP_OF[flat], minlength=len(raw) * LEVELS).reshape(len(raw), LEVELS)
        path[:, 0] = self.size
        self.path = path.astype(np.int32)


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced byte turns a into b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1 :] == b[k + (len(a) == len(b)) :]


def near_pairs(left: Words, i: np.ndarray, right: Words, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) are exactly one code point apart."""
    near = np.zeros(len(i), bool)
    a, b = left.size[i], right.size[j]
    wide = (a >= WIDTH) | (b >= WIDTH)
    for k in np.flatnonzero(wide).tolist():
        near[k] = one_apart(left.raw[i[k]], right.raw[j[k]])
    width = max(left.letters.shape[1], right.letters.shape[1])

    def padded(m: np.ndarray) -> np.ndarray:
        return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))

    x, y = padded(left.letters), padded(right.letters)
    k = np.flatnonzero(~wide & (a == b))
    near[k] = (x[i[k]] != y[j[k]]).sum(axis=1) == 1
    for k, u, v, p, q in (
        (np.flatnonzero(~wide & (a == b + 1)), x, y, i, j),
        (np.flatnonzero(~wide & (b == a + 1)), y, x, j, i),
    ):
        long, short = u[p[k]], v[q[k]]
        front = long != short
        back = long[:, 1:] != short[:, :-1]
        meets = np.argmax(front, axis=1)  # long is longer, so they differ somewhere
        last = np.where(back.any(axis=1), width - 2 - np.argmax(back[:, ::-1], axis=1), -1)
        near[k] = last < meets
    return near


class CountTrie:
    """Words of one shard arranged by successive counts; each node is a range of the sorted words."""

    def __init__(self, words: Words):
        self.words = words
        self.order = np.lexsort(words.path.T[::-1])
        self.path = words.path[self.order]

    def search(self, asked: Words):
        """Pairs (asked word, word of the trie) that are near."""
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        everyone = np.arange(len(asked.raw))
        none = np.zeros(len(everyone), np.int8)
        self.visit(0, len(self.order), 0, asked, everyone, none, none)
        return self.found

    def visit(self, low: int, high: int, level: int, asked: Words, rows: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        if high - low <= LEAF or level == LEVELS:
            self.leaf(low, high, level, asked, rows, surplus, deficit)
            return
        counts = self.path[low:high, level]
        cuts = np.flatnonzero(counts[1:] != counts[:-1]) + 1
        begins = [low, *(low + cuts).tolist()]
        ends = [*begins[1:], high]
        own = asked.path[rows, level]
        for begin, end in zip(begins, ends):
            apart = self.path[begin, level] - own
            if level:
                more, less = surplus + (apart == 1), deficit + (apart == -1)
                kept = np.flatnonzero((np.abs(apart) <= 1) & (more <= 1) & (less <= 1))
            else:  # the length only says which budgets are left; the counts spend them
                more, less = (apart == -1).astype(np.int8), (apart == 1).astype(np.int8)
                kept = np.flatnonzero(np.abs(apart) <= 1)
            if len(kept):
                self.visit(begin, end, level + 1, asked, rows[kept], more[kept].astype(np.int8), less[kept].astype(np.int8))

    def leaf(self, low: int, high: int, level: int, asked: Words, rows: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        members, rest = self.order[low:high], self.path[low:high, max(level, 1) :]
        first = level == 0
        step = max(1, PAIRS_AT_ONCE // max(1, len(members)))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            more = np.repeat(surplus[at : at + step, None], len(members), 1).astype(np.int32)
            less = np.repeat(deficit[at : at + step, None], len(members), 1).astype(np.int32)
            if first:
                apart = self.path[low:high, 0][None, :] - asked.path[own, 0][:, None]
                more, less = np.maximum(-apart, 0), np.maximum(apart, 0)
            for k in range(rest.shape[1]):
                apart = rest[:, k][None, :] - asked.path[own, max(level, 1) + k][:, None]
                more += np.maximum(apart, 0)
                less += np.maximum(-apart, 0)
            i, j = np.nonzero((more <= 1) & (less <= 1))
            i, j = own[i], members[j]
            for piece in range(0, len(i), PAIRS_AT_ONCE):
                a, b = i[piece : piece + PAIRS_AT_ONCE], j[piece : piece + PAIRS_AT_ONCE]
                near = near_pairs(asked, a, self.words, b)
                if near.any():
                    self.found.append((a[near], b[near]))


def prefix_keys(path: np.ndarray, depth: int) -> np.ndarray:
    """One number for the first ``depth`` counts of each path."""
    key = np.zeros(path.shape[:-1], np.uint64)
    for k in range(depth):
        key = mix(key + path[..., k].astype(np.uint64) + np.uint64(k + 1 << 32))
    return key.view(np.int64)


def probes(path: np.ndarray, depth: int) -> np.ndarray:
    """[words, probes] keys of all prefixes of ``depth`` counts that a near word can have, repeated ones included."""
    moves = [np.zeros(depth, np.int32)]
    spots = range(1, depth)
    unit = np.eye(depth, dtype=np.int32)
    for sign in (1, -1):  # one letter more or less, in one of the first groups or in a later one
        moves.extend([sign * unit[0], *(sign * (unit[0] + unit[k]) for k in spots)])
    for k in spots:  # a letter replaced, by or with one of a later group or of another first group
        moves.extend([unit[k], -unit[k], *(unit[k] - unit[m] for m in spots if m != k)])
    return np.stack([prefix_keys(path[:, :depth] + move, depth) for move in moves], axis=1)


def shard_depth(words: DataFrame, limit: int = SHARD_WORDS) -> int:
    """The fewest counts by which 99 in 100 words lie in groups of at most ``limit`` words (or the most counts tried)."""

    def run(batches):
        for rows in batches:
            path = Words(rows.column(0).to_pylist()).path
            keys = [prefix_keys(path, d) for d in range(1, DEEPEST + 1)]
            depth = np.repeat(np.arange(1, DEEPEST + 1, dtype=np.int32), len(path))
            yield pa.record_batch([pa.array(depth), pa.array(np.concatenate(keys))], names=["depth", "key"])

    sizes = words.select("word").mapInArrow(run, "depth int, key bigint").groupBy("depth", "key").agg(F.count("*").alias("n"))
    share = sizes.groupBy("depth").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") <= limit, F.col("n")).otherwise(0)).alias("good"))
    fit = sorted(r["depth"] for r in share.collect() if 100 * r["good"] >= 99 * r["all"])  # one row a depth
    return fit[0] if fit else DEEPEST


class Shard:
    """One trie with the counts of its words, and questions that wait for it."""

    def __init__(self, at: tuple[int, int]):
        self.at, self.texts, self.counts, self.trie, self.asked = at, [], [], None, []

    def add(self, texts: list[str], counts: np.ndarray) -> None:
        self.texts.extend(texts)
        self.counts.append(counts)

    def grow(self) -> None:
        """Build the trie, and rank its words: 0 for the largest count, ties to the smallest word."""
        self.trie, self.n = CountTrie(Words(self.texts)), np.concatenate(self.counts)
        by_text = np.array(sorted(range(len(self.texts)), key=self.texts.__getitem__))
        self.by_rank = by_text[np.argsort(-self.n[by_text], kind="stable")]
        self.rank = np.empty(len(self.texts), np.int64)
        self.rank[self.by_rank] = np.arange(len(self.texts))

    def answers(self, enough: int):
        """Near words of the waiting questions, once more than ``enough`` wait."""
        if len(self.asked) <= enough or not self.texts:
            return
        if self.trie is None:
            self.grow()
        asked, self.asked = self.asked, []
        near, best = np.zeros(len(asked), np.int64), np.full(len(asked), len(self.texts))
        for i, j in self.trie.search(Words(asked)):
            near += np.bincount(i, minlength=len(asked))
            np.minimum.at(best, i, self.rank[j])
        some = np.flatnonzero(near)
        top = self.by_rank[best[some]]
        yield pa.record_batch(
            [
                pa.array([asked[i] for i in some.tolist()], pa.string()),
                pa.array(near[some]),
                pa.array(self.n[top], pa.int64()),
                pa.array([self.texts[t] for t in top.tolist()], pa.string()),
            ],
            names=["word", "n_near", "best_n", "best"],
        )


def near_words(words: DataFrame, limit: int = SHARD_WORDS) -> DataFrame:
    """``word, n_near, best_n, best``: number of near words, and the one of largest ``n`` (ties: smallest), of words that have any.

    ``words`` holds each word once, with its count n. Words with equal first
    counts make a shard, whose trie is built in one task; a shard of more than
    ``limit`` words is dealt to several tries. Every word is sent, as a
    question, to all shards that can hold near words; it streams past their
    tries, so a task holds one trie and one batch of questions.
    """
    depth = shard_depth(words, limit)

    def route(batches):
        for rows in batches:
            held = Words(rows.column(0).to_pylist())
            keys = probes(held.path, depth)
            order = np.sort(keys, axis=1)
            fresh = np.concatenate([np.ones((len(order), 1), bool), order[:, 1:] != order[:, :-1]], axis=1)
            who = np.repeat(np.arange(len(order)), fresh.sum(axis=1))
            everyone = np.concatenate([np.arange(len(order)), who])
            role = np.concatenate([np.zeros(len(order), np.int32), np.ones(len(who), np.int32)])
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([prefix_keys(held.path, depth), order[fresh]])),
                    pa.array(role),
                    rows.column(0).take(pa.array(everyone)),
                    rows.column(1).take(pa.array(everyone)),
                ],
                names=["key", "role", "word", "n"],
            )

    routed = words.select("word", "n").mapInArrow(route, "key bigint, role int, word string, n bigint")
    sizes = routed.where("role = 0").groupBy("key").agg(F.ceil(F.count("*") / limit).cast("int").alias("_tries"))
    placed = routed.join(sizes, "key")  # a question to a key without words ends here
    own = F.array(F.pmod(F.xxhash64("word"), F.col("_tries")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_tries") - 1)
    dealt = placed.withColumn("part", F.explode(F.when(F.col("role") == 0, own).otherwise(every)))
    ordered = dealt.select("key", "part", "role", "word", "n").repartition("key", "part").sortWithinPartitions("key", "part", "role")

    def run(batches):
        shard = None
        for rows in batches:
            key, part, role = (rows.column(k).to_numpy() for k in range(3))
            ends = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for low, high in zip([0, *ends.tolist()], [*ends.tolist(), len(key)]):
                if low == high:
                    continue
                at = (int(key[low]), int(part[low]))
                if shard is None or shard.at != at:
                    if shard is not None:
                        yield from shard.answers(0)
                    shard = Shard(at)
                texts = rows.column(3).slice(low, high - low).to_pylist()
                if role[low] == 0:
                    shard.add(texts, rows.column(4).slice(low, high - low).to_numpy())
                else:
                    shard.asked.extend(texts)
                    yield from shard.answers(QUESTIONS_AT_ONCE)
        if shard is not None:
            yield from shard.answers(0)

    partial = ordered.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("_best")
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("_best.m")).alias("best_n"), F.col("_best.w").alias("best")
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form: the last one reached by following forms.

    A form occurs at least five times as often, so chains are short; words
    that have arrived leave the rounds.
    """
    step = forms.select(F.col("word").alias("_at"), F.col("form").alias("_next"))
    live, left = cut_counting(forms.select("word", F.col("form").alias("root")), label="forms")
    done = []
    while left:
        moved = live.join(step, live["root"] == step["_at"], "left")
        moved = cut(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")), "forms")
        done.append(moved.where(~F.col("_on")).select("word", "root"))
        live = moved.where("_on").select("word", "root")
        left = live.count()
    out = live.select("word", "root") if not done else done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of at least ``shortest`` code points and ``fewest`` occurrences.

    Two words are near if one inserted, deleted or replaced code point turns
    one into the other. ``form`` is the near word of largest n (ties: smallest
    in code-point order) if that n is at least ``ratio`` times the word's n,
    else null; ``root`` is the end of the chain of forms, the word itself
    without one. See :func:`word_counts` for what a word is and for nulls and
    repeated rows. Very long runs are words like others. Further columns are ignored; an empty table gives
    no rows.
    """
    words = cut(word_counts(docs, shortest).where(F.col("n") >= fewest), "words")
    near = near_words(words)
    has_form = F.col("best_n") >= ratio * F.col("n")
    known = cut(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.when(has_form, F.col("best")).alias("form"),
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    roots = with_roots(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
