"""Text probabilities by a log-bilinear neural model trained with noise-contrastive estimation.

The model predicts the class of a token from the classes of the two tokens
before it: a frequent token is a class of its own, other tokens share one
class per doubling of their training count, tokens seen once share theirs
with unknown ones. A class's own tokens are told apart by their counts. So every text
gets a probability that sums to one over known tokens and one unknown token.

Texts are turned into chunks of about ``CHUNK_WORDS`` words, each a row with its own
dictionary. Counts over the whole corpus come from merging dictionaries by
range of word hash and going back to the chunks; no table of all words is ever
in one place.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtwin.llm.arrays import LOWER, mix, run_hashes, text_blocks, words
from gridtwin.session import cut

CHUNK_WORDS = 1 << 20
ENTRIES_PER_BUCKET = 1 << 20
FREQUENT = 512
BANDS = 40
WIDTH = 24
BATCH = 2048
NOISE = 48
RATE = 0.08
SLOTS = 16
END = np.uint64(0x656E64206F662074)

Params = dict[str, np.ndarray]


def squeeze(values: np.ndarray) -> bytes:
    """Integers as byte planes, which compress better than whole numbers."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def chunked(docs: DataFrame) -> DataFrame:
    """``chunk, entries, head, words, counts, tokens``: dictionaries and texts as dictionary numbers.

    ``docs`` has doc_id, text and held_out. ``head`` holds doc_ids, held-out
    flags and token counts; ``words`` the hashes by falling count, ``counts``
    how often each occurs in training documents.
    """

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        hashes, names, held, sizes, n = [], [], [], [], 0

        def close():
            flat, size, out = np.concatenate(hashes), np.concatenate(sizes), np.concatenate(held)
            distinct, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            tokens = rank[inverse]
            train = np.bincount(tokens[np.repeat(~out, size)], minlength=len(order)).astype(np.uint32)
            row = [
                pa.array([part << 32 | seq]),
                pa.array([len(order)], pa.int64()),
                pa.array([pickle.dumps((names, out, size))], pa.binary()),
                pa.array([distinct[order].tobytes()], pa.binary()),
                pa.array([squeeze(train)], pa.binary()),
                pa.array([squeeze(tokens)], pa.binary()),
            ]
            return pa.record_batch(row, names=["chunk", "entries", "head", "words", "counts", "tokens"])

        for data, offsets, _, rows in text_blocks(batches):
            lowered = LOWER[data]
            begin, length, first = words(lowered, offsets)
            hashes.append(np.insert(run_hashes(lowered, begin, length), first[1:], END))
            sizes.append(np.diff(first) + 1)
            names.extend(rows.column(0).to_pylist())
            held.append(np.asarray(rows.column(2).to_numpy(zero_copy_only=False), bool))
            n += len(hashes[-1])
            if n >= CHUNK_WORDS:
                yield close()
                hashes, names, held, sizes, n, seq = [], [], [], [], 0, seq + 1
        if names:
            yield close()

    return docs.select("doc_id", "text", "held_out").mapInArrow(
        run, "chunk bigint, entries bigint, head binary, words binary, counts binary, tokens binary"
    )


def band_of(count: np.ndarray) -> np.ndarray:
    """0 for counts 0 and 1, then one band per doubling."""
    return np.where(count <= 1, 0, np.frexp(count.astype(np.float64))[1] - 1)


def merged_counts(chunks: DataFrame, entries: int) -> DataFrame:
    """Training counts over the whole corpus, sent back to every dictionary.

    Rows of kind 0: ``chunk, bucket, blob`` (counts in order of hash); kind 1:
    one frequent word (``a`` hash, ``b`` count); kind 2: totals of one count
    band (``a`` band, ``b`` tokens, ``c`` distinct words).
    """
    bits = max(0, (-(-entries // ENTRIES_PER_BUCKET) - 1).bit_length())

    def deal(batches):
        for frame in batches:
            for chunk, blob, counts in zip(frame["chunk"], frame["words"], frame["counts"]):
                hashes = np.frombuffer(blob, np.uint64)
                order = np.argsort(hashes)
                hashes, counts = hashes[order], unsqueeze(counts, np.uint32)[order]
                bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                own, begin = np.unique(bucket, return_index=True)
                ends = np.append(begin[1:], len(hashes))
                yield pd.DataFrame(
                    {
                        "chunk": chunk,
                        "bucket": own,
                        "words": [hashes[a:b].tobytes() for a, b in zip(begin, ends)],
                        "counts": [squeeze(counts[a:b]) for a, b in zip(begin, ends)],
                    }
                )

    schema = "kind int, chunk bigint, bucket bigint, blob binary, a bigint, b bigint, c bigint"

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(w, np.uint64) for w in group["words"]]
        counts = [unsqueeze(c, np.uint32) for c in group["counts"]]
        distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x) for x in lists])
        cells = [squeeze(total[inverse[e - len(x) : e]]) for x, e in zip(lists, ends)]
        known = np.flatnonzero(total)
        top = known[np.lexsort((distinct[known], -total[known]))[:FREQUENT]]
        band = band_of(total[known])
        sums, sizes = np.bincount(band, total[known], BANDS), np.bincount(band, minlength=BANDS)
        # every frame has every column, so that no hash passes through a float
        none = {"chunk": 0, "bucket": 0, "blob": b"", "a": 0, "b": 0, "c": 0}
        parts = [
            {"kind": 0, "chunk": group["chunk"], "bucket": group["bucket"], "blob": cells},
            {"kind": 1, "a": distinct[top].view(np.int64), "b": total[top]},
            {"kind": 2, "a": np.arange(BANDS), "b": sums.astype(np.int64), "c": sizes},
        ]
        return pd.concat([pd.DataFrame({**none, **part})[["kind", *none]] for part in parts], ignore_index=True)

    dealt = chunks.select("chunk", "words", "counts").mapInPandas(deal, "chunk bigint, bucket bigint, words binary, counts binary")
    return cut(dealt.groupBy("bucket").applyInPandas(merge, schema), "counts")


def vocabulary(counts: DataFrame) -> dict:
    """Frequent words, and tokens and distinct words of every band of the others."""
    top = counts.where("kind = 1").orderBy(F.desc("b"), "a").limit(FREQUENT).collect()
    bands = counts.where("kind = 2").groupBy("a").agg(F.sum("b").alias("b"), F.sum("c").alias("c")).collect()
    tokens, distinct = np.zeros(BANDS, np.int64), np.zeros(BANDS, np.int64)
    for r in bands:
        tokens[r["a"]], distinct[r["a"]] = r["b"], r["c"]
    total, size = int(tokens.sum()), int(distinct.sum())
    words_ = np.array([r["a"] for r in top], np.int64).view(np.uint64)
    count = np.array([r["b"] for r in top], np.int64)
    np.subtract.at(tokens, band_of(count), count)
    np.subtract.at(distinct, band_of(count), 1)
    order = np.argsort(words_)
    return {"words": words_[order], "count": count[order], "tokens": tokens, "distinct": distinct, "N": total, "V": size}


def classed(chunks: DataFrame, counts: DataFrame, vocab: dict) -> DataFrame:
    """``chunk, head, classes``: texts as classes, and per document what does not depend on the model."""
    shared = chunks.sparkSession.sparkContext.broadcast(vocab)  # at most FREQUENT words

    def run(batches):
        v = shared.value
        floor = np.log10(1.0 / (v["N"] + v["V"] + 1))
        for frame in batches:
            for chunk, head, blob, cells, tokens in zip(*(frame[c] for c in ("chunk", "head", "words", "cells", "tokens"))):
                names, held, size = pickle.loads(head)
                hashes = np.frombuffer(blob, np.uint64)
                ordered = np.concatenate([unsqueeze(c["blob"], np.int64) for c in sorted(cells, key=lambda c: c["bucket"])])
                count = np.empty(len(hashes), np.int64)
                count[np.argsort(hashes)] = ordered
                band = band_of(count)
                label = len(v["words"]) + band
                with np.errstate(divide="ignore"):
                    within = np.log10(count) - np.log10(np.maximum(v["tokens"][band], 1))
                once = v["distinct"][0]  # the class of single words gives half to unknown ones
                within = np.where(band == 0, np.where(count == 1, np.log10(0.5 / max(once, 1)), np.log10(0.5 if once else 1.0)), within)
                if len(v["words"]):
                    at = np.minimum(np.searchsorted(v["words"], hashes), len(v["words"]) - 1)
                    frequent = v["words"][at] == hashes
                    label, within = np.where(frequent, at, label), np.where(frequent, 0.0, within)
                tokens = unsqueeze(tokens, np.uint32)
                begin = np.cumsum(size) - size
                sums = [np.add.reduceat(x[tokens], begin) for x in (np.log10(count + 1.0) + floor, within, (count > 0).astype(np.int64))]
                head = pickle.dumps((names, held, size, *sums))
                yield pd.DataFrame({"chunk": [chunk], "head": [head], "classes": [squeeze(label[tokens].astype(np.uint16))]})

    cells = counts.where("kind = 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("cells"))  # one chunk's dictionary
    both = chunks.select("chunk", "head", "words", "tokens").join(cells, "chunk")
    return cut(both.mapInPandas(run, "chunk bigint, head binary, classes binary"), "classes")


def start_params(vocab: dict, seed: int = 3) -> Params:
    """Small random vectors; biases are the log class frequencies."""
    draw = np.random.default_rng(seed)
    total = np.concatenate([vocab["count"], vocab["tokens"]]).astype(np.float64) + 0.5
    n = len(total)
    out = {
        "context": draw.normal(0, 0.1, (n + 1, WIDTH)),
        "target": draw.normal(0, 0.1, (n, WIDTH)),
        "near": np.ones(WIDTH),
        "far": np.full(WIDTH, 0.5),
        "bias": np.log(total / total.sum()),
    }
    return {k: v.astype(np.float32) for k, v in out.items()}


def contexts(labels: np.ndarray, size: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Class before and class two before each token; ``start`` where the document begins."""
    begin = (np.cumsum(size) - size)[size > 0]
    one = np.concatenate([[start], labels[:-1]]).astype(np.int64)
    one[begin] = start
    two = np.concatenate([[start], one[:-1]])
    two[begin] = start
    return one, two


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def gathered(index: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Sums of the rows that share an index: [count, width]."""
    width = rows.shape[1]
    keys = (index[:, None] * width + np.arange(width)).ravel()
    return np.bincount(keys, rows.ravel(), count * width).reshape(count, width)


def slopes(p: Params, one, two, word, noise, log_noise: np.ndarray) -> tuple[float, Params]:
    """The contrastive objective of a batch (to be raised) and its gradients; ``log_noise`` is log(noise count * noise probability)."""
    n = len(p["bias"])
    r1, r2 = p["context"][one], p["context"][two]
    guess = r1 * p["near"] + r2 * p["far"]
    tw, tn = p["target"][word], p["target"][noise]
    real = (guess * tw).sum(axis=1) + p["bias"][word] - log_noise[word]
    fake = guess @ tn.T + (p["bias"][noise] - log_noise[noise])
    up, down = sigmoid(-real), -sigmoid(fake)
    value = float(np.log(sigmoid(real) + 1e-30).sum() + np.log(sigmoid(-fake) + 1e-30).sum())
    back = up[:, None] * tw + down @ tn
    grads = {
        "target": gathered(word, up[:, None] * guess, n) + gathered(noise, down.T @ guess, n),
        "bias": np.bincount(word, up, n) + np.bincount(noise, down.sum(axis=0), n),
        "context": gathered(one, back * p["near"], n + 1) + gathered(two, back * p["far"], n + 1),
        "near": (back * r1).sum(axis=0),
        "far": (back * r2).sum(axis=0),
    }
    return value, grads


def train(table: DataFrame, vocab: dict) -> Params:
    """One pass over all training tokens: every task learns from its chunks, the results are averaged by tokens."""
    start = start_params(vocab)
    shared = table.sparkSession.sparkContext.broadcast(start)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        p = {k: v.copy() for k, v in shared.value.items()}
        n = len(p["bias"])
        share = np.exp(p["bias"].astype(np.float64))
        share /= share.sum()
        log_noise = np.log(NOISE * share).astype(np.float32)
        draw, steps, seen = np.random.default_rng(part), {k: np.full_like(v, 1.0) for k, v in p.items()}, 0
        for frame in batches:
            for head, blob in zip(frame["head"], frame["classes"]):
                _, held, size = pickle.loads(head)[:3]
                labels = unsqueeze(blob, np.uint16).astype(np.int64)
                one, two = contexts(labels, size, n)
                own = np.flatnonzero(np.repeat(~held, size))
                draw.shuffle(own)
                noise = np.searchsorted(np.cumsum(share), draw.random((-(-len(own) // BATCH), NOISE))).clip(0, n - 1)
                for k, a in enumerate(range(0, len(own), BATCH)):
                    at = own[a : a + BATCH]
                    _, grads = slopes(p, one[at], two[at], labels[at], noise[k], log_noise)
                    for key, g in grads.items():
                        g = (g * (32.0 / BATCH)).astype(np.float32)
                        steps[key] += g * g
                        p[key] += RATE * g / np.sqrt(steps[key])
                seen += len(own)
        if seen:
            blob = pickle.dumps({k: v.astype(np.float64) * seen for k, v in p.items()})
            yield pd.DataFrame({"slot": [part % SLOTS], "seen": [seen], "params": [blob]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total: dict | None = None
        for blob in group["params"]:
            one = pickle.loads(blob)
            total = one if total is None else {k: total[k] + v for k, v in one.items()}
        return pd.DataFrame({"slot": [group["slot"].iloc[0]], "seen": [group["seen"].sum()], "params": [pickle.dumps(total)]})

    schema = "slot int, seen bigint, params binary"
    parts = table.select("head", "classes").mapInPandas(run, schema).groupBy("slot").applyInPandas(add, schema).collect()
    if not parts:
        return start
    seen = sum(r["seen"] for r in parts)
    sums = [pickle.loads(r["params"]) for r in sorted(parts, key=lambda r: r["slot"])]
    return {k: (sum(s[k] for s in sums) / seen).astype(np.float32) for k in start}


def token_log_probabilities(p: Params, labels: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's class, normalised over all classes of its context."""
    n = len(p["bias"])
    one, two = contexts(labels, size, n)
    pairs, inverse = np.unique(one * (n + 1) + two, return_inverse=True)
    near, far = p["context"] * p["near"], p["context"] * p["far"]
    guess = near[pairs // (n + 1)] + far[pairs % (n + 1)]
    norm = np.empty(len(pairs), np.float64)
    for a in range(0, len(pairs), 4096):
        logits = guess[a : a + 4096] @ p["target"].T + p["bias"]
        top = logits.max(axis=1)
        norm[a : a + 4096] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1, dtype=np.float64))
    out = np.empty(len(labels), np.float64)
    for a in range(0, len(labels), 1 << 16):
        part = slice(a, a + (1 << 16))
        out[part] = np.einsum("ij,ij->i", guess[inverse[part]], p["target"][labels[part]]) + p["bias"][labels[part]]
    return out - norm[inverse]


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``docs`` has doc_id, text and held_out (documents not to learn from).
    Tokens are lower-cased words and one end; null and empty texts are an end
    alone. Scores are log10 probabilities of whole texts; ``base_score`` is the
    add-one unigram model's. Repeated rows are learned from and scored as
    often as they occur. Without training rows all tokens are unknown.
    """
    chunks = cut(chunked(docs), "chunks")
    entries = chunks.agg(F.sum("entries")).first()[0] or 0
    counts = merged_counts(chunks, entries)
    vocab = vocabulary(counts)
    table = classed(chunks, counts, vocab)
    shared = docs.sparkSession.sparkContext.broadcast(train(table, vocab))
    total = vocab["N"]

    def run(batches):
        for frame in batches:
            for head, blob in zip(frame["head"], frame["classes"]):
                names, held, size, base, within, known = pickle.loads(head)
                labels = unsqueeze(blob, np.uint16).astype(np.int64)
                logp = np.add.reduceat(token_log_probabilities(shared.value, labels, size), np.cumsum(size) - size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(held),
                        pa.array(size, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(np.full(len(names), total), pa.int64()),
                        pa.array(base),
                        pa.array(logp / np.log(10) + within),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                ).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return table.select("head", "classes").mapInPandas(
        run,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
