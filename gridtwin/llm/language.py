"""Language of documents by a bidirectional gated recurrent network over bytes.

Texts are read in blocks of ``STEPS`` bytes, forwards by one network and
backwards by another; at every byte both states together give a distribution
over languages, and a document's prediction pools all its positions. The
network is trained here, in numpy, by backpropagation through time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtwin.llm.arrays import LOWER, text_blocks

STEPS = 48
HIDDEN = 8
TRAIN_DOCS = 400
TRAIN_BYTES = 8 << 20  # of every language
UPDATES = 240
BATCH = 128
#: Neighbouring positions say much the same; this many count as one independent one.
CORRELATED = 8.0
NO_LANGUAGE = "und"
BLOCKS_AT_ONCE = 4096

Params = dict[str, np.ndarray]


def start(languages: int, hidden: int = HIDDEN, seed: int = 7) -> Params:
    draw = np.random.default_rng(seed)
    out: Params = {"Wo": draw.normal(0, 0.3, (2 * hidden, languages)), "bo": np.zeros(languages)}
    for side in "fb":
        out["X" + side] = draw.normal(0, 0.3, (256, 3 * hidden))
        out["U" + side] = draw.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        out["c" + side] = np.zeros(hidden)
    return {k: v.astype(np.float32) for k, v in out.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def states(params: Params, side: str, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states [steps, blocks, hidden] of one direction; ``keep`` collects what the way back needs."""
    steps, blocks = codes.shape
    table, inner, bias = params["X" + side], params["U" + side], params["c" + side]
    hidden = inner.shape[0]
    out = np.empty((steps, blocks, hidden), np.float32)
    h = np.zeros((blocks, hidden), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        x, u = table[codes[t]], h @ inner
        gates = sigmoid(x[:, : 2 * hidden] + u[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        un = u[:, 2 * hidden :] + bias
        n = np.tanh(x[:, 2 * hidden :] + r * un)
        if keep is not None:
            keep.append((t, h, z, r, un, n))
        h = n + z * (h - n)
        out[t] = h
    return out


def logits(params: Params, codes: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sides = [states(params, side, codes, None if keep is None else keep.setdefault(side, [])) for side in "fb"]
    hidden = sides[0].shape[2]
    scores = sides[0] @ params["Wo"][:hidden] + sides[1] @ params["Wo"][hidden:] + params["bo"]
    return scores, *sides


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def gradients(params: Params, codes: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over all unmasked positions and its gradients."""
    keep: dict = {}
    scores, forward, backward = logits(params, codes, keep)
    logp = log_softmax(scores)
    total = max(1.0, float(mask.sum()))
    loss = -float((np.take_along_axis(logp, label[None, :, None], 2)[..., 0] * mask).sum()) / total
    slope = np.exp(logp)
    slope[:, np.arange(len(label)), label] -= 1
    slope *= (mask / total)[..., None]
    hidden = forward.shape[2]
    grads: Params = {"bo": slope.sum((0, 1))}
    grads["Wo"] = np.concatenate([np.tensordot(h, slope, ((0, 1), (0, 1))) for h in (forward, backward)])
    for side, part in (("f", params["Wo"][:hidden]), ("b", params["Wo"][hidden:])):
        outer = slope @ part.T
        table, inner, bias = (np.zeros_like(params[k + side]) for k in "XUc")
        carry = np.zeros(outer.shape[1:], np.float32)
        for t, before, z, r, un, n in reversed(keep[side]):
            carry = carry + outer[t]
            dn = carry * (1 - z) * (1 - n * n)
            dz = carry * (before - n) * z * (1 - z)
            dun = dn * r
            dr = dn * un * r * (1 - r)
            gates = np.concatenate([dz, dr, dun], 1)
            inner += before.T @ gates
            bias += dun.sum(0)
            into = np.concatenate([dz, dr, dn], 1)
            hot = np.zeros((256, len(into)), np.float32)
            hot[codes[t], np.arange(len(into))] = 1
            table += hot @ into
            carry = carry * z + gates @ params["U" + side].T
        grads |= {"X" + side: table, "U" + side: inner, "c" + side: bias}
    return loss, grads


def blocks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes [steps, blocks] padded with 0, mask of real positions, first block of each document."""
    counts = -(-np.diff(offsets) // STEPS)
    first = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = offsets[doc] + (np.arange(len(doc)) - first[doc]) * STEPS
    left = np.minimum(STEPS, offsets[doc + 1] - begin)
    at = begin[None, :] + np.arange(STEPS)[:, None]
    mask = np.arange(STEPS)[:, None] < left[None, :]
    codes = LOWER[data[np.minimum(at, max(len(data) - 1, 0))]] if len(data) else np.zeros((STEPS, 0), np.uint8)
    return np.where(mask, codes, 0).astype(np.uint8), mask.astype(np.float32), first


def train(texts: list[str], labels: np.ndarray, languages: int, updates: int = UPDATES, seed: int = 11) -> Params:
    """Adam on random blocks of the texts, each language drawn equally often."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    codes, mask, first = blocks_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
    label = labels[np.repeat(np.arange(len(raw)), np.diff(first))]
    draw = np.random.default_rng(seed)
    own = [np.flatnonzero(label == k) for k in range(languages)]
    own = [o for o in own if len(o)]
    params = start(languages)
    if not own:
        return params
    mean = {k: np.zeros_like(v) for k, v in params.items()}
    spread = {k: np.zeros_like(v) for k, v in params.items()}
    for step in range(1, updates + 1):
        pick = np.concatenate([draw.choice(o, -(-BATCH // len(own))) for o in own])
        _, grads = gradients(params, codes[:, pick], mask[:, pick], label[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.03 * (1 - step / (updates + 1)) + 0.001
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            params[k] = params[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)
        params = {k: v.astype(np.float32) for k, v in params.items()}
    return params


def position_log_probabilities(params: Params, codes: np.ndarray) -> np.ndarray:
    """[steps, blocks, languages]."""
    return log_softmax(logits(params, codes)[0])


def pooled(params: Params, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[documents, languages] probabilities from all positions of each document."""
    codes, mask, first = blocks_of(data, offsets)
    languages = len(params["bo"])
    sums = np.zeros((codes.shape[1] + 1, languages))
    for a in range(0, codes.shape[1], BLOCKS_AT_ONCE):
        part = slice(a, a + BLOCKS_AT_ONCE)
        logp = position_log_probabilities(params, codes[:, part])
        sums[1:][part] = np.einsum("tbl,tb->bl", logp, mask[:, part])
    sums = np.cumsum(sums, axis=0)
    return np.exp(log_softmax((sums[first[1:]] - sums[first[:-1]]) / CORRELATED))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> tuple[Params, list[str]]:
    """Train on at most ``train_docs`` different whole texts of every language (rows of ``docs`` with ``lang``).

    Texts are taken in the order of their hashes, up to ``train_bytes`` of them
    (the first one whatever its length), so repeated rows and ids change nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", "text", F.xxhash64(F.lit("sample"), "text").alias("h"), F.octet_length("text").alias("size"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    in_order = Window.partitionBy("lang").orderBy("h")
    texts = known.select("lang", "h", "size").distinct()
    # hashes are even: about four times as many texts as wanted go on to be put in order
    share = F.lit(4.0 * train_docs) / F.col("_n")
    low = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share
    few = texts.join(F.broadcast(texts.groupBy("lang").agg(F.count("*").alias("_n"))), "lang").where(low)  # one row a language
    first = few.withColumn("_rank", F.row_number().over(in_order))
    first = first.where(F.col("_rank") <= train_docs).withColumn("_upto", F.sum("size").over(in_order))
    chosen = first.where((F.col("_upto") <= train_bytes) | (F.col("_rank") == 1)).select("lang", "h")
    texts = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = texts.orderBy("h", "lang").collect()
    place = {lang: k for k, lang in enumerate(languages)}
    labels = np.array([place[r["lang"]] for r in rows], np.int64)
    return train([r["text"] for r in rows], labels, len(languages)), languages


def predict(docs: DataFrame, params: Params, languages: list[str]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    Null, empty and letterless texts are ``und`` with score 0, as is everything
    when no language was learned; other rows get a learned language and its
    pooled probability (of equally likely ones the first in order of name). Repeated rows are answered one by one,
    further columns are ignored, very long texts are read whole, in blocks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(params)  # fixed size

    def run(batches):
        for data, offsets, _, rows in text_blocks(batches):
            lettered = np.asarray(rows.column(2).to_numpy(zero_copy_only=False), bool)
            if languages:
                probability = pooled(shared.value, data, offsets)
                best = probability.argmax(axis=1)
                names = np.where(lettered, np.array(languages, object)[best], NO_LANGUAGE)
                scores = np.where(lettered, probability[np.arange(len(best)), best], 0.0)
            else:
                names, scores = np.full(len(rows), NO_LANGUAGE, object), np.zeros(len(rows))
            yield pa.record_batch(
                [rows.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", lettered.alias("_lettered")).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double"
    )
