"""Exact byte-pair encoding of documents by way of fragments cut at forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
be merged, so the text may be cut there and the fragments encoded one by one.
A cut must also leave the tokenizer's own splitting as it is; the rules below
state where that holds. The same fragments come up again and again, so each
distinct one of a task is encoded once, by the tokenizers library.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np

from gridtwin.llm.arrays import SPACE, distinct_runs, ragged, run_hashes, same_runs

CACHE_FRAGMENTS = 1_500_000  # about 70 MB a worker; beyond it the cache starts anew

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(0x21, 0x7F) if not (ASCII_LETTER[b] or DIGIT[b])]] = True
APOSTROPHE = 0x27


def byte_of_character() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def forced_pairs(token_bytes: list[bytes]) -> np.ndarray:
    """[256, 256] mask: pairs of bytes that occur inside no token."""
    inside = np.zeros((256, 256), bool)
    for token in token_bytes:
        values = np.frombuffer(token, np.uint8)
        inside[values[:-1], values[1:]] = True
    return ~inside


def byte_level_cuts(token_bytes: list[bytes]) -> np.ndarray:
    """Where a byte-level tokenizer's text may be cut: forced pairs that also keep its splitting.

    Not after white space unless white space follows (a run of spaces is split
    before its last one), not between punctuation and an apostrophe (that
    could begin a contraction), and never inside a character of several bytes.
    """
    cuts = forced_pairs(token_bytes)
    ascii_space = SPACE.copy()
    ascii_space[0x1C:0x20] = True
    cuts[ascii_space, :] &= SPACE[None, :]
    cuts[:, APOSTROPHE] &= ASCII_LETTER | DIGIT
    cuts[:, 0x80:] = False
    cuts[0x80:, :] &= SPACE[None, :]  # the character before may itself be a Unicode space
    return cuts


def word_end_cuts() -> np.ndarray:
    """For tokenizers that drop white space: cut around it, and where ASCII letters meet punctuation."""
    cuts = np.zeros((256, 256), bool)
    plain = PUNCTUATION.copy()
    plain[APOSTROPHE] = False
    cuts[np.ix_(ASCII_LETTER, plain)] = True
    cuts[np.ix_(plain, ASCII_LETTER)] = True
    cuts[SPACE, :] = True
    cuts[:, SPACE] = True
    return cuts


class FragmentEncoder:
    """Encodes blocks of documents with one tokenizer file; ids equal those of the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        self.specials = [t["content"].encode() for t in declared.get("added_tokens", []) if t["content"]]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.drops_space = "</w>" in str(declared["model"].get("end_of_word_suffix"))
        if self.drops_space:
            self.token_bytes = None
            self.cuts = word_end_cuts()
        else:
            to_byte = byte_of_character()
            self.token_bytes = [b""] * self.size
            special = {s.decode() for s in self.specials}
            for token, number in vocabulary.items():
                self.token_bytes[number] = token.encode() if token in special else bytes(to_byte[c] for c in token)
            self.cuts = byte_level_cuts([t for t in self.token_bytes if t not in self.specials])
            self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
            self.spans = np.fromiter(map(len, self.token_bytes), np.int64, self.size)
            self.begins = np.cumsum(self.spans) - self.spans
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of known fragments
        self.entry = np.zeros(0, np.int64)  # which entry each one is
        self.text = np.zeros(0, np.uint8)  # the bytes of all entries
        self.text_begin = np.zeros(0, np.int64)
        self.text_length = np.zeros(0, np.int64)
        self.where = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def boundaries(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Fragment starts: document starts, allowed cuts, and the ends of special tokens."""
        marks = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            marks[1:-1] = self.cuts.reshape(-1)[(data[:-1].astype(np.int32) << 8) | data[1:]]
        raw = None
        for special in self.specials:
            raw = data.tobytes() if raw is None else raw
            at = raw.find(special)
            while at >= 0:
                end = at + len(special)
                whole = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end - 1, "right")
                if whole:  # else it runs over the end of a document
                    marks[at + 1 : end] = False
                    marks[[at, end]] = True
                at = raw.find(special, end if whole else at + 1)
        marks[offsets] = True
        return np.flatnonzero(marks[:-1])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block one after another (uint32), and the ids before each document."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begin = self.boundaries(data, offsets)
        length = np.diff(np.append(begin, len(data)))
        if self.drops_space:
            kept = ~(SPACE[data[begin]] & (length == 1))
            begin, length = begin[kept], length[kept]
        first, inverse = distinct_runs(data, begin, length)
        slots = self._slots(data, begin[first], length[first])[inverse]
        counts = self.counts[slots]
        ids = self.pool[ragged(self.where[slots], counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(begin, offsets)]

    def _slots(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Entries of different fragments, after encoding those not yet known.

        A fragment is known if an entry with its hash has its bytes; one whose
        hash belongs to other bytes becomes an entry that is not looked up again.
        """
        hashes = run_hashes(data, begin, length)
        if len(self.counts) + len(hashes) > CACHE_FRAGMENTS and len(self.counts):
            self._forget()
        at = np.searchsorted(self.known, hashes)
        taken = np.zeros(len(hashes), bool)
        slots = np.full(len(hashes), -1, np.int64)
        if len(self.known):
            found = self.entry[np.minimum(at, len(self.entry) - 1)]
            taken = self.known[np.minimum(at, len(self.known) - 1)] == hashes
            held = np.flatnonzero(taken & (self.text_length[found] == length))
            held = held[same_runs(data, begin[held], self.text, self.text_begin[found[held]], length[held])]
            slots[held] = found[held]
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            raw = data.tobytes()
            texts = [raw[b : b + n].decode("utf-8", "replace") for b, n in zip(begin[missing].tolist(), length[missing].tolist())]
            new = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, new), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(new), np.uint32, int(counts.sum()))
            slots[missing] = len(self.counts) + np.arange(len(missing))
            own = length[missing]
            self.text_begin = np.concatenate([self.text_begin, len(self.text) + np.cumsum(own) - own])
            self.text_length = np.concatenate([self.text_length, own])
            self.text = np.concatenate([self.text, data[ragged(begin[missing], own)]])
            self.where = np.concatenate([self.where, len(self.pool) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.pool = np.concatenate([self.pool, flat])
            fresh = missing[~taken[missing]]
            fresh = fresh[np.unique(hashes[fresh], return_index=True)[1]]  # one entry a hash, ascending
            self.known = np.insert(self.known, at[fresh], hashes[fresh])
            self.entry = np.insert(self.entry, at[fresh], slots[fresh])
        return slots

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for (byte-level tokenizers)."""
        return self.flat[ragged(self.begins[ids], self.spans[ids])].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> FragmentEncoder:
    """One encoder per tokenizer file and Python worker, so that its cache serves all tasks of the worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return FragmentEncoder(path)
