"""BPE encoding and decoding (operator 8) with a contiguous rank array per word.

A word's parts and the rank of each adjacent pair stand in two short contiguous arrays. The pair of least rank
is found by scanning, its boundary is deleted, and only the ranks of the two neighbours are looked up again. The new
words of a batch go through this side by side, one row each; words are cached with their ids as ready bytes, so a text is
encoded by one join over its words.

The vocabulary is a byte-level one in the tokenizers library's JSON form; its path is a parameter and every Python
worker reads it once. Special tokens inside a text are recognised, as that library does by default.

Defined results: a null text is encoded as the empty one; columns other than text pass through.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textarrays as ta
from .session import in_batches

# Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pattern for the standard library's faster engine, right for texts without the characters below.
QUICK_PATTERN = r""" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+"""
NOT_QUICK = r"[^\t\n\r -\^`-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
#: Words kept with their ids by each Python worker; the cache starts anew beyond it.
CACHE = 100_000
#: Most bytes of the words that are merged side by side and cached, in arrays of these widths.
SHORT_BYTES = (16, 32, 64)
#: The rank of a pair that is not merged.
NONE = 1 << 30


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next free one from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_letters().items()}
        self.pieces: dict[bytes, int] = {}
        for piece, i in spec["model"]["vocab"].items():
            self.pieces[bytes(byte_of[c] for c in piece)] = i
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        keys, into = [], []
        for merge in spec["model"]["merges"]:
            a, b = (bytes(byte_of[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            keys.append(self.pieces[a] << 20 | self.pieces[b])
            into.append(self.pieces[a + b])
        #: Whether every piece comes from one merge. Then a pair with the new piece ranks behind the merge that made it.
        self.one_way = len(set(into)) == len(into)
        order = np.argsort(keys)
        #: Pairs in order, the rank of each, and the id that each rank's pair becomes.
        self.pairs, self.pair_rank, self.into = np.array(keys)[order], order.astype(np.int32), np.array(into, np.int32)
        self.rank = dict(zip(keys, range(len(keys)), strict=True))
        self.byte_id = np.array([self.pieces[bytes([b])] for b in range(256)], np.int32)
        self.any_words = regex.compile(PATTERN).findall
        self.quick_words = re.compile(QUICK_PATTERN).findall
        self.not_quick = re.compile(NOT_QUICK).search
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.cache: dict[str, bytes] = {}
        by_id = {i: p for p, i in self.pieces.items()} | {i: t.encode() for t, i in special.items()}
        size = max(by_id) + 1
        self.lengths = np.zeros(size, np.int64)
        for i, p in by_id.items():
            self.lengths[i] = len(p)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it has none."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NONE)

    def merge_words(self, words: list[bytes], size: int) -> list[bytes]:
        """Ids of words of at most ``size`` bytes, side by side: a row of ``parts`` and ``rank`` is the contiguous array of one word.

        A round finds each word's pair of least rank, deletes its boundary by closing the gap, and
        looks up the ranks to its left and right anew. Finished words leave the arrays.
        """
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        parts = np.zeros((n, size), np.int32)
        filled = np.arange(size) < length[:, None]
        parts[filled] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((n, size), NONE, np.int32)
        rank[:, :-1][filled[:, 1:]] = self.ranks(parts[:, :-1][filled[:, 1:]], parts[:, 1:][filled[:, 1:]])
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        while len(rows):
            k = rank.argmin(axis=1)
            least = rank[np.arange(len(rows)), k]
            if (over := least == NONE).any():
                ready = parts[over].astype("<u4")
                for i, ids, m in zip(rows[over].tolist(), ready, length[over].tolist(), strict=True):
                    out[i] = ids[:m].tobytes()
                go = ~over
                rows, parts, rank, length, k, least = rows[go], parts[go], rank[go], length[go], k[go], least[go]
                if not len(rows):
                    break
            n = len(rows)
            every = np.arange(n)
            keep = np.ones(parts.shape, bool)
            keep[every, k] = False
            rank = rank[keep].reshape(n, -1)
            keep[every, k] = True
            keep[every, k + 1] = False
            parts = parts[keep].reshape(n, -1)
            length -= 1
            parts[every, k] = self.into[least]
            i = np.flatnonzero(k + 1 < length)
            rank[every, np.minimum(k, rank.shape[1] - 1)] = NONE
            rank[i, k[i]] = self.ranks(parts[i, k[i]], parts[i, k[i] + 1])
            i = np.flatnonzero(k > 0)
            rank[i, k[i] - 1] = self.ranks(parts[i, k[i] - 1], parts[i, k[i]])
        return out

    def merge_long(self, word: bytes) -> bytes:
        """Ids of a very long word: deleted boundaries are stepped over by links, and a scan takes all places of its least rank, left to right.

        All of them at once is right if no merge can bring a smaller rank, which holds where every piece comes from one merge; else
        a scan takes one place.
        """
        ids = self.byte_id[np.frombuffer(word, np.uint8)].copy()
        n = len(ids)
        rank = np.append(self.ranks(ids[:-1], ids[1:]), NONE)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = np.ones(n, bool)
        while (least := int(rank.min())) != NONE:
            for k in np.flatnonzero(rank == least)[: None if self.one_way else 1].tolist():
                if rank[k] != least:
                    continue
                gone = right[k]
                ids[k] = self.into[least]
                alive[gone] = False
                rank[gone] = NONE
                right[k] = right[gone]
                if right[k] < n:
                    left[right[k]] = k
                for p in (left[k], k):
                    if p >= 0:
                        rank[p] = self.rank.get(int(ids[p]) << 20 | int(ids[right[p]]), NONE) if right[p] < n else NONE
        return ids[alive].astype("<u4").tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words. Short ones go into the cache, which starts anew when full; long ones are given back."""
        groups: list[list[tuple[str, bytes]]] = [[] for _ in range(len(SHORT_BYTES) + 1)]
        for w in words:
            raw = w.encode()
            groups[bisect_left(SHORT_BYTES, len(raw))].append((w, raw))
        for width, group in zip(SHORT_BYTES, groups, strict=False):
            for a in range(0, len(group), 20_000):
                part = group[a : a + 20_000]
                self.cache.update(zip([w for w, _ in part], self.merge_words([b for _, b in part], width), strict=True))
        return {w: self.merge_long(b) for w, b in groups[-1]}

    def words(self, text: str) -> list[str]:
        return self.any_words(text) if self.not_quick(text) else self.quick_words(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        # A text with special tokens is cut at them.
        cuts = [self.special_re.split(t) if self.special_re and self.special_re.search(t) else None for t in texts]
        split = [self.words(t) if c is None else [w for k, x in enumerate(c) for w in (self.words(x) if k % 2 == 0 else [(x,)])] for t, c in zip(texts, cuts, strict=True)]
        known = self.cache
        new = set().union(*split)
        tokens = {w for c, words in zip(cuts, split, strict=True) if c for w in words if isinstance(w, tuple)}
        extra = self.learn({w for w in new - tokens if w not in known}) | {t: self.special[t[0]] for t in tokens}
        if extra:
            get, other = known.get, extra.get
            return [b"".join([get(w) or other(w) for w in words]) for words in split]
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; a broken UTF-8 sequence becomes the replacement character."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        out = []
        for a in range(0, len(at), 1 << 20):
            part = at[a : a + (1 << 20)]
            n = self.lengths[part]
            total = int(n.sum())
            shift = np.repeat(self.starts[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            out.append(self.flat[np.arange(total) + shift].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str, names: list[str], at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for a, b in ta.chunks(ta.buffers(batch.column(at))[1]):
                part = batch.slice(a, b - a)
                ids = c.encode_all([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(names))], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*names, "n_tokens", "ids"])

    return run


def _decode(path: str, names: list[str], at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for a, b in ta.chunks(ta.buffers(batch.column(at))[1]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(names))], pa.array([c.decode(x or b"") for x in part.column(at).to_pylist()], pa.string())], [*names, "decoded"])

    return run


def _with(df: DataFrame, *new: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *new])


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs with n_tokens and ids (binary, little-endian unsigned 32-bit); columns of these names are replaced."""
    base = docs.drop("n_tokens", "ids")
    return in_batches(base, _encode(path, base.columns, base.columns.index(column)), _with(base, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())))


def decode(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """rows with decoded, the text of their ids; a null counts as no ids."""
    base = rows.drop("decoded")
    return in_batches(base, _decode(path, base.columns, base.columns.index(column)), _with(base, T.StructField("decoded", T.StringType())))
