"""The whole index of word n-grams, grouped where it is small: windows of words, packed and dealt by their first letters.

All n-grams that begin at a word are beginnings of one window, so a window is sent for each word rather than its n-grams. Windows are dealt to buckets by the
first eight bytes of their glued form: an n-gram's key lies in one bucket, unless a border runs between its continuations. Such keys are short and few; they are counted apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import in_batches
from .spacing import Chunk

#: Characters of text that a task packs at a time, words of a bucket, and words hashed or pairs compared at a time.
BLOCK, BUCKET, SLICE = 1 << 22, 1 << 18, 1 << 15
HEAD = 8
MIX = np.uint64(0xD6E8FEB86659FD93)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Chunk]:
    texts, size = [], 0
    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t:
                texts.append(t)
                size += len(t)
                if size >= BLOCK:
                    yield Chunk(texts)
                    texts, size = [], 0
    if texts:
        yield Chunk(texts)


def _lasts(chunk: Chunk, most: int) -> np.ndarray:
    """The last word of the window that begins at each word."""
    return np.minimum(np.arange(len(chunk.start)) + most - 1, np.searchsorted(chunk.line, chunk.line, side="right") - 1)


def _heads(glued: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each stretch as a number in their order; what is missing is zero."""
    padded, out = np.append(glued, 0).astype(np.uint64), np.zeros(len(starts), np.uint64)
    for k in range(HEAD):
        at = starts + k
        out = out << np.uint64(8) | np.where(at < ends, padded[np.minimum(at, len(glued))], np.uint64(0))
    return out


def _rest(sizes: np.ndarray) -> np.ndarray:
    """The bits of a head that lie behind so many bytes."""
    return np.where(sizes < HEAD, np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.minimum(sizes, HEAD - 1).astype(np.uint64)), np.uint64(0))


def _beginnings(heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return heads & ~_rest(sizes)


def _over_border(heads: np.ndarray, sizes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Whether a key, the first bytes of a window, goes on in several buckets."""
    out, short = np.zeros(len(heads), bool), np.flatnonzero(sizes < HEAD)
    low = _beginnings(heads[short], sizes[short])
    out[short] = np.searchsorted(borders, low, side="right") != np.searchsorted(borders, low | _rest(sizes[short]), side="right")
    return out


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every span, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _borders(texts: DataFrame, most: int) -> np.ndarray:
    """Heads between buckets of about BUCKET words each, by evenly spaced windows of every block. They only decide where a window goes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _blocks(batches):
            some = np.arange(0, len(chunk.start), 1 << 10)
            heads = _heads(chunk.glued, chunk.glued_start[some], chunk.glued_end[_lasts(chunk, most)[some]])
            yield pa.RecordBatch.from_arrays([pa.array(heads.view(np.int64))], ["head"])

    rows = in_batches(texts, run, "head long").toArrow()
    heads = np.sort(rows.column(0).to_numpy().view(np.uint64)) if len(rows) else np.zeros(0, np.uint64)
    found = heads[:: max(1, BUCKET >> 10)][1:]
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def _packed(chunk: Chunk, most: int, borders: np.ndarray) -> Iterator[tuple]:
    """(bucket, words, windows): a bucket's windows, their bytes and the sizes of their words, compressed."""
    last = _lasts(chunk, most)
    a, b = chunk.glued_start, chunk.glued_end[last]
    heads = _heads(chunk.glued, a, b)
    order = np.argsort(heads, kind="stable")
    size = np.append(chunk.glued_end - chunk.glued_start, np.zeros(most, np.int64))
    cuts = np.concatenate([[0], np.searchsorted(heads[order], borders), [len(order)]])
    every = np.stack([np.where(order + m <= last[order], size[order + m], 0) for m in range(most)])
    a, sizes = a[order], (b - a)[order]
    for bucket in np.flatnonzero(np.diff(cuts)):
        mine = slice(cuts[bucket], cuts[bucket + 1])
        each = every[:, mine]
        kind = np.uint8 if each.max() < 256 else np.uint32
        windows = chunk.glued[_spans(a[mine], sizes[mine])]
        yield int(bucket), bytes([kind().itemsize]) + zstandard.compress(each.astype(kind).tobytes(), 3), zstandard.compress(windows.tobytes(), 3)


class Bucket:
    """The distinct forms of a bucket's windows, by keys: the arrays ``words`` and ``n`` have a value for each form, ``key`` is the number of its key."""

    def __init__(self, rows: list[dict], most: int, borders: np.ndarray):
        sizes = [np.frombuffer(zstandard.decompress(r["words"][1:]), {1: np.uint8, 4: np.uint32}[r["words"][0]]).reshape(most, -1).astype(np.int32) for r in rows]
        self.sizes = np.concatenate(sizes, axis=1)
        self.glued = np.frombuffer(b"".join(zstandard.decompress(r["windows"]) for r in rows), np.uint8)
        self.reach = np.cumsum(self.sizes, axis=0, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.reach[-1])[:-1]])
        self.heads = _heads(self.glued, self.starts, self.starts + self.reach[-1])
        shape, at, hashes = np.zeros(len(self.starts), np.uint64), [], self._hashes(most)
        for m in range(most):
            shape = (shape + self.sizes[m].astype(np.uint64) + np.uint64(1)) * MIX
            mine = np.flatnonzero((self.sizes[m] > 0) & ~_over_border(self.heads, self.reach[m], borders))
            at.append((mine, np.full(len(mine), m), hashes[m][mine], shape[mine]))
        self.at, self.m, key, shape = (np.concatenate(x) for x in zip(*at, strict=True))
        if not self._group(key, shape):
            known: dict[bytes, int] = {}
            self._group(np.array([known.setdefault(self.key_bytes(k), len(known)) for k in range(len(self.at))], np.uint64), shape)

    def _hashes(self, most: int) -> list[np.ndarray]:
        """Of the first word, the first two, and so on of each window."""
        out = [np.zeros(len(self.starts), np.uint64) for _ in range(most)]
        for k in range(0, len(self.starts), SLICE):
            first, ends = self.starts[k : k + SLICE], self.reach[:, k : k + SLICE]
            base, stop = first[0], first[-1] + ends[-1][-1]
            powers, back = _tables(int(stop - base))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.glued[base:stop].astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
            for m in range(most):
                x = (sums[first - base + ends[m]] - sums[first - base]) * back[first - base]
                out[m][k : k + SLICE] = (x ^ (x >> np.uint64(32))) * MIX
        return out

    def _group(self, key: np.ndarray, shape: np.ndarray) -> bool:
        """Sort the n-grams by key and form; whether equal hashes are equal keys and forms."""
        order = np.argsort(key)
        key, shape = key[order], shape[order]
        same = key[1:] == key[:-1]
        # Few keys have several forms; just these are sorted by form.
        run = np.cumsum(np.append(True, ~same)[: len(key)]) - 1
        several = np.zeros(len(key), bool)
        several[run[1:][same & (shape[1:] != shape[:-1])]] = True
        mixed = np.flatnonzero(several[run])
        by_form = mixed[np.lexsort((shape[mixed], key[mixed]))]
        order[mixed], shape[mixed] = order[by_form], shape[by_form]
        self.at, self.m = self.at[order], self.m[order]
        same, sizes = np.flatnonzero(same), self.reach[self.m, self.at]
        heads = _beginnings(self.heads[self.at], sizes)
        if (sizes[same] != sizes[same + 1]).any() or (heads[same] != heads[same + 1]).any():
            return False
        same = same[sizes[same] > HEAD]
        for k in range(0, len(same), SLICE):
            one = same[k : k + SLICE]
            n = sizes[one] - HEAD
            if (self.glued[_spans(self.starts[self.at[one]] + HEAD, n)] != self.glued[_spans(self.starts[self.at[one + 1]] + HEAD, n)]).any():
                return False
        new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
        new = new_key | np.append(True, shape[1:] != shape[:-1])[: len(key)]
        equal = np.flatnonzero(~new)
        a, b = equal - 1, equal
        if (self.m[a] != self.m[b]).any() or any((self.sizes[m, self.at[a]] != self.sizes[m, self.at[b]])[self.m[a] >= m].any() for m in range(len(self.sizes))):
            return False
        first = np.flatnonzero(new)
        self.n, self.at, self.m = np.diff(np.append(first, len(new))), self.at[first], self.m[first]
        self.words, self.key = self.m + 1, np.cumsum(new_key)[first] - 1
        return True

    def key_bytes(self, k: int) -> bytes:
        a = self.starts[self.at[k]]
        return self.glued[a : a + self.reach[self.m[k], self.at[k]]].tobytes()

    def form(self, k: int) -> str:
        raw, ends = self.key_bytes(k), self.reach[: self.m[k] + 1, self.at[k]].tolist()
        return b" ".join(raw[a:b] for a, b in zip([0, *ends], ends, strict=False)).decode()


_known: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, kept between buckets."""
    from .spacing import BASE, INVERSE, _powers

    if n + 1 > len(_known[0]):
        _known[:] = [_powers(BASE, n + 1), _powers(INVERSE, n + 1)]
    return _known[0][:n], _known[1][: n + 1]


def _apart(texts: DataFrame, most: int, borders: np.ndarray) -> DataFrame:
    """(key, variant, n) of the keys that several buckets hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _blocks(batches):
            forms: dict[str, int] = {}
            heads = _heads(chunk.glued, chunk.glued_start, chunk.glued_end[_lasts(chunk, most)])
            for m in range(1, most + 1):
                first = chunk.grams(m)
                size = chunk.glued_end[first + m - 1] - chunk.glued_start[first]
                short = size < HEAD
                first, size = first[short], size[short]
                over = _over_border(heads[first], size, borders)
                # Equal keys of fewer than eight bytes have equal heads; with the ends of their words they are equal forms.
                first, size = first[over], size[over]
                cut = np.zeros(len(first), np.uint64)
                for k in range(m):
                    cut |= np.uint64(1) << (chunk.glued_end[first + k] - chunk.glued_start[first]).astype(np.uint64)
                key = heads[first] >> (np.uint64(8) * (HEAD - size).astype(np.uint64))
                order = np.lexsort((cut, key))
                new = np.append(True, (key[order][1:] != key[order][:-1]) | (cut[order][1:] != cut[order][:-1]))[: len(order)]
                at = np.flatnonzero(new)
                for f, n in zip(first[order[at]].tolist(), np.diff(np.append(at, len(order))).tolist(), strict=True):
                    form = chunk.form(f, f + m - 1)
                    forms[form] = forms.get(form, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(forms), pa.string()), pa.array(list(forms.values()), pa.int64())], ["variant", "n"])

    counted = in_batches(texts, run, "variant string, n long").groupBy("variant").agg(F.sum("n").alias("n"))
    return counted.select(F.translate("variant", " ", "").alias("key"), "variant", "n")


def _by_bucket(texts: DataFrame, most: int, borders: np.ndarray, reduce: Callable[[Bucket], pa.Table], schema: str) -> DataFrame:
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _blocks(batches):
            for bucket, words, windows in _packed(chunk, most, borders):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([words], pa.binary()), pa.array([windows], pa.binary())], ["bucket", "words", "windows"])

    packed = in_batches(texts, pack, "bucket int, words binary, windows binary")
    return packed.groupBy("bucket").applyInArrow(lambda table: reduce(Bucket(table.to_pylist(), most, borders)), schema)


def sizes(texts: DataFrame, most: int = 6) -> DataFrame:
    """(words, variants, n, most): of the n-grams of so many words how many there are, how often they stand, and how often the commonest one does."""
    borders = _borders(texts, most)

    def reduce(bucket: Bucket) -> pa.Table:
        n, top = np.bincount(bucket.words, bucket.n, most + 1).astype(np.int64), np.zeros(most + 1, np.int64)
        np.maximum.at(top, bucket.words, bucket.n)
        return pa.table({"words": np.arange(most + 1), "variants": np.bincount(bucket.words, minlength=most + 1), "n": n, "most": top})

    found = _by_bucket(texts, most, borders, reduce, "words long, variants long, n long, most long")
    apart = _apart(texts, most, borders).select((F.length("variant") - F.length("key") + 1).cast("long").alias("words"), F.lit(1).cast("long").alias("variants"), "n", F.col("n").alias("most"))
    return found.unionByName(apart).where("n > 0").groupBy("words").agg(F.sum("variants").alias("variants"), F.sum("n").alias("n"), F.max("most").alias("most"))


def selected(texts: DataFrame, most: int = 6, total: int = 1, forms: int = 1) -> DataFrame:
    """(key, variant, n) of the keys found ``total`` times or more in ``forms`` forms or more: that part of ``spacing.ngram_index``."""
    borders = _borders(texts, most)

    def reduce(bucket: Bucket) -> pa.Table:
        keep = np.flatnonzero(((np.bincount(bucket.key, bucket.n) >= total) & (np.bincount(bucket.key) >= forms))[bucket.key])
        variants = [bucket.form(k) for k in keep.tolist()]
        return pa.table({"key": pa.array([v.replace(" ", "") for v in variants], pa.string()), "variant": pa.array(variants, pa.string()), "n": bucket.n[keep]})

    apart = _apart(texts, most, borders)
    keys = apart.groupBy("key").agg(F.sum("n").alias("t"), F.count("*").alias("f")).where((F.col("t") >= total) & (F.col("f") >= forms)).select("key")
    return _by_bucket(texts, most, borders, reduce, "key string, variant string, n long").unionByName(apart.join(keys, "key", "left_semi"))


def singles(texts: DataFrame, most: int = 6) -> DataFrame:
    """(key, variant) of the keys that have one form alone."""
    borders = _borders(texts, most)

    def reduce(bucket: Bucket) -> pa.Table:
        variants = [bucket.form(k) for k in np.flatnonzero((np.bincount(bucket.key) == 1)[bucket.key]).tolist()]
        return pa.table({"key": pa.array([v.replace(" ", "") for v in variants], pa.string()), "variant": pa.array(variants, pa.string())})

    apart = _apart(texts, most, borders).groupBy("key").agg(F.count("*").alias("forms"), F.first("variant").alias("variant")).where("forms = 1")
    return _by_bucket(texts, most, borders, reduce, "key string, variant string").unionByName(apart.select("key", "variant"))
