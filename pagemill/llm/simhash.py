"""SimHash near-dedup (operator 1): fingerprints of 3-word shingles, linked by bit-sliced comparison.

Fingerprints are compared once per distinct value. Candidate buckets come from the pigeonhole principle: if at most
``radius`` of 64 bits differ, at least two of radius+2 bit blocks agree, so each fingerprint goes to one bucket per
pair of blocks. A bucket above ``most`` rows is dealt again by pairs of blocks of its remaining bits; what is left
varies in so few bits that its number of distinct fingerprints is bounded by a constant, whatever the input is.

In a bucket, fingerprints stand as bit planes (one word holds one bit of 64 fingerprints). A query is compared with 64 of
them at a time: each plane's differences are added to carry-save counters preset so that their
overflow means "more than radius"; a word is abandoned once each of its lanes has overflowed, a query's own and earlier lanes from the start. A
bucket gives a spanning forest, never all its pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; a row with a null doc_id keeps its fingerprint
and takes its component's id, null if no row there has one; repeated rows come back as often as they came.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import components
from .session import cut, in_batches, whole_text

SHINGLE = 3
RADIUS = 2
BITS = 64
#: Rows of a bucket from which it is dealt again by more bits.
BUCKET = 2048
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64; text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = ta.buffers(batch.column(1))
            fps = np.fromiter((fingerprint(raw[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ta.signed(fps))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row."""
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), _fingerprints(shingle), "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes [bits, words] of fingerprints of one or several 64-bit words each: bit i of word w of plane b is bit b of fingerprint 64*w+i."""
    fps = fps.reshape(len(fps), -1)
    width = fps.shape[1] * 64
    out = np.zeros((width, -(-len(fps) // 64)), np.uint64)
    for a in range(0, len(fps), 1 << 13):
        part = np.ascontiguousarray(fps[a : a + (1 << 13)])
        bits = np.zeros((-(-len(part) // 64) * 64, width), np.uint8)
        bits[: len(part)] = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        out[:, a // 64 : a // 64 + len(bits) // 64] = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)
    return out


def near(queries: np.ndarray, sliced: np.ndarray, radius: int, over: np.ndarray | None = None) -> np.ndarray:
    """Lanes [queries, words] within the radius, by carry-save counters over the bit planes; lanes preset in ``over`` are left out."""
    queries = queries.reshape(len(queries), -1)
    width = (radius + 1).bit_length()
    preset = (1 << width) - (radius + 1)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    shape = (len(queries), sliced.shape[1])
    out = np.full(shape, ones) if over is None else ~over
    q, w = np.nonzero(out)
    over = ~out[q, w]
    counters = [np.full(len(q), ones if preset >> k & 1 else np.uint64(0)) for k in range(width)]
    out[:] = 0
    for b in range(len(sliced)):
        mask = np.where(queries[:, b // 64] >> np.uint64(b % 64) & np.uint64(1), ones, np.uint64(0))
        carry = sliced[b][w] ^ mask[q]
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            on = np.flatnonzero(over != ones)
            if len(on) < len(q):
                q, w, over, counters = q[on], w[on], over[on], [c[on] for c in counters]
            if not len(q):
                break
    out[q, w] = ~over
    return out


def _lanes_up_to(n: int, words: int) -> np.ndarray:
    """Lanes [n, words] of n queries' own places and those before, the first query standing in the first lane."""
    places = np.arange(words * 64)
    return np.packbits(places[None, :] <= np.arange(n)[:, None], axis=1, bitorder="little").view(np.uint64)


def bucket_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a bucket's links: (position, position of its tree's first)."""
    n = len(fps)
    label = np.arange(n)
    sliced = planes(fps)
    for a in range(0, n, 64):
        queries = fps[a : a + 64]
        # Pairs once: of a query only the lanes behind it, so words before this one are not read at all.
        later = sliced[:, a // 64 :]
        hits = np.unpackbits(near(queries, later, radius, _lanes_up_to(len(queries), later.shape[1])).view(np.uint8), axis=1, bitorder="little")[:, : n - a].astype(bool)
        for i in np.flatnonzero(hits.any(axis=1)):
            trees = np.unique(np.append(label[a:][hits[i]], label[a + i]))
            if len(trees) > 1:
                label[np.isin(label, trees)] = trees[0]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _links(radius: int):
    def bucket(fps: np.ndarray, nodes: np.ndarray):
        i, j = bucket_links(fps.view(np.uint64), radius)
        return nodes[i], nodes[j]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket that may go on in the next batch waits for it."""
        held: pd.DataFrame | None = None
        for batch in batches:
            frame = batch.to_pandas()
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            keys = frame[["part", "key", "sub"]].to_numpy()
            head = np.ones(len(frame), bool)
            head[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            at = np.flatnonzero(head)
            held = frame.iloc[at[-1] :]
            yield from done(frame, at)
        if held is not None and len(held):
            yield from done(held, np.array([0, len(held)]))

    def done(frame: pd.DataFrame, at: np.ndarray):
        fps, nodes = frame["fp"].to_numpy(), frame["node"].to_numpy()
        found = [bucket(fps[s:e], nodes[s:e]) for s, e in zip(at[:-1], at[1:], strict=True) if e - s > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found]), pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _slices(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def _key(fp, bits: list[int]):
    """The chosen runs of bits of a fingerprint, the others zero."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def links(base: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """Edges (a, b) between nodes of base (fp, node; one row per fp) that connect all fingerprints within the radius."""
    blocks = _slices(range(BITS), radius + 2)
    pairs = list(combinations(range(radius + 2), 2))
    rest = [[b for k, block in enumerate(blocks) if k not in pair for b in block] for pair in pairs]

    dealt = base.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), _key(F.col("fp"), blocks[i] + blocks[j]).alias("key")) for k, (i, j) in enumerate(pairs)])).alias("x")).select("fp", "node", "x.part", "x.key")
    hot = dealt.groupBy("part", "key").count().where(F.col("count") > most).select("part", "key")
    cold = dealt.join(hot, ["part", "key"], "left_anti").withColumn("sub", F.lit(0).cast("long"))

    def again(k: int):
        inner = _slices(rest[k], radius + 2)
        return F.array(*[F.struct(F.lit(n + 1).alias("turn"), _key(F.col("fp"), inner[i] + inner[j]).alias("bits")) for n, (i, j) in enumerate(combinations(range(radius + 2), 2))])

    subs = F.coalesce(*[F.when(F.col("part") == k, again(k)) for k in range(len(pairs))])
    warm = dealt.join(hot, ["part", "key"], "left_semi").select("part", "key", "fp", "node", F.explode(subs).alias("x")).select((F.col("part") + 100 * F.col("x.turn")).alias("part"), "key", "fp", "node", F.col("x.bits").alias("sub"))
    rows = cold.unionByName(warm).select("part", "key", "sub", "fp", "node")
    return in_batches(rows.repartition("part", "key", "sub").sortWithinPartitions("part", "key", "sub"), _links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs, linked at ``radius`` or fewer differing bits.

    component_id is the smallest doc_id reachable over links.
    """
    fps = cut(fingerprints(docs, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # A fingerprint of null ids alone still links others: its node is a number above all usual ids.
    base = cut(nodes.select("fp", "least", F.coalesce("least", F.shiftrightunsigned("fp", 2) + F.lit(1 << 62)).alias("node")))
    found = components(links(base, radius))
    roots = base.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("root"), "least")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without near duplicates: of each component, the document of the smallest doc_id stays, with all its different texts, each once.

    Rows without a doc_id stay.
    """
    found = near_duplicates(docs, shingle, radius).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    with_id = docs.where("doc_id is not null").withColumn("__text", F.xxhash64(whole_text())).dropDuplicates(["doc_id", "__text"]).drop("__text")
    kept = with_id.join(found, with_id["doc_id"].cast("long") == found["__kept"], "left_semi")
    return kept.unionByName(docs.where("doc_id is null"))
