"""SimHash near-dedup to a similarity (operator 1, as the pipeline uses it): shingle sets of 5 words with a Jaccard similarity of 0.8 or more.

Fingerprints of 64 bits cannot tell that similarity, so each set has one of 256 bits, and what these let through is compared exactly:

1. *Buckets.* In any fixed order of the shingles, two sets of that similarity share one of their first n // 5 + 1, so only those
   leave a text. The order is by hash, common shingles last.
2. *First of a bucket.* Every set is held against the first of each of its buckets, so a large group of near copies becomes one
   component without all its pairs.
3. *The others.* In a small bucket, sets that are still in different components are compared one by one by their fingerprints. A
   large bucket is dealt into blocks of bounded rows and shingles; a pair of blocks is compared by bit planes and carry-save
   counters as in ``simhash``, what is left by counts of shared shingles, and only a spanning forest of the links leaves it.
4. *Exact check.* Pairs within RADIUS bits are compared by their whole sets.

RADIUS is 5 standard deviations above the bits in which sets of similarity 0.8 differ (of 256 about 39, of sets of
4 and 5 shingles 48): a link is lost with a chance below one in a million, and none in the tests' brute-force comparisons.

Defined results: words are lower-cased (ASCII) and parted at blanks; a text under 5 words is one shingle; texts without words, null ones too, are similar
to nothing and stay; rows of one doc_id with different texts are rows of their own; of equal rows one stays; rows of a null doc_id link
others and stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import components
from .decontaminate import FILTER_BITS, _filter_bits, _filter_places
from .session import cut, in_batches, whole_text
from .simhash import near, planes

SHINGLE = 5
#: Texts of a bucket from which its shingle comes last in the order.
COMMON = 32
WORDS = 4
RADIUS = 80
#: Rows of a bucket up to which rows are compared one by one.
SMALL = 48
#: Rows and shingles of a block of a larger bucket, about.
BLOCK, BLOCK_ITEMS = 1024, 1 << 20
PRINT = [f"f{k}" for k in range(WORDS)]


def _passes(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    table = np.frombuffer(bits, np.uint8)
    good = np.ones(len(hashes), bool)
    for place in _filter_places(hashes):
        good &= (table[place >> 3] >> (place & 7) & 1).astype(bool)
    return good


def _filter(df: DataFrame) -> bytes:
    """Bloom filter of a column of hashes, of a fixed size."""
    words = in_batches(df.distinct(), _filter_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    found = words.toArrow()  # at most FILTER_BITS / 32 rows
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits.tobytes()


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted by both."""
    words = ta.split(ta.LOWER[raw], offsets, ~ta.WHITE[raw])
    plain, lengths = words.hashes(), np.diff(words.first)
    rows, hashes = [], []
    for n in range(1, size + 1):
        at = np.flatnonzero(ta.inside(words.row, n))
        if n < size:
            at = at[lengths[words.row[at]] == n]
        rows.append(words.row[at])
        hashes.append(ta.mix(ta.windows(plain, n)[at] + np.uint64(n)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """Majority bits of a set of hashes, as WORDS words."""
    out = np.zeros(WORDS, np.uint64)
    for k in range(WORDS):
        counts = np.zeros(64, np.int64)
        for a in range(0, len(h), 1 << 14):
            part = ta.mix(h[a : a + (1 << 14)] ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _sets(size: int, what: str, bits=None):
    """Rows of texts' shingle sets: "keys" (rid, doc_id, key, n), "prefix" (shingle, key, n, pos), "prints" (key, fingerprint) or "sets" (key, items).

    The filter holds the common shingles of "prefix" and the wanted row ids of the last two.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if what in ("prints", "sets"):
                batch = batch.filter(pa.array(_passes(bits.value, batch.column(0).to_numpy().view(np.uint64))))
            raw, offsets = ta.buffers(batch.column(2))
            for a, b in ta.chunks(offsets):
                row, h = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                first = np.searchsorted(row, np.arange(b - a + 1))
                n = np.diff(first)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ta.mix(h), dtype=np.uint64)])
                key = ta.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
                if what == "keys":
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(ta.signed(key)), pa.array(n.astype(np.int32))], ["rid", "doc_id", "key", "n"])
                elif what == "prefix":
                    if bits is not None:
                        h = h[np.lexsort((h, _passes(bits.value, h), row))]
                    pos = np.arange(len(h)) - first[row]
                    at = np.flatnonzero(pos <= n[row] // 5)
                    yield pa.RecordBatch.from_arrays([pa.array(ta.signed(h[at])), pa.array(ta.signed(key[row[at]])), pa.array(n[row[at]].astype(np.int32)), pa.array(pos[at].astype(np.int32))], ["shingle", "key", "n", "pos"])
                elif what == "sets":
                    yield pa.RecordBatch.from_arrays([pa.array(ta.signed(key)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ta.signed(h)))], ["key", "items"])
                elif b > a:
                    prints = np.stack([wide_fingerprint(h[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(ta.signed(key)), *[pa.array(ta.signed(prints[:, k].copy())) for k in range(WORDS)]], ["key", *PRINT])

    return run


PREFIX = "shingle long, key long, n int, pos int"
MEMBERS = PREFIX + ", first long, first_n int, first_pos int, alone boolean"


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and key: each further key of a shingle, with the shingle's first; ``alone`` if there are just these two. Holds one row between batches."""
    held: tuple[int, int, int, int, int] | None = None  # shingle, key, n and pos of the first of the bucket at hand, and the last key
    for batch in batches:
        s, k, n, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        if not len(s):
            continue
        goes_on = held is not None and s[0] == held[0]
        head = np.ones(len(s), bool)
        head[1:] = s[1:] != s[:-1]
        head[0] = not goes_on
        further = np.ones(len(s), bool)
        further[1:] = k[1:] != k[:-1]
        if goes_on:
            further[0] = k[0] != held[4]
        further &= ~head
        at = np.flatnonzero(head)
        first = np.searchsorted(at, np.arange(len(s)), "right") - 1  # -1: of the bucket held over
        fill = lambda column, old: np.where(first >= 0, column[at[np.maximum(first, 0)]] if len(at) else 0, old)  # noqa: B023, E731
        fk, fn, fp = fill(k, held[1] if held else 0), fill(n, held[2] if held else 0), fill(pos, held[3] if held else 0)
        size = np.bincount(first + 1, further, len(at) + 1)
        whole = np.ones(len(at) + 1, bool)
        whole[[0, -1]] = False
        alone = ((size == 1) & whole)[first + 1]
        rows = np.flatnonzero(further)
        out = [s[rows], k[rows], n[rows], pos[rows], fk[rows], fn[rows].astype(np.int32), fp[rows].astype(np.int32), alone[rows]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["shingle", "key", "n", "pos", "first", "first_n", "first_pos", "alone"])
        held = (int(s[-1]), int(fk[-1]), int(fn[-1]), int(fp[-1]), int(k[-1]))


def _may(n: np.ndarray, pos: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of n and m that first meet at these places can be that similar (by their sizes, and by what is left after the place)."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return (np.minimum(n, m) * 5 >= np.maximum(n, m) * 4) & (np.minimum(n - pos, m - other) * 9 >= (n + m) * 4)


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by keys, with the places where they begin and the end; one group may wait for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        head = np.zeros(max(0, len(t) - 1), bool)
        for x in keys:
            c = t.column(x).to_numpy()
            head |= c[1:] != c[:-1]
        at = np.concatenate([[0], np.flatnonzero(head) + 1])
        if len(at) > 1:
            yield t.slice(0, at[-1]), at
        held = t.slice(at[-1])
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of small buckets, sorted by shingle: pairs (a, b) of keys of different roots within the radius. Row against the d-th row after it, all buckets at once."""
    for t, at in _groups(batches, ["shingle"]):
        c = {x: t.column(x).to_numpy() for x in t.column_names}
        bucket = np.repeat(np.arange(len(at) - 1), np.diff(at))
        fps = np.stack([c[x] for x in PRINT], axis=1).view(np.uint64)
        for d in range(1, int(np.diff(at).max())):
            i = np.flatnonzero((bucket[:-d] == bucket[d:]) & (c["root"][:-d] != c["root"][d:]))
            i = i[_may(c["n"][i], c["pos"][i], c["n"][i + d], c["pos"][i + d])]
            i = i[np.bitwise_count(fps[i] ^ fps[i + d]).sum(axis=1) <= RADIUS]
            if len(i):
                x, y = c["key"][i], c["key"][i + d]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def shared_counts(items: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Shared items of each two rows [rows, rows]; items of many rows by a product of matrices, the others pair by pair."""
    order = np.lexsort((row, items))
    row = row[order]
    at = np.flatnonzero(np.concatenate([[True], np.diff(items[order]) != 0, [True]]))
    sizes = np.diff(at)
    many = sizes > SMALL
    out = np.zeros((rows, rows), np.float32)
    for chunk in np.array_split(np.flatnonzero(many), -(-int(many.sum()) // 512) or 1):
        has = np.zeros((rows, len(chunk)), np.float32)
        for k, c in enumerate(chunk):
            has[row[at[c] : at[c + 1]], k] = 1
        out += has @ has.T
    item = np.repeat(np.arange(len(sizes)), sizes)
    few = ~many[item]
    for d in range(1, int(sizes[~many].max(initial=0))):
        i = np.flatnonzero((item[:-d] == item[d:]) & few[d:])
        np.add.at(out, (row[i], row[i + d]), 1)
        np.add.at(out, (row[i + d], row[i]), 1)
    return out


def block_links(fps: np.ndarray, root: np.ndarray, n: np.ndarray, items: np.ndarray, cut_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of different roots: places (i, j). Sets are items[cut_at[i]:cut_at[i+1]]."""
    size = len(fps)
    sliced = planes(fps)
    close = np.zeros((size, size), bool)
    for a in range(0, size, 64):
        skip = np.ones((min(64, size - a), sliced.shape[1] * 64), bool)
        skip[:, :size] = root[a : a + 64, None] == root[None]
        if not skip.all():
            hits = near(fps[a : a + 64], sliced, RADIUS, np.packbits(skip, axis=1, bitorder="little").view(np.uint64))
            close[a : a + 64] = np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, :size]
    if not close.any():
        return np.zeros(0, int), np.zeros(0, int)
    shared = shared_counts(items, np.repeat(np.arange(size), np.diff(cut_at)), size)
    for a in range(0, size, 256):
        close[a : a + 256] &= shared[a : a + 256] * 9 >= (n[a : a + 256, None] + n[None]) * 4
    del shared
    label = np.unique(root, return_inverse=True)[1]
    ends: list[tuple[int, int]] = []
    for i in np.flatnonzero(close.any(axis=1)):
        for j in np.flatnonzero(close[i]):
            if label[i] != label[j]:
                ends.append((i, j))
                label[label == label[j]] = label[i]
    i, j = np.array(ends, int).reshape(-1, 2).T
    return i, j


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pairs of blocks of large buckets, sorted by (shingle, low, high): a forest of their links (a, b)."""
    for t, at in _groups(batches, ["shingle", "low", "high"]):
        for s, e in zip(at[:-1], at[1:], strict=True):
            part = t.slice(s, e - s).combine_chunks()
            c = {x: part.column(x).to_numpy() for x in part.column_names if x != "items"}
            if (c["root"] == c["root"][0]).all():
                continue
            lists = part.column("items").chunk(0)
            i, j = block_links(np.stack([c[x] for x in PRINT], axis=1).view(np.uint64), c["root"], c["n"].astype(np.int64), lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]))
            yield pa.RecordBatch.from_arrays([pa.array(c["key"][i]), pa.array(c["key"][j])], ["a", "b"])


def _of_keys(texts: DataFrame, keys: DataFrame, wanted: DataFrame, what: str, size: int) -> DataFrame:
    """Prints or sets of the wanted keys, from one text each; the filter lets a few others through."""
    rids = keys.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("rid").alias("rid")).select("rid")
    schema = "key long, " + ("items array<long>" if what == "sets" else ", ".join(f"{x} long" for x in PRINT))
    return in_batches(texts, _sets(size, what, texts.sparkSession.sparkContext.broadcast(_filter(rids))), schema).dropDuplicates(["key"])


def _similar(pairs: DataFrame, prints: DataFrame, texts: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets have a similarity of 0.8; only sets with a partner within the radius are read."""
    for side in ("a", "b"):
        pairs = pairs.join(prints.select(F.col("key").alias(side), *[F.col(x).alias(side + x) for x in PRINT]), side)
    apart = sum((F.bit_count(F.col("a" + x).bitwiseXOR(F.col("b" + x))) for x in PRINT[1:]), F.bit_count(F.col("af0").bitwiseXOR(F.col("bf0"))))
    close = cut(pairs.where(apart <= RADIUS).select("a", "b"))
    sets = cut(_of_keys(texts, keys, close.select(F.explode(F.array("a", "b")).alias("key")), "sets", size))
    both = close.join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(shared * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b")


def _with_rid(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), whole_text()).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, n, root) of every row of docs; rows of one root are linked. rid is a hash of doc_id and text, n the number of shingles."""
    context = docs.sparkSession.sparkContext
    texts = _with_rid(docs)
    keys = cut(in_batches(texts, _sets(size, "keys"), "rid long, doc_id long, key long, n int"))
    common = in_batches(texts, _sets(size, "prefix"), PREFIX).groupBy("shingle").count().where(F.col("count") > COMMON).select("shingle")
    rows = in_batches(texts, _sets(size, "prefix", context.broadcast(_filter(common))), PREFIX)
    members = cut(in_batches(rows.repartition("shingle").sortWithinPartitions("shingle", "key"), _members, MEMBERS))

    n, m = F.col("n").cast("long"), F.col("first_n").cast("long")
    may = (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (F.least(n - F.col("pos"), m - F.col("first_pos")) * 9 >= (n + m) * 4)
    turn = cut(members.where(may).select(F.col("first").alias("a"), F.col("key").alias("b")).distinct())
    late = members.where(~F.col("alone")).select("shingle", "key", "n", "pos")
    wanted = turn.select(F.explode(F.array("a", "b")).alias("key")).unionByName(late.select("key")).distinct()
    prints = cut(_of_keys(texts, keys, wanted, "prints", size))
    links = cut(_similar(turn, prints, texts, keys, size))

    named = late.join(prints, "key").join(components(links).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    buckets = named.groupBy("shingle").agg(F.count("*").alias("rows"), F.sum("n").alias("items"), F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    named = cut(named.join(buckets.select("shingle", "rows", "items"), "shingle"))
    small = named.where(F.col("rows") <= SMALL).select("shingle", "key", "root", "n", "pos", *PRINT)
    rest = in_batches(small.repartition("shingle").sortWithinPartitions("shingle"), _neighbours, "a long, b long").distinct()

    large = named.where(F.col("rows") > SMALL)
    sets = _of_keys(texts, keys, large.select("key").distinct(), "sets", size)
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    dealt = large.withColumn("blocks", blocks).drop("items").join(sets, "key").withColumn("block", F.pmod(F.xxhash64("key", "shingle"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "root", "n", *PRINT, "items")
    found = in_batches(dealt.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high"), _blocks, "a long, b long")
    links = links.unionByName(_similar(rest, prints, texts, keys, size)).unionByName(found)
    return keys.join(components(links).withColumnRenamed("node", "key"), "key", "left").select("rid", "doc_id", "n", F.coalesce("root", "key").alias("root"))


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs without near duplicates: of each class, one row of the smallest doc_id stays. Rows without words or doc_id stay."""
    rows = cut(classes(docs, size))
    free = F.col("doc_id").isNull() | (F.col("n") == 0)
    least = rows.where(~free).groupBy("root").agg(F.min(F.struct("doc_id", "rid"))["rid"].alias("__rid")).select("__rid", F.lit(False).alias("__free"))
    kept = least.unionByName(rows.where(free).select(F.col("rid").alias("__rid"), F.lit(True).alias("__free")).distinct())
    here = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), whole_text()))
    joined = here.join(kept, here["__row"] == kept["__rid"])
    turn = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    return joined.withColumn("__turn", turn).where("__free or __turn = 1").drop("__row", "__rid", "__free", "__turn")
