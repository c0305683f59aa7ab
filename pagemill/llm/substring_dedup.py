"""Substring dedup (operator 10): Rabin-Karp window hashes counted in Spark, repeated windows merged into removal intervals.

A window is 13 consecutive words of one document. A word is removed if a window over it also
starts in a document with a smaller doc_id. The work is exact and runs in three steps:

1. *Seeds.* Every window is represented by the smallest hash of the five-word grams inside it (its
   minimizer); equal windows have equal seeds, and neighbouring windows mostly share theirs, so only about a
   fifth of the positions travel. A seed seen in one row alone cannot belong to a repeated window.
2. *Windows.* Only windows with a shared seed are hashed in full (two independent hashes of 64 and 32 bits) and compared.
3. *Intervals.* Repeated windows of a document merge into maximal intervals, which are cut from its text.

Hot seeds and windows are settled where they are read: within a chunk of documents only the smallest doc_id of
each hash stays open and travels by the hash, all others are already known to repeat. So a passage that a third
of all documents share sends one row per chunk, not one per document, to the task of its hash. A window that stands in one
text many times travels once, with its other places as bytes of the row. Whole copies of an earlier
text are told by two hashes of the text and take no part in the windows: all their words go.

Texts are dealt by doc_id once; the three joins with them have the same left side, so that Spark reuses the exchange.

Defined results: a null text has no words; a null doc_id is neither removed from nor a cause of removal; equal
doc_ids are one document for the comparison, and each of their rows keeps its own text; columns other than
doc_id and text pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .session import in_batches

WINDOW = 13
GRAM = 5
OPEN, SETTLED = 0, 1

SEEDS = "settled int, seed long, doc_id long"
#: h2_text is h2 and text_id, span is start and end, each as two halves of 32 bits: fewer columns, fewer bytes on disk.
WINDOWS = "settled int, h1 long, h2_text long, doc_id long, span long, more binary"
SPANS = "doc_id long, text_id int, start int, end int"
#: End of the span of a text that is a copy: all of its words, if they make a window.
ALL = (1 << 31) - 1


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def _pack(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two int32 in an int64."""
    return (high.astype(np.int64) << 32) | (low.astype(np.int64) & 0xFFFFFFFF)


def _seeds(words: ta.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, seed of each)."""
    hashes = words.hashes()
    seeds = ta.sliding_min(ta.windows(hashes, gram), window - gram + 1)
    at = np.flatnonzero(ta.inside(words.row, window))
    return at, seeds[at]


def _word_chunks(text: pa.Array) -> Iterator[tuple[int, int, ta.Words]]:
    raw, offsets = ta.buffers(text)
    for a, b in ta.chunks(offsets):
        part = raw[offsets[a] : offsets[b]]
        yield a, b, ta.split(part, offsets[a : b + 1] - offsets[a], ~ta.WHITE[part])


def _seed_rows(window: int, gram: int):
    """Rows of (doc_id, text): open seeds, one per chunk, and settled (seed, doc_id) that share one in a chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(batch.num_columns - 1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, words in _word_chunks(batch.column(1)):
                at, seeds = _seeds(words, window, gram)
                docs = ids[a:b][words.row[at]]
                order = np.lexsort((docs, seeds))
                seeds, docs = seeds[order], docs[order]
                keep = _runs(seeds, docs)
                seeds, docs = seeds[keep], docs[keep]
                head = _runs(seeds)
                sizes = np.diff(np.append(np.flatnonzero(head), len(seeds)))
                shared = np.repeat(sizes > 1, sizes)
                seed = ta.signed(np.concatenate([seeds[head], seeds[shared]]))
                doc = np.concatenate([docs[head], docs[shared]])
                settled = np.concatenate([np.zeros(head.sum(), np.int32), np.ones(shared.sum(), np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(settled), pa.array(seed), pa.array(doc)], ["settled", "seed", "doc_id"])

    return run


def _shared_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (settled, seed): settled ones, and open ones whose seed has several. Holds one row between batches."""
    last: tuple[int, int, bool] | None = None  # seed and doc of the last open row, and whether it was given out

    def out(seed, doc):
        return pa.RecordBatch.from_arrays([pa.array(seed, pa.int64()), pa.array(doc, pa.int64())], ["seed", "doc_id"])

    for batch in batches:
        settled, seed, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        opened = settled == OPEN
        yield out(seed[~opened], doc[~opened])
        seed, doc = seed[opened], doc[opened]
        if not len(seed):
            continue
        same = np.zeros(len(seed) + 1, bool)
        same[1:-1] = seed[1:] == seed[:-1]
        given = False
        if last is not None and last[0] == seed[0]:
            same[0] = True
            given = True
            if not last[2]:
                yield out([last[0]], [last[1]])
        hit = same[:-1] | same[1:]
        yield out(seed[hit], doc[hit])
        last = (int(seed[-1]), int(doc[-1]), bool(hit[-1]) or (given and len(seed) == 1))


def _window_rows(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(batch.num_columns - 1).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            text_ids = batch.column(2).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            values, counts = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            for a, b, words in _word_chunks(batch.column(1)):
                at, seeds = _seeds(words, window, gram)
                salt = ta.mix(np.arange(a, b, dtype=np.uint64) + np.uint64(1))
                wanted = values[bounds[a] : bounds[b]].view(np.uint64) ^ np.repeat(salt, counts[a:b])
                at = at[np.isin(seeds ^ salt[words.row[at]], wanted)]
                h1 = ta.windows(words.hashes(ta.BASES[0]), window, ta.WINDOW_BASES[0])[at]
                h2 = (ta.windows(words.hashes(ta.BASES[1]), window, ta.WINDOW_BASES[1])[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                row = words.row[at]
                doc = ids[a:b][row]
                start = (at - words.first[row]).astype(np.int32)
                order = np.lexsort((doc, h2, h1))
                head = _runs(h1[order], h2[order])
                sizes = np.diff(np.append(np.flatnonzero(head), len(order)))
                repeat = np.zeros(len(at), bool)
                repeat[order] = doc[order] > np.repeat(doc[order][head], sizes)
                # Known repeats merge here, in reading order.
                r_row, r_start = row[repeat], start[repeat]
                begin = _runs(r_row) | np.concatenate([[True], np.diff(r_start) > window])[: len(r_row)]
                last = np.flatnonzero(np.append(begin, True))[1:] - 1
                # So do equal open windows that follow one another, as in a text of one word again and again.
                o = np.flatnonzero(~repeat)
                o_begin = _runs(row[o], h1[o], h2[o]) | np.concatenate([[True], np.diff(start[o]) != 1])[: len(o)]
                o_last = np.flatnonzero(np.append(o_begin, True))[1:] - 1
                o_stop, o = start[o][o_last], o[o_begin]
                # What is left of a window's places in one text goes into one row: the first, and the others as pairs of int32.
                placed = np.lexsort((start[o], h2[o], h1[o], row[o]))
                o, o_stop = o[placed], o_stop[placed]
                first = _runs(row[o], h1[o], h2[o])
                others = np.stack([start[o], o_stop + np.int32(window)], axis=1)[~first].astype("<i4")
                n_others = np.diff(np.append(np.flatnonzero(first), len(o))) - 1
                o, o_stop = o[first], o_stop[first]
                n_open, n_done = len(o), int(begin.sum())
                at_more = np.concatenate([[0], np.cumsum(n_others), np.full(n_done, n_others.sum())]) * 8
                more = pa.Array.from_buffers(pa.binary(), n_open + n_done, [None, pa.py_buffer(at_more.astype(np.int32)), pa.py_buffer(others.tobytes())])
                zero = np.zeros(n_done, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.zeros(n_open, np.int32), np.ones(n_done, np.int32)])),
                        pa.array(np.concatenate([ta.signed(h1[o]), zero])),
                        pa.array(_pack(np.concatenate([h2[o], zero]), np.concatenate([text_ids[a:b][row[o]], text_ids[a:b][r_row[begin]]]))),
                        pa.array(np.concatenate([doc[o], ids[a:b][r_row[begin]]])),
                        pa.array(_pack(np.concatenate([start[o], r_start[begin]]), np.concatenate([o_stop, r_start[last]]) + np.int32(window))),
                        more,
                    ],
                    ["settled", "h1", "h2_text", "doc_id", "span", "more"],
                )

    return run


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (settled, h1, h2, doc_id): settled ones, and open ones after their hash's first document."""
    last: tuple[int, int, int] | None = None  # h1, h2 and first document of the group at hand
    for batch in batches:
        settled, h1, h2, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3))
        h2 = h2 >> 32
        keep = settled == SETTLED
        opened = np.flatnonzero(~keep)
        if len(opened):
            a, b, d = h1[opened], h2[opened], doc[opened]
            head = _runs(a, b)
            sizes = np.diff(np.append(np.flatnonzero(head), len(a)))
            least = np.repeat(d[head], sizes)
            if last is not None and (a[0], b[0]) == last[:2]:
                least[: sizes[0]] = last[2]
            keep[opened] = d > least
            last = (int(a[-1]), int(b[-1]), int(least[-1]))
        kept = batch.filter(pa.array(keep))
        text_id, doc, span = (kept.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
        text_id, start, end = text_id.astype(np.int32), (span >> 32).astype(np.int32), span.astype(np.int32)
        raw, offsets = ta.buffers(kept.column(5))
        pairs, counts = raw[offsets[0] : offsets[-1]].view("<i4").reshape(-1, 2), np.diff(offsets) // 8
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([doc, np.repeat(doc, counts)])),
                pa.array(np.concatenate([text_id, np.repeat(text_id, counts)])),
                pa.array(np.concatenate([start, pairs[:, 0]])),
                pa.array(np.concatenate([end, pairs[:, 1]])),
            ],
            ["doc_id", "text_id", "start", "end"],
        )


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with columns c0, c1, ..., so that none can clash with ours; and the names of doc_id and text there."""
    names = docs.columns
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    return base, f"c{names.index('doc_id')}", f"c{names.index('text')}"


def removal_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans) of each doc_id with repeated windows: word intervals [start, end) of its texts, by text_id.

    text_id is a hash of the text: rows of one doc_id with different texts keep their own spans. Spans of a text are
    bounded by its length; they may overlap and are merged where they are applied.
    """
    base, key, text = _plain(docs)
    doc, body = F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))
    text_id = F.shiftright(F.xxhash64(body), 32).cast("int")
    hashed = base.select(doc.alias("doc_id"), text_id.alias("text_id"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")).where("doc_id is not null")
    groups = hashed.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    copies = hashed.join(groups, ["t1", "t2"]).where("doc_id > least").select("doc_id", "text_id")
    copied = copies.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("text_id").alias("__copied"))

    first = base.join(copied, doc == F.col("__doc"), "left")
    asked = first.select(doc.alias("doc_id"), body.alias("text"), (doc.isNotNull() & ~F.coalesce(F.array_contains("__copied", text_id), F.lit(False))).alias("asked"))
    seeds = in_batches(asked, _seed_rows(window, gram), SEEDS)
    by_hash = lambda h: F.when(F.col("settled") == OPEN, F.col(h)).otherwise(F.col("doc_id"))
    shared = in_batches(seeds.repartition(by_hash("seed")).sortWithinPartitions("settled", "seed"), _shared_seeds, "seed long, doc_id long")
    by_doc = shared.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("seed").alias("__seeds"))

    candidates = base.join(by_doc, doc == F.col("__doc"), "left").select(doc.alias("doc_id"), body.alias("text"), text_id.alias("text_id"), F.col("__seeds").alias("seeds"))
    rows = in_batches(candidates, _window_rows(window, gram), WINDOWS)
    repeated = in_batches(rows.repartition(by_hash("h1")).sortWithinPartitions("settled", "h1", F.shiftright("h2_text", 32), "doc_id"), _repeated, SPANS)
    everything = repeated.unionByName(copies.select("doc_id", "text_id", F.lit(0).alias("start"), F.lit(ALL).alias("end")))
    return everything.groupBy("doc_id").agg(F.collect_list(F.struct("text_id", "start", "end")).alias("spans"))


def _apply(names: list[str], text_at: int, window: int, clean_layout: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = ta.buffers(batch.column(text_at))
            spans = batch.column(batch.num_columns - 1)
            n_words, n_removed, kept = [], [], []
            for row in range(batch.num_rows):
                text = raw[offsets[row] : offsets[row + 1]].tobytes()
                cuts = spans[row].as_py()
                if not cuts:
                    words = text.split()
                    n_words.append(len(words))
                    n_removed.append(0)
                    kept.append(b" ".join(words) if clean_layout else text)
                    continue
                part = np.frombuffer(text, np.uint8)
                table = ta.split(part, np.array([0, len(part)]), ~ta.WHITE[part])
                n = len(table.start)
                cuts = [c for c in cuts if c["end"] != ALL or n >= window]
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, [c["start"] for c in cuts], 1)
                np.add.at(depth, [min(c["end"], n) for c in cuts], -1)
                gone = np.cumsum(depth)[:n] > 0
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                if clean_layout:
                    kept.append(b" ".join(text[s:e] for s, e in zip(table.start[~gone].tolist(), table.end[~gone].tolist(), strict=True)))
                else:  # white space before a kept word stays
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~gone, [False]]).astype(np.int8)))
                    ends = np.concatenate([[0], table.end])
                    kept.append(b"".join(text[int(ends[i]) : int(table.end[j - 1])] for i, j in edges.reshape(-1, 2).tolist()))
            columns = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, clean_layout: bool = True) -> DataFrame:
    """docs with n_words, n_removed and kept_text (kept words joined by one space, or with their own white space).

    Every input row comes back once. Input columns of these three names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    base, key, text = _plain(docs)
    text_id = F.shiftright(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 32).cast("int")
    spans = removal_spans(docs, window, gram).select(F.col("doc_id").alias("__doc"), "spans")
    joined = base.join(spans, F.col(key).cast("long") == F.col("__doc"), "left")
    mine = joined.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], F.filter("spans", lambda x: x["text_id"] == text_id).alias("__spans"))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return in_batches(mine, _apply(keep, keep.index("text"), window, clean_layout), schema)
