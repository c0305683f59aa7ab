"""Cross-tokenizer alignment (operator 13): which tokens of a byte-level BPE (A) and of a piece vocabulary (B) cover the same bytes of a text.

A encodes a space and the text, B the text, before which it sets a space itself. Where tokens of both end at the same byte, a group of tokens ends; a link is a pair of
an A and a B token whose bytes overlap.

*Segments.* A text with its leading space is split before runs of white space. A splits there itself: its pre-tokens never hold white space behind
another character. B's merges do not cross a place before a white-space character that no piece of B holds behind another character: ``Tokens`` reads off B's vocabulary
which ones these are. So segments are tokenised each on its own, and groups and links stay within a segment.

*Steps.* 1. A pass over the texts gives every block of about ``BLOCK_CHARS`` of text a dictionary of its segments, and every document their numbers (the commonest
first); it is written to the shared folder. 2. A segment's hash deals it to a bucket; a bucket holds the dictionaries' shares of all blocks, tokenises its distinct segments,
once each, and gives every block the tokens of its own, which are written beside its documents, a row a block. 3. Every block counts in how many of its documents each pair of ids is linked; the sums over
all blocks are the pairs' counts. 4. Every block puts its documents together. Counts of up to ``MOST_PAIRS`` pairs are broadcast for that (64 MB), more of them are
joined back to the blocks. A segment reaches a bucket once for each block, however often it stands there, so the commonest one is no hot key; no document is
spread out into rows, and what is shuffled is compressed by columns.

Defined results: null and empty texts, and texts whose tokens of A or B do not give back the bytes of a space and the text, have no tokens: zeros and an empty string;
every row is a document, repeated ones too; null ids pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, discard, in_batches

#: Characters of text in a block, about; a longer text is a block of its own.
BLOCK_CHARS = 4 << 20
#: Characters of text for which there is a bucket.
BUCKET_CHARS = 16 << 20
#: Segments tokenised at a time, documents put together at a time.
PART, PART_DOCS = 4096, 64
MARK = "▁"

#: Pairs whose counts are broadcast at most.
MOST_PAIRS = 4 << 20

#: A row for a block's share of a bucket (segments one after another, sizes in bytes, their numbers), and, with bucket null, one for its documents (sizes: how many segments each has, numbers: of all of these).
BLOCKS = "block long, bucket int, sizes binary, numbers binary, segments binary, doc_ids array<bigint>"
#: The tokens of a block's share of a bucket: sizes and ids of A and B, segment by segment; a segment that cannot be aligned has none.
TOKENS = "block long, numbers binary, a_sizes binary, a_ids binary, b_sizes binary, b_ids binary"
#: A whole block: its documents, and the tokens of all its segments in the order of their numbers.
WHOLE = "block long, doc_ids array<bigint>, sizes binary, numbers binary, a_sizes binary, a_ids binary, b_sizes binary, b_ids binary"
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
DOCUMENTS = ", ".join(["doc_id long", *[f"{f} long" for f in FIGURES], "groups string"])


@lru_cache(maxsize=4)
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the other bytes in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Both tokenizers, the bytes of every id, and where segments may begin."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = {i: n for n, i in self.a.get_vocab(with_added_tokens=False).items()}
        byte_of = _byte_of()
        self.a_bytes = [bytes(byte_of[c] for c in names.get(i, "") if c in byte_of) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(MARK)
        texts = [p.replace(MARK, " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        # White space that pieces hold behind another character is no edge. Other white space than a space must not follow a space either: B sets one before
        # a segment that begins so, and it has to stay a token of its own.
        glued = {c for p in texts for x, c in zip(p, p[1:]) if c.isspace() and (not x.isspace() or c != " ")}
        #: The characters before which segments begin.
        self.before = "".join(c for c in " \t\n\v\f\r" if c not in glued)
        # U+180E counts as white space in some engines.
        self.edge = re.compile(rf"(?<=[^\s᠎])(?=[{re.escape(self.before)}])") if self.before else re.compile(r"(?!)")
        #: White space that is no edge; a text without it splits into runs of white space and words.
        self.other = re.compile("[" + re.escape("".join(c for c in map(chr, range(0x3001)) if (c.isspace() or c == "᠎") and c not in self.before)) + "]")

    def segments(self, text: str) -> list[str]:
        full = " " + text
        return self.edge.split(full) if self.other.search(full) or not self.before else WORD.findall(full)

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """(ids of A, ids of B) of each segment."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        # B sets a space before what it reads (if there is anything to read): it stands for a segment's own leading one, or is the first token.
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [(x, [self.space] if s == " " else y if s[0] == " " else y[1:]) for s, x, y in zip(segments, a, b, strict=True)]

    def tokenise(self, segments: list[str]) -> list[np.ndarray]:
        """[sizes of A, ids of A, sizes of B, ids of B] of the segments one after another; sizes are zero where the tokens' bytes are not the segment's.

        Segments that begin with a space and end with a word are read as one text, which is cut at their ends: that is what their edges promise.
        """
        plain = [k for k, s in enumerate(segments) if s[0] == " " and not s[-1].isspace() and MARK not in s]
        found: list[tuple] = [((), ())] * len(segments)
        rest = sorted(set(range(len(segments))) - set(plain))
        if plain:
            text = "".join(segments[k] for k in plain)
            ends = np.cumsum([len(segments[k].encode()) for k in plain])
            sides = [self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])]
            cuts = []
            for ids, of in zip(sides, (self.a_bytes, self.b_bytes), strict=True):
                at = np.cumsum([len(of[i]) for i in ids])
                cuts.append(np.searchsorted(at, ends) + 1)
                if b"".join([of[i] for i in ids]) != text.encode() or (at[cuts[-1] - 1] != ends).any():
                    rest, cuts = list(range(len(segments))), []
                    break
            if cuts:
                starts = [np.concatenate([[0], c[:-1]]).tolist() for c in cuts]
                for n, k in enumerate(plain):
                    found[k] = (sides[0][starts[0][n] : cuts[0][n]], sides[1][starts[1][n] : cuts[1][n]])
        for k, (a, b) in zip(rest, self.encode([segments[k] for k in rest]) if rest else [], strict=True):
            raw = segments[k].encode()
            if b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b]):
                found[k] = (a, b)
        return [x for side in (0, 1) for x in (np.array([len(f[side]) for f in found], np.int32), np.array([i for f in found for i in f[side]], np.int32))]


WORD = re.compile(r"\s*\S+|\s+")


@lru_cache(maxsize=4)
def tokens(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


@lru_cache(maxsize=4)
def _tables(a_path: str, b_path: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(for A and B: bytes of each id, how ids are written, bytes of that).

    Written are the digits and what follows: all ids of A, then those of B, inside of a group (a comma); then all again for the last of their side in it (a bar, a
    semicolon). Eight bytes each, zeros behind.
    """
    raws = (tokens(a_path, b_path).a_bytes, tokens(a_path, b_path).b_bytes)
    names = [f"{i}{mark}".encode() for marks in (",,", "|;") for raw, mark in zip(raws, marks, strict=True) for i in range(len(raw))]
    return [np.array([len(b) for b in raw], np.int64) for raw in raws], np.array(names, "S8").view(np.uint64), np.array([len(n) for n in names], np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes: all lowest bytes, then all second bytes, and so on."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _split(a_path: str, b_path: str, block_chars: int, buckets: int):
    def rows(block: int, known: dict[str, int], ids: list, numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        places = np.concatenate(numbers)
        by_use = np.argsort(-np.bincount(places, minlength=len(known)), kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[by_use] = np.arange(len(known))
        yield from _table(BLOCKS, [(block, None, packed(np.array([len(n) for n in numbers])), packed(rank[places]), None, ids)]).to_batches()
        segments = [s.encode() for s in known]
        bucket = np.array([xxhash.xxh64_intdigest(s) % buckets for s in segments], np.int64)[by_use]
        order = bucket.argsort(kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            b = int(bucket[mine[0]])
            raw = [segments[k] for k in by_use[mine].tolist()]
            sizes = packed(np.array([len(s) for s in raw]))
            yield from _table(BLOCKS, [(block, b, sizes, packed(np.diff(mine, prepend=0)), zstandard.compress(b"".join(raw), 3), None)]).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = tokens(a_path, b_path)
        block, known, ids, numbers, size = TaskContext.get().partitionId() << 32, {}, [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = text or ""
                if ids and size + len(t) > block_chars:
                    yield from rows(block, known, ids, numbers)
                    block, known, ids, numbers, size = block + 1, {}, [], [], 0
                ids.append(key)
                numbers.append(np.array([known.setdefault(s, len(known)) for s in cutter.segments(t)] if t else [], np.int32))
                size += len(t)
        if ids:
            yield from rows(block, known, ids, numbers)

    return run


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every span, one after another."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting: np.unique may hash them, which takes several times as long."""
    values = np.sort(values)
    return values[np.diff(values, prepend=values[:1] - 1) != 0]


def _strings(row: dict) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(unpacked(row["sizes"]))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(zstandard.decompress(row["segments"])))


def _bucket(a_path: str, b_path: str):
    """The distinct segments of a bucket, tokenised; each of its rows gets the tokens of its own."""

    def run(table: pa.Table) -> pa.Table:
        both = tokens(a_path, b_path)
        shares = table.select(["block", "sizes", "numbers", "segments"]).to_pylist()
        lists = [_strings(r) for r in shares]
        coded = pa.concat_arrays(lists).dictionary_encode()
        parts = [both.tokenise(coded.dictionary.slice(k, PART).to_pylist()) for k in range(0, len(coded.dictionary), PART)]
        sizes = [np.concatenate([p[k] for p in parts]) for k in (0, 2)]
        ids = [np.concatenate([p[k] for p in parts]) for k in (1, 3)]
        starts, at = [_starts(s) for s in sizes], coded.indices.to_numpy()
        out, first = [], 0
        for share, strings in zip(shares, lists, strict=True):
            mine = at[first : first + len(strings)]
            first += len(strings)
            row = [share["block"], share["numbers"]]
            for side in (0, 1):
                n = sizes[side][mine]
                row += [packed(n), packed(ids[side][_spans(starts[side][mine], n)])]
            out.append(tuple(row))
        return _table(TOKENS, out)

    return run


def _gather(table: pa.Table) -> pa.Table:
    """A block's row from those of its shares and of its documents."""
    rows = table.to_pylist()
    docs = next(r for r in rows if r["doc_ids"] is not None)
    shares = [r for r in rows if r["doc_ids"] is None]
    order = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(unpacked(r["numbers"])) for r in shares]]).argsort()
    out = []
    for side in "ab":
        n = np.concatenate([np.zeros(0, np.int64), *[unpacked(r[f"{side}_sizes"]) for r in shares]])
        ids = np.concatenate([np.zeros(0, np.int64), *[unpacked(r[f"{side}_ids"]) for r in shares]])
        out += [packed(n[order]), packed(ids[_spans(_starts(n)[:-1][order], n[order])])]
    return _table(WHOLE, [(docs["block"], docs["doc_ids"], docs["sizes"], docs["numbers"], *out)])


class Block:
    """A block's documents and the tokens of its segments, in the order of their numbers."""

    def __init__(self, row: dict, tables: tuple):
        self.doc_ids = row["doc_ids"]
        self.sizes = unpacked(row["sizes"])
        self.places = unpacked(row["numbers"])
        self.starts = _starts(self.sizes)
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.tables = tables
        self.n = [unpacked(row[f"{side}_sizes"]) for side in "ab"]
        self.ids = [unpacked(row[f"{side}_ids"]) for side in "ab"]
        fine = self.n[0] > 0
        #: Documents that have tokens: they have segments, and all of these could be aligned.
        self.good = (self.sizes > 0) & (np.bincount(self.of, weights=~fine[self.places], minlength=len(self.sizes)) == 0)
        # Ends of all tokens, as bytes from the block's first segment on, are marked in a row of bytes, which needs no sorting. A link is a stretch between two
        # neighbouring ends of either side; a group ends where both do.
        ends = [np.cumsum(t[i]) for t, i in zip(tables[0], self.ids, strict=True)]
        marks = [np.zeros(1 + max([0, *(int(x[-1]) for x in ends if len(x))]), bool) for _ in ends]
        for mark, end in zip(marks, ends, strict=True):
            mark[end] = True
        all_ends = np.flatnonzero(marks[0] | marks[1])
        #: Which of all ends are ends of A, and of B.
        self.here = [mark[all_ends] for mark in marks]
        first, second = (np.cumsum(h) - h for h in self.here)
        self.pairs = self.ids[0][first] << 32 | self.ids[1][second]
        self.link_starts = np.concatenate([[0], np.flatnonzero(self.here[0]) + 1])[_starts(self.n[0])]
        #: As many ends of both as there are groups.
        self.common = self.here[0] & self.here[1]
        self.group_starts = _starts(self.common)[self.link_starts]

    def by_document(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's segments; zero where it has no tokens."""
        sums = _starts(values[self.places])
        return np.where(self.good, sums[self.starts[1:]] - sums[self.starts[:-1]], 0)

    def by_segment(self, values: np.ndarray) -> np.ndarray:
        """Sums over each segment's links."""
        sums = _starts(values)
        return sums[self.link_starts[1:]] - sums[self.link_starts[:-1]]

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair, in how many documents it is linked)."""
        known, code = np.unique(self.pairs, return_inverse=True)
        counts, n_links = np.zeros(len(known), np.int64), np.diff(self.link_starts)
        for a in range(0, len(self.sizes), PART_DOCS):
            # Distinct segments of each document first, then their distinct pairs.
            span = slice(self.starts[a], self.starts[min(a + PART_DOCS, len(self.sizes))])
            doc, segment = np.divmod(_distinct(self.of[span] * (len(n_links) + 1) + self.places[span]), len(n_links) + 1)
            doc, segment = doc[self.good[doc]], segment[self.good[doc]]
            links = code[_spans(self.link_starts[segment], n_links[segment])]
            each = _distinct(np.repeat(doc, n_links[segment]) * len(known) + links)
            counts += np.bincount(each % max(1, len(known)), minlength=len(known))
        some = np.flatnonzero(counts)
        return known[some], counts[some]

    def groups(self) -> list[bytes]:
        """Each segment's groups: A's ids, a bar, B's ids, a semicolon; and so on."""
        sizes, names, widths = self.tables
        group = np.cumsum(self.common) - self.common
        # Two runs in order, which a stable sort merges.
        order = np.concatenate([2 * group[h] + side for side, h in enumerate(self.here)]).argsort(kind="stable")
        last = np.concatenate([self.common[h] for h in self.here])
        written = (np.concatenate([self.ids[0], self.ids[1] + len(sizes[0])]) + last * (len(names) // 2))[order]
        raw = names[written].view(np.uint8)
        whole = raw[raw != 0].tobytes()
        bounds = _starts(widths[written])[_starts(self.n[0] + self.n[1])].tolist()
        return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _count(a_path: str, b_path: str):
    """(block, pair, n) of each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, n = Block(row, _tables(a_path, b_path)).pair_counts()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["block"])), pa.array(pairs), pa.array(n)], ["block", "pair", "n"])

    return run


def _documents(block: Block, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> pa.Table:
    """The block's documents; pairs are in order, with their counts and whether these are the highest of their id of A."""
    # Pairs of segments that stand only in texts without tokens have no count, and no document asks for it.
    at = np.minimum(np.searchsorted(pairs, block.pairs), max(0, len(pairs) - 1))
    known = pairs[at] == block.pairs if len(pairs) else np.zeros(len(block.pairs), bool)
    count, is_best = (np.where(known, x[at] if len(pairs) else 0, 0).astype(np.int64) for x in (counts, best))
    by_segment = (*block.n, np.diff(block.group_starts), np.diff(block.link_starts), block.by_segment(is_best), block.by_segment(count))
    texts, places = block.groups(), block.places
    groups = [b"".join([texts[p] for p in places[a:b].tolist()])[:-1] if good else b"" for a, b, good in zip(block.starts[:-1], block.starts[1:], block.good, strict=True)]
    figures = {f: pa.array(block.by_document(x), pa.int64()) for f, x in zip(FIGURES, by_segment, strict=True)}
    return pa.table({"doc_id": pa.array(block.doc_ids, pa.int64()), **figures, "groups": pa.array(groups, pa.binary()).cast(pa.string())})


def _compose(a_path: str, b_path: str, counts):
    """Documents of each block, with all pairs' counts at hand."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(Block(row, _tables(a_path, b_path)), *counts.value).to_batches(max_chunksize=1024)

    return run


def _compose_joined(a_path: str, b_path: str):
    """Documents of a block, with the counts of its own pairs joined to it."""

    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        pairs = counts["pair"].to_numpy()
        order = pairs.argsort()
        return _documents(Block(block.to_pylist()[0], _tables(a_path, b_path)), pairs[order], *[counts[c].to_numpy()[order] for c in ("count", "best")])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, bucket_chars: int = BUCKET_CHARS, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document; groups as ``a1,a2|b1;a3|b2,b3``."""
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = 1 + (named.agg(F.sum(F.length("text"))).first()[0] or 0) // bucket_chars
    blocks = cut(in_batches(named, _split(a_path, b_path, block_chars, buckets), BLOCKS))
    shares = blocks.where("bucket is not null").select("block", "bucket", "sizes", "numbers", "segments")
    found = shares.groupBy("bucket").applyInArrow(_bucket(a_path, b_path), TOKENS)
    documents = blocks.where("bucket is null").select("block", "numbers", "doc_ids", "sizes")
    whole = cut(found.unionByName(documents, allowMissingColumns=True).groupBy("block").applyInArrow(_gather, WHOLE))
    discard(blocks)
    pairs = cut(in_batches(whole, _count(a_path, b_path), "block long, pair long, n long"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    ranked = cut(counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))
    if ranked.count() <= most_pairs:
        all_pairs = ranked.orderBy("pair").toArrow()
        counted = docs.sparkSession.sparkContext.broadcast(tuple(all_pairs[c].to_numpy() for c in ("pair", "count", "best")))
        return in_batches(whole, _compose(a_path, b_path, counted), DOCUMENTS)
    known = pairs.join(ranked, "pair").select(F.col("block").alias("of_block"), "pair", "count", "best")
    return whole.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_compose_joined(a_path, b_path), DOCUMENTS)
