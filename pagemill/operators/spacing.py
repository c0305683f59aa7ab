"""Spacing variants: an index of word n-grams by their glued form, its conflicts, recommendations and series."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, in_batches

#: Bits of the filter of words: 8 MB whatever the table. Beyond some millions of distinct words it lets more n-grams through, which the join then takes out.
FILTER_BITS = 1 << 26
#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK = 1 << 18
# A fixed odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Chunk:
    """Texts as bytes with their words; any range of words has a hash of its glued form, by prefix sums over the text without its blanks."""

    def __init__(self, texts: list[str]):
        self.raw = "\n".join(texts).encode()
        bytes_ = np.frombuffer(self.raw, np.uint8)
        ends_line = bytes_ == 0x0A
        gap = (bytes_ == 0x20) | ends_line
        self.start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(gap) else np.zeros(0, np.int64)
        self.end = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1 if len(gap) else np.zeros(0, np.int64)
        self.line = np.concatenate([[0], np.cumsum(ends_line)])[self.start]
        self.glued = bytes_[~gap]
        place = np.concatenate([[0], np.cumsum(~gap)])
        self.glued_start, self.glued_end = place[self.start], place[self.end]

    @cached_property
    def sums(self) -> np.ndarray:
        glued = self.glued.astype(np.uint64) + np.uint64(1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(glued * _powers(BASE, len(glued)), dtype=np.uint64)])

    @cached_property
    def back(self) -> np.ndarray:
        return _powers(INVERSE, len(self.glued) + 1)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the words first to last of every range."""
        a, b = self.glued_start[first], self.glued_end[last]
        x = (self.sums[b] - self.sums[a]) * self.back[a]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(BASE)
        return x ^ (x >> np.uint64(29))

    def grams(self, m: int) -> np.ndarray:
        """First words of the n-grams of m words, none of which goes over a line's end."""
        n = len(self.start) - m + 1
        return np.flatnonzero(self.line[:n] == self.line[m - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def form(self, first: int, last: int) -> str:
        return " ".join(w for w in self.raw[self.start[first] : self.end[last]].decode().split(" ") if w)


def _chunks(column: pa.Array) -> Iterator[Chunk]:
    texts, size = [], 0
    for t in column.to_pylist():
        if t:
            texts.append(t)
            size += len(t)
            if size >= CHUNK:
                yield Chunk(texts)
                texts, size = [], 0
    if texts:
        yield Chunk(texts)


def _slots(hashes: np.ndarray) -> np.ndarray:
    """Two bit numbers of each hash, [2, hashes]."""
    return np.stack([hashes % np.uint64(FILTER_BITS), (hashes >> np.uint64(32)) % np.uint64(FILTER_BITS)]).astype(np.int64)


def _set_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, bits) of the words of a task: cells of 32 bits."""
    cells = np.zeros(FILTER_BITS >> 5, np.int64)
    for batch in batches:
        for chunk in _chunks(batch.column(0)):
            every = np.arange(len(chunk.start))
            slots = _slots(chunk.hashes(every, every)).reshape(-1)
            np.bitwise_or.at(cells, slots >> 5, 1 << (slots & 31))
    some = np.flatnonzero(cells)
    for a in range(0, len(some), 1 << 16):
        part = some[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], ["cell", "bits"])


def _filter(words: DataFrame) -> np.ndarray:
    """The filter of the words: FILTER_BITS bits reach the driver at most, two of them set for each word."""
    cells = np.zeros(FILTER_BITS >> 5, np.uint32)
    for batch in in_batches(words, _set_bits, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        cells[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    return cells


def _spaced(cells, most: int):
    """(variant) of every n-gram of 2 to ``most`` words whose glued form may be a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = cells.value
        for batch in batches:
            for chunk in _chunks(batch.column(0)):
                out = []
                for m in range(2, most + 1):
                    first = chunk.grams(m)
                    one, other = _slots(chunk.hashes(first, first + m - 1))
                    hit = first[(bits[one >> 5] >> (one & 31).astype(np.uint32) & bits[other >> 5] >> (other & 31).astype(np.uint32) & np.uint32(1)).astype(bool)]
                    out += [chunk.form(f, f + m - 1) for f in hit.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["variant"])

    return run


def conflict_index(texts: DataFrame, most: int = 6) -> DataFrame:
    """(key, variant, n) of the keys that stand both glued and spaced: the part of ``ngram_index`` that conflicts and series need.

    texts has one column, of texts of any number of lines; null texts have none. A glued form is a single word, so the distinct words are counted first. An n-gram of several words is worth a
    row only if its glued form is one of them: a filter of the words (broadcast, of fixed size) drops nearly all others where they are read, an
    exact join the rest.
    """
    text = texts.columns[0]
    each = texts.select(F.explode(F.split(text, "[ \n]")).alias("key")).where("key != ''")
    words = cut(each.groupBy("key").agg(F.count("*").alias("n")))
    cells = texts.sparkSession.sparkContext.broadcast(_filter(words.select("key")))
    spaced = in_batches(texts.select(text), _spaced(cells, most), "variant string").groupBy("variant").agg(F.count("*").alias("n"))
    spaced = cut(spaced.select(F.translate("variant", " ", "").alias("key"), "variant", "n").join(words, "key", "left_semi"))
    glued = words.join(spaced.select("key").distinct(), "key", "left_semi").select("key", F.col("key").alias("variant"), "n")
    return glued.unionByName(spaced)


def ngram_index(lines: DataFrame, most: int = 6, shortest: int = 1) -> DataFrame:
    """(key, variant, n): word n-grams of up to ``most`` words of every line, keyed by themselves without spaces.

    Partial counts meet before the shuffle, so a frequent n-gram sends one row per task.
    """
    words = lines.select(F.filter(F.split("line", " "), lambda w: w != "").alias("w"))

    # The n-grams are built inside the row, each from the one a word shorter, so that only strings are exploded and no row carries its line's words.
    grown = words.withColumn("g1", F.col("w"))
    for m in range(2, most + 1):
        left = F.size("w") - (m - 1)
        longer = F.zip_with(F.slice(f"g{m - 1}", F.lit(1), left), F.slice("w", F.lit(m), left), lambda x, y: F.concat(x, F.lit(" "), y))
        grown = grown.withColumn(f"g{m}", F.when(left > 0, longer).otherwise(F.array().cast("array<string>")))
    grams = grown.select(F.explode(F.flatten(F.array(*[f"g{m}" for m in range(1, most + 1)]))).alias("variant"))
    return grams.withColumn("key", F.translate("variant", " ", "")).where(F.length("key") >= shortest).groupBy("key", "variant").agg(F.count("*").alias("n"))


def gram_counts(texts: DataFrame, most: int = 6, hidden: str = "") -> DataFrame:
    """(words, n): how many n-grams of so many words the texts hold, repeats included; those whose glued form begins with ``hidden`` do not count.

    Places are counted where they are read, so no n-gram is built or sent.
    """
    beginning = np.frombuffer(hidden.encode(), np.uint8)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(most + 1, np.int64)
        for batch in batches:
            for chunk in _chunks(batch.column(0)):
                begins = np.full(len(chunk.start), len(beginning) > 0)
                for k, byte in enumerate(beginning):
                    at = chunk.glued_start + k
                    begins &= np.append(chunk.glued, 0)[np.minimum(at, len(chunk.glued))] == byte
                for m in range(1, most + 1):
                    first = chunk.grams(m)
                    long = chunk.glued_end[first + m - 1] - chunk.glued_start[first] >= len(beginning)
                    n[m] += len(first) - np.count_nonzero(begins[first] & long)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, most + 1, dtype=np.int32)), pa.array(n[1:])], ["words", "n"])

    return in_batches(texts.select(texts.columns[0]), run, "words int, n long").groupBy("words").agg(F.sum("n").alias("n"))


def conflicts(index: DataFrame) -> DataFrame:
    """(key, n_variants, total, recommended) of keys with a glued and a spaced form.

    Recommended is the commonest form; of equals the glued one, then the one with fewer spaces, then the first by name.
    """
    glued = F.col("key") == F.col("variant")
    spaces = F.length("variant") - F.length("key")
    best = F.min(F.struct((-F.col("n")).alias("n"), spaces.alias("spaces"), F.col("variant").alias("variant")))["variant"]
    found = index.groupBy("key").agg(F.count("*").alias("n_variants"), F.sum("n").alias("total"), best.alias("recommended"), F.bool_or(glued).alias("g"), F.bool_or(~glued).alias("s"))
    return found.where("g and s").drop("g", "s")


def with_affix(index: DataFrame) -> DataFrame:
    """Variants of conflicting keys with their series affix: the first word of the key's first spaced form by name."""
    forms = F.collect_list(F.struct("variant", "n")).alias("forms")
    keys = index.groupBy("key").agg(*_two_forms(), forms).where("g and spaced is not null")
    return keys.select("key", F.substring_index("spaced", " ", 1).alias("affix"), F.inline("forms"))


def _two_forms() -> list:
    """Aggregates of a key: its first spaced form by name, and whether it has the glued one."""
    spaced = F.when(F.col("variant") != F.col("key"), F.col("variant"))
    return [F.min(spaced).alias("spaced"), F.bool_or(F.col("variant") == F.col("key")).alias("g")]


def series_trend(variants: DataFrame) -> DataFrame:
    """(affix, n_keys, total, glued_share) of series: glued counts' share, 0.5 if there are none."""
    glued = F.sum(F.when(F.col("variant") == F.col("key"), F.col("n")).otherwise(0))
    return variants.groupBy("affix").agg(F.countDistinct("key").alias("n_keys"), F.sum("n").alias("total"), F.round(F.coalesce(glued / F.sum("n"), F.lit(0.5)), 6).alias("glued_share"))


def series_majority(variants: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(affix, key, preselected): in series leaning one way by the threshold, each key's form of that way."""
    glued = F.col("variant") == F.col("key")
    best = lambda which: F.min(F.when(which, F.struct((-F.col("n")).alias("n"), F.col("variant").alias("variant"))))["variant"]
    keys = variants.groupBy("affix", "key").agg(F.sum("n").alias("total"), F.sum(F.when(glued, F.col("n")).otherwise(0)).alias("glued"), best(glued).alias("one"), best(~glued).alias("several"))
    series = Window.partitionBy("affix")
    share = F.round(F.coalesce(F.sum("glued").over(series) / F.sum("total").over(series), F.lit(0.5)), 6)
    leaning = keys.withColumn("share", share).where((F.col("share") >= threshold) | (F.col("share") <= round(1 - threshold, 6)))
    return leaning.select("affix", "key", F.when(F.col("share") >= threshold, F.col("one")).otherwise(F.col("several")).alias("preselected")).where("preselected is not null")


def satellites(index: DataFrame, shortest: int = 4) -> DataFrame:
    """(key, affix): keys with one form alone, given to the longest series affix they begin with (of equals there is one).

    The join is on equal prefixes of every length, not on a startswith condition, so it hashes. Both sides come from one
    grouping of the index by key, whose exchange Spark reuses.
    """
    keys = index.groupBy("key").agg(F.count("*").alias("k"), *_two_forms())
    single = keys.where("k = 1 and (g or spaced is not null)").select("key")
    affixes = keys.where("k >= 2 and g and spaced is not null").select(F.substring_index("spaced", " ", 1).alias("affix")).where(F.length("affix") >= shortest)
    lengths = F.explode(F.sequence(F.lit(shortest), F.length("key") - 1)).alias("len")
    heads = single.where(F.length("key") > shortest).select("key", lengths).select("key", "len", F.expr("substring(key, 1, len)").alias("affix"))
    hit = heads.join(affixes.select("affix").distinct(), "affix")
    return hit.groupBy("key").agg(F.max(F.struct("len", "affix"))["affix"].alias("affix"))


def first_of(df: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
