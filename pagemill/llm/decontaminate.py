"""Benchmark decontamination (operator 4): template windows, hash-joined, with a check of slot consistency.

Words are canonicalised: numbers become <number>, capitalised words inside a sentence <name>, unit words <unit>;
all others count in lower case. A capitalised word that opens a sentence may be a name or not: windows with such words are taken in
both readings, all of them plain and all of them <name>, and an item's window is found by either. Every 8 consecutive canonical words of a benchmark item and of a document are a
template window. Windows with at least half plain words join on the hash of their form, denser ones on that of their words (so only
word for word). Along one alignment (document position minus
item position) each slot value of the item should stand against one value of the document: then the text is the item, or the
item with other parameters. The commonest value counts (its places are counted; of equals the item's own, then the least hash); windows
that disagree with it in more than half of their slots count for nothing.

A document is contaminated by an item if consistent windows cover at least half of the item's windows, or half of those of them that
have a form: of the dense ones an item with other parameters cannot show any.

A Bloom filter over the benchmark's window hashes, of a fixed size, spares documents' other windows the
shuffle; if the benchmark outgrows it, it only lets more windows through. Items shorter than a window are one window; items under
``LEAST`` words are no passage and mark only documents that hold nothing else. A frequent window makes one side of the join skewed,
which adaptive execution splits. Units and names are told by short fixed rules.

Defined results: null and empty texts and items have no windows; rows of one doc_id are told apart by their text; a null doc_id is
judged like any other; items of null id are left out; several rows of one item_id count as items of their own by text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .session import cut, in_batches, whole_text

WINDOW = 8
COVER = 0.5
#: Words of an item from which it is looked for inside of documents.
LEAST = 3
#: Bits of the Bloom filter (8 MB), whatever the size of the benchmark.
FILTER_BITS = 1 << 26

# Unit words.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "ounce", "ounces", "pound", "pounds", "gallon", "gallons", "liter", "liters", "litre", "litres", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "gram", "grams", "kilogram", "kilograms", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh", "usd", "eur"]

APOSTROPHES = "\u2018\u2019\u201b\u02bc\u2032"
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
POINT = np.zeros(256, bool)
POINT[[ord("."), ord(",")]] = True
STOP = np.zeros(256, bool)
STOP[[ord("."), ord("!"), ord("?"), ord("\n"), ord(":")]] = True
#: Sets the hashes of dense windows apart from those of forms.
DENSE = np.uint64(0x5555555555555555)
#: Hashes that stand for typed placeholders.
NUMBER, NAME, UNIT = (np.uint64(0x1111111111111111 * k) for k in (1, 2, 3))


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(ta.split(raw, np.array([0, len(raw)]), ~ta.WHITE[raw]).hashes())


UNIT_HASHES = _unit_hashes()


def canonical(raw: np.ndarray, offsets: np.ndarray) -> tuple[ta.Words, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words, their lower-case hashes, and two readings, with words that open sentences plain and as names: canonical hashes and which are slots."""
    n = len(raw)
    digit, point, letter = DIGIT[raw], POINT[raw], LETTER[raw]
    inner = np.zeros(n, bool)
    if n > 2:
        inner[1:-1] = (point[1:-1] & digit[:-2] & digit[2:]) | ((raw[1:-1] == ord("'")) & letter[:-2] & letter[2:])
    words = ta.split(ta.LOWER[raw], offsets, letter | digit | inner)
    plain = words.hashes()
    stops = np.concatenate([[0], np.cumsum(STOP[raw] & ~inner)])
    before = np.concatenate([[0], words.end[:-1]])[: len(words.start)]
    opens = (stops[words.start] > stops[before]) | np.isin(np.arange(len(words.start)), words.first[:-1])
    number = digit[words.start] if len(words.start) else np.zeros(0, bool)
    capital = UPPER[raw[words.start]] if len(words.start) else number
    # Units of one letter are units behind a number only.
    behind = np.concatenate([[False], number[:-1]]) & ~np.isin(np.arange(len(words.start)), words.first[:-1])
    may_be_unit = (words.end - words.start > 1) | behind[: len(words.start)]
    readings = []
    for name in (capital & ~opens, capital):
        unit = np.isin(plain, UNIT_HASHES) & may_be_unit & ~number & ~name
        readings.append((np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, plain))), number | name | unit))
    return words, plain, readings


def without_marks(texts: pa.Array) -> pa.Array:
    """Typographic apostrophes become plain ones; other characters outside ASCII that are no letters, marks or digits part words."""
    plain = pc.replace_substring_regex(texts, f"[{APOSTROPHES}]", "'")
    return pc.replace_substring_regex(plain, r"[^\p{L}\p{M}\p{N}\x00-\x7F]", " ")


def _filter_places(hashes: np.ndarray) -> np.ndarray:
    return np.stack([hashes % np.uint64(FILTER_BITS), (hashes >> np.uint64(32)) % np.uint64(FILTER_BITS), ta.mix(hashes) % np.uint64(FILTER_BITS)]).astype(np.int64)


def _window_rows(window: int, named: bool, bits=None, known=None):
    """Rows of template windows: of items (named; short items give one window) or of documents.

    Of documents, those that the broadcast filter passes, of the broadcast sizes that items have.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = None if named else np.frombuffer(bits.value, np.uint8)
        sizes = range(1, window + 1) if named else known.value
        for batch in batches:
            raw, offsets = ta.buffers(without_marks(batch.column(2)))
            for a, b in ta.chunks(offsets):
                words, plain, readings = canonical(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for size in sizes:
                    every = np.flatnonzero(ta.inside(words.row, size))
                    if named and size < window or size < LEAST:
                        every = every[np.diff(words.first)[words.row[every]] == size]
                    if not len(every):
                        continue
                    turned = np.concatenate([[0], np.cumsum(readings[0][0] != readings[1][0])])
                    n_slots = [np.concatenate([[0], np.cumsum(slot)]) for _, slot in readings]
                    n_slots = [n[every + size] - n[every] for n in n_slots]
                    for k, (form, slot) in enumerate(readings):
                        # The second reading only where it differs; a window dense in the first is the same row in both.
                        chosen = (turned[every + size] > turned[every]) & (n_slots[0] * 2 <= size) if k else np.ones(len(every), bool)
                        at, solid = every[chosen], n_slots[k][chosen] * 2 <= size
                        hashes = np.where(solid, ta.windows(form, size)[at], ta.mix(ta.windows(plain, size)[at] ^ DENSE))
                        good = np.ones(len(at), bool)
                        if passes is not None:
                            for place in _filter_places(hashes):
                                good &= (passes[place >> 3] >> (place & 7) & 1).astype(bool)
                        at, hashes, solid = at[good], hashes[good], solid[good]
                        if not len(at):
                            continue
                        values = np.where(slot[at[:, None] + np.arange(size)] | ~solid[:, None], plain[at[:, None] + np.arange(size)], np.uint64(0))
                        row = words.row[at]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(a, b - a).take(pa.array(row)), batch.column(1).slice(a, b - a).take(pa.array(row)), pa.array(ta.signed(hashes)), pa.array((at - words.first[row]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, size, dtype=np.int32)), pa.array(ta.signed(values.reshape(-1)))), pa.array(solid)],
                            ["id", "text_id", "hash", "at", "slots", "solid"],
                        )

    return run


WINDOWS = "id long, text_id long, hash long, at int, slots array<long>, solid boolean"


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(whole_text()).alias("text_id"), whole_text().alias("text"))


def _filter_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the hashes in the filter, as (word, bits) with equal words merged."""
    for batch in batches:
        places = np.unique(_filter_places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).reshape(-1))
        words, first = np.unique(places >> 5, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.bitwise_or.reduceat(np.int64(1) << (places & 31), first) if len(first) else words)], ["word", "bits"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """(doc_id, text_id, item_id, n_windows, coverage, same_slots) of each document text and item it contains.

    n_windows are the item's windows found with consistent slots, coverage their share of the item's (or of those with a form, the greater),
    same_slots whether all slot values are the item's own, in windows that disagree as well.
    """
    context = docs.sparkSession.sparkContext
    items = cut(in_batches(_texts(benchmark, "item_id").where("id is not null").dropDuplicates(["id", "text_id"]), _window_rows(window, True), WINDOWS))
    sizes = [r.n for r in items.select(F.size("slots").alias("n")).distinct().collect()]  # at most ``window`` numbers
    words = in_batches(items.select("hash").distinct(), _filter_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    filled = words.toArrow()  # at most FILTER_BITS / 32 rows
    bits[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    found = in_batches(_texts(docs, "doc_id"), _window_rows(window, False, context.broadcast(bits.tobytes()), context.broadcast(sizes)), WINDOWS)
    total = items.groupBy("id", "text_id").agg(F.countDistinct("at").alias("of"), F.countDistinct(F.when(F.col("solid"), F.col("at"))).alias("of_solid")).select(F.col("id").alias("item_id"), F.col("text_id").alias("item_text"), "of", "of_solid")
    theirs = items.select(F.col("id").alias("item_id"), F.col("text_id").alias("item_text"), "hash", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.max("solid").over(Window.partitionBy("id", "text_id", "at")).alias("item_solid"))
    slots = F.filter(F.transform(F.arrays_zip("item_slots", "slots"), lambda x, k: F.struct((F.col("item_at") + k).alias("at"), x["item_slots"].alias("mine"), x["slots"].alias("theirs"))), lambda x: x["mine"] != 0)
    pairs = cut(found.join(theirs, "hash").select("id", "text_id", "item_id", "item_text", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "item_solid", slots.alias("slots")))
    place = ["id", "text_id", "item_id", "item_text", "shift"]
    votes = pairs.select(*place, F.explode("slots").alias("x")).select(*place, "x.*").distinct().groupBy(*place, "mine", "theirs").agg(F.count("*").alias("n"))
    best = votes.groupBy(*place, "mine").agg(F.min(F.struct((-F.col("n")).alias("n"), (F.col("mine") != F.col("theirs")).alias("other"), "theirs"))["theirs"].alias("theirs"))
    chosen = best.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("mine", "theirs"))).alias("chosen")).select(*[F.col(c).alias("c_" + c) for c in place], "chosen")
    on = F.lit(True)
    for c in place:
        on = on & pairs[c].eqNullSafe(F.col("c_" + c))
    agrees = F.size(F.filter("slots", lambda x: F.element_at("chosen", x["mine"]) == x["theirs"])) * 2 >= F.size("slots")
    judged = pairs.join(chosen, on, "left").select(*place, "item_at", "item_solid", F.forall("slots", lambda x: x["mine"] == x["theirs"]).alias("same"), F.coalesce(agrees, F.lit(True)).alias("agrees"))
    aligned = judged.groupBy(*place).agg(F.collect_set(F.when(F.col("agrees"), F.col("item_at"))).alias("at"), F.collect_set(F.when(F.col("agrees") & F.col("item_solid"), F.col("item_at"))).alias("solid"), F.bool_and("same").alias("same")).where(F.size("at") > 0)
    per_item = aligned.groupBy(*place[:-1]).agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("solid")))).alias("n_solid"), F.bool_and("same").alias("same_slots"))
    scored = per_item.join(total, ["item_id", "item_text"]).withColumn("coverage", F.greatest(F.col("n_windows") / F.col("of"), F.when(F.col("of_solid") > 0, F.col("n_solid") / F.col("of_solid")).otherwise(0.0)))
    return scored.where(F.col("coverage") >= cover).select(F.col("id").alias("doc_id"), "text_id", "item_id", "n_windows", "coverage", "same_slots")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """docs with n_items, item_ids (sorted, comma-joined) and coverage (the largest, 0 if none); columns of these names are replaced."""
    found = contamination(docs, benchmark, window, cover).groupBy(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text")).agg(
        F.countDistinct("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_ids"), F.max("coverage").alias("coverage")
    )
    base = docs.drop("n_items", "item_ids", "coverage")
    joined = base.join(found, base["doc_id"].cast("long").eqNullSafe(found["__doc"]) & (F.xxhash64(F.coalesce(base["text"], F.lit(""))) == found["__text"]), "left")
    return joined.select(*[base[c] for c in base.columns], F.coalesce(found["n_items"], F.lit(0).cast("long")).alias("n_items"), F.coalesce(found["item_ids"], F.lit("")).alias("item_ids"), F.coalesce(found["coverage"], F.lit(0.0)).alias("coverage"))
