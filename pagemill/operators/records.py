"""Records of projects and reports: field-wise merges, saved sets, bundles of a report, visible results, free names, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_meta(primary: DataFrame, secondary: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """primary's rows with the fields of whichever side was changed later; if both or neither were, primary's where it has one."""
    other = secondary.select(F.col(key).alias("__k"), F.lit(True).alias("__has"), F.col(at).alias("__at"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = primary.join(other, F.col(key) == F.col("__k"), "left")
    when = lambda c: F.coalesce(F.col(c).cast("timestamp"), F.lit("1970-01-01").cast("timestamp"))
    alone, later, earlier = F.col("__has").isNull(), when("__at") > when(at), when("__at") < when(at)
    theirs = lambda f: F.col("__at" if f == at else f"__{f}")
    merged = lambda f: F.when(alone | earlier, F.col(f)).when(later, theirs(f)).otherwise(F.coalesce(F.col(f), theirs(f))).alias(f)
    return both.select(*[merged(c) if c in (at, *fields) else F.col(c) for c in primary.columns])


def persist_merge(disk: DataFrame, memory: DataFrame, key: str, at: str, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Sets of a window (memory) and of the store (disk) before saving: the newer of both, memory's of equally old ones.

    Saved sets that the store has lost meanwhile go, if all it still has are the window's too and are fewer; the sets that the
    window has just ``added`` (key) stay. Sets that only the store has come back, but those that the window has ``removed``.
    """
    new, gone = added.select(key).distinct(), removed.select(key).distinct()
    saved = lambda df: df.where(F.col(at).isNotNull())
    d, m = saved(disk).select(key), saved(memory).select(key)
    counts = d.agg(F.count("*").alias("d")).join(F.broadcast(m.join(new, key, "left_anti").agg(F.count("*").alias("m"))))
    counts = counts.join(F.broadcast(d.join(m, key, "left_anti").agg(F.count("*").alias("lost"))))
    sizes = disk.agg(F.count("*").alias("disk")).join(F.broadcast(memory.agg(F.count("*").alias("memory"))))
    verdict = counts.join(F.broadcast(sizes)).select((F.col("memory") == 0).alias("__alone"), ((F.col("d") > 0) & (F.col("d") < F.col("m")) & (F.col("lost") == 0) & (F.col("memory") > 0)).alias("__deleted"))
    columns = [c for c in memory.columns if c != key]
    theirs = disk.select(key, F.struct(*columns).alias("__d"))
    ours = memory.select(key, F.struct(*columns).alias("__m"))
    both = ours.join(theirs, key, "full_outer").join(new.withColumn("__new", F.lit(True)), key, "left").join(gone.withColumn("__gone", F.lit(True)), key, "left").join(F.broadcast(verdict))
    newer = F.coalesce(F.col(f"__d.{at}") > F.col(f"__m.{at}"), F.col(f"__d.{at}").isNotNull() & F.col(f"__m.{at}").isNull())
    lost = F.col("__deleted") & F.col(f"__m.{at}").isNotNull() & F.col(f"__d.{at}").isNull() & F.col("__new").isNull()
    kept = both.where(F.when(F.col("__m").isNotNull(), ~lost).otherwise(F.col("__gone").isNull() | F.col("__alone")))
    chosen = F.when(F.col("__m").isNull(), F.col("__d")).when(F.col("__d").isNotNull() & newer, F.col("__d")).otherwise(F.col("__m"))
    return kept.select(key, chosen.alias("x")).select(key, "x.*")


def merge_counts(a: DataFrame, b: DataFrame, key: str, counts: list[str], granted: str, bonus: list[str], default: int) -> DataFrame:
    """Quotas of two sources: the larger of each count; the bonus of a where it was granted, else of b, else the default."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
    first, second = F.coalesce(f"x.{granted}", F.lit(False)), F.coalesce(f"y.{granted}", F.lit(False))
    left = lambda c: F.when(first, F.col(f"x.{c}")).when(second, F.col(f"y.{c}")).otherwise(F.lit(default)).alias(c)
    return both.select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), *[F.greatest(F.coalesce(f"x.{c}", F.lit(0)), F.coalesce(f"y.{c}", F.lit(0))).alias(c) for c in counts], (first | second).alias(granted), *[left(c) for c in bonus])


def bundle_order(rows: DataFrame, bundle: str, order: str, first: Column) -> DataFrame:
    """Rows with their place: those of ``first`` in order, then the others by bundles, in order of each bundle's first row."""
    # A grouping and a join instead of a window, so that a large bundle is no single task.
    opens = rows.where(~first).groupBy(F.col(bundle).alias("__bundle")).agg(F.min(order).alias("__opens"))
    placed = rows.join(opens, F.col(bundle).eqNullSafe(F.col("__bundle")), "left").withColumn("front", first)
    return placed.withColumn("opens", F.when(first, F.col(order)).otherwise(F.col("__opens"))).drop("__bundle", "__opens").orderBy(F.desc("front"), "opens", order)


def report_rows(results: DataFrame, by: list[str], page: str, hidden: Column) -> DataFrame:
    """One row a group: shown, total, and its pages with the number of places on each ("3P 2, 5P"), hidden places aside."""
    pages = results.groupBy(*by, page).agg(F.count("*").alias("n"), F.count_if(~hidden).alias("shown"))
    label = F.concat(F.col(page).cast("string"), F.lit("P"), F.when(F.col("shown") > 1, F.concat(F.lit(" "), F.col("shown").cast("string"))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.when(F.col("shown") > 0, F.struct(F.col(page).alias("page"), label.alias("label")))))
    return pages.groupBy(*by).agg(F.sum("shown").alias("shown"), F.sum("n").alias("total"), F.array_join(F.transform(listed, lambda x: x["label"]), ", ").alias("pages"))


def still_there(state: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """Hidden groups (place null) and hidden places of groups that the results still have."""
    groups = state.where("place is null").join(results.select(*by).distinct(), by, "left_semi")
    places = state.where("place is not null").join(results.select(*by, "place").distinct(), [*by, "place"], "left_semi")
    return groups.unionByName(places.select(*groups.columns))


def free_names(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """(name, copy): for each wanted name the first "name(i)" that is not used, i from 1. A number in brackets at its end is not part of a name.

    The numbers in use meet their name by equality; the first gap is found among as many numbers as are in use, and one more.
    """
    base = lambda c: F.trim(F.regexp_replace(F.trim(c), r"\([0-9]+\)$", ""))
    number = F.regexp_extract(F.trim("name"), r"\(([1-9][0-9]{0,8})\)$", 1)
    taken = used.select(F.regexp_replace(F.trim("name"), r"\([0-9]+\)$", "").alias("base"), number.alias("i")).where("i != ''").distinct()
    taken = taken.select("base", F.col("i").cast("int").alias("i"))
    place = F.row_number().over(Window.partitionBy("base").orderBy("i"))
    gap = taken.withColumn("k", place).where("i = k").groupBy("base").agg((F.max("k") + 1).alias("i"))
    names = wanted.select("name", base(F.col("name")).alias("base")).distinct().join(gap, "base", "left")
    return names.select("name", F.concat("base", F.lit("("), F.coalesce("i", F.lit(1)).cast("string"), F.lit(")")).alias("copy"))


def nearest_place(text: Column, phrase: Column, prefer: Column) -> Column:
    """Offset of the phrase's place nearest to the preferred one, of equals the first; null if the text has none. Places may overlap."""
    want = F.greatest(F.lit(0), prefer)
    # What stands before each later place of the phrase, cut at every one of them.
    pieces = F.split(text, F.concat(F.lit(r"(?=\Q"), phrase, F.lit(r"\E)")), -1)
    # A piece is cut before the phrase's end if places overlap, so it is judged with what follows it.
    whole = F.transform(pieces, lambda p, i: F.concat(p, F.array_join(F.slice(pieces, i + 2, F.length(phrase)), "")))
    zipped = F.zip_with(pieces, whole, lambda p, w: F.struct(p.alias("p"), w.alias("w")))

    empty = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"))

    def judged(acc: Column, x: Column) -> Column:
        here = F.startswith(x["w"], phrase)
        nearer = here & (acc["best"].isNull() | (F.abs(acc["at"] - want) < F.abs(acc["best"] - want)))
        return F.struct((acc["at"] + F.length(x["p"])).alias("at"), F.when(nearer, acc["at"]).otherwise(acc["best"]).alias("best"))

    return F.when((phrase != "") & (text != ""), F.aggregate(zipped, empty, judged)["best"])


def covers(left: Column, listed: Column) -> Column:
    """Whether a spread that begins with this printed page shows the listed one."""
    return (F.floor(left) <= F.floor(listed)) & (F.floor(listed) <= F.floor(left) + 1)


def reaches(left: Column, listed: Column) -> Column:
    """Whether a spread shows the listed page or comes after it."""
    return covers(left, listed) | (F.floor(left) >= F.floor(listed))


def with_tag(rows: DataFrame, tag: str | None, starts: bool = False, tags: str = "tags") -> DataFrame:
    """Rows with a tag, or with one that starts so; all rows without a tag to look for."""
    if not tag:
        return rows
    return rows.where(F.exists(tags, lambda t: F.startswith(t, F.lit(tag)) if starts else t == tag))
