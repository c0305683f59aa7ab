"""Titles: pairs that are similar enough, found by rare grams they share, and one-to-one matching in order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import space_free
from ..sources.shared import cut, discard

#: Similarity from which two titles are the same, and from which one is a hint for the other.
SAME, HINT = 0.88, 0.72
#: Distinct titles of the smaller side up to which every task compares all of them.
FEW = 2000


def _form(title: Column) -> Column:
    """What similarity compares: lower case, without blanks."""
    return F.lower(space_free(title))


def _edits(size: Column, least: float) -> Column:
    """Edits at most between a title of a size and any as similar as ``least``: that share of the longer one, which is at most size / least."""
    return F.floor(F.lit(1 - least) * F.floor(size / F.lit(least) + F.lit(1e-9)) + F.lit(1e-9)).cast("int")


def _grams(titles: DataFrame, least: float) -> DataFrame:
    """(id, form, q, g): the grams of a title, single characters (q = 1) of short ones, pairs of characters (q = 2) of long ones, both of those between."""
    n = F.length("form")
    sizes = range(2, 2000)
    touched = lambda m: 2 * math.floor((1 - least) * math.floor(m / least + 1e-9) + 1e-9)
    # Pairs serve where a title has more of them than edits can touch. Of two similar titles either both are long enough, or both are short enough.
    long_from = next((k for k in sizes if all(m - 1 > touched(m) for m in range(k, 4 * k))), None) if least > 0.7 else None
    one, two = (F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substr("form", i, F.lit(q))) for q in (1, 2))  # noqa: B023
    kinds = [F.struct(F.lit(1).alias("q"), one.alias("g"))]
    if long_from:
        none = F.expr("cast(array() as array<string>)")
        kinds = [F.struct(F.lit(1).alias("q"), F.when(n <= math.floor(long_from / least + 1e-9), one).otherwise(none).alias("g")), F.struct(F.lit(2).alias("q"), F.when(n >= long_from, two).otherwise(none).alias("g"))]
    return titles.select("id", "form", F.inline(F.array(*kinds))).where(F.size("g") > 0)


def _prefixes(titles: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(id, form, q, gram) of the rarest grams of each title: one more than its edits can touch."""
    # The first of equal grams is the gram itself, the second is another one, and so on: grams as a set.
    each = _grams(titles, least).select("id", "form", "q", F.explode("g").alias("gram"))
    numbered = each.groupBy("id", "form", "q", "gram").agg(F.count("*").alias("times")).select("id", "form", "q", "gram", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    ranked = numbered.join(counts, ["q", "gram"], "left").groupBy("id", "form", "q").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "nth"))).alias("all"))
    need = F.least(F.size("all"), F.col("q") * _edits(F.length("form"), least) + 1)
    return ranked.select("id", "form", "q", F.explode(F.slice("all", F.lit(1), need)).alias("x")).select("id", "form", "q", "x.gram", "x.nth")


def _by_grams(ours: DataFrame, theirs: DataFrame, least: float) -> DataFrame:
    """(a, b): candidates of forms of two tables, which share one of the q * e + 1 rarest grams of each."""
    texts = [t.select(F.col("form").alias("id"), "form") for t in (ours, theirs)]
    counts = cut(_grams(texts[1], least).select("q", F.explode("g").alias("gram")).groupBy("q", "gram").agg(F.count("*").alias("n")))
    a, b = (_prefixes(t, counts, least) for t in texts)
    found = a.select(F.col("form").alias("a"), "q", "gram", "nth").join(b.select(F.col("form").alias("b"), "q", "gram", "nth"), ["q", "gram", "nth"])
    return found.where(_sizes_fit(least)).select("a", "b").distinct()


def _sizes_fit(least: float) -> Column:
    a, b = F.length("a"), F.length("b")
    return (a >= F.lit(least) * b - F.lit(1e-9)) & (b >= F.lit(least) * a - F.lit(1e-9))


def near_titles(left: DataFrame, right: DataFrame, least: float = HINT, few: int = FEW) -> DataFrame:
    """(left_id, right_id, score) of all titles (id, title) whose similarity is ``least`` or more, exactly; ``least`` above 0.5.

    Up to ``few`` distinct titles of one side go to every task and are compared with all of the other side whose sizes fit, dealt out evenly. Beyond that, two strings within e edits share one of the q * e + 1 rarest
    grams of each (grams of q characters, rarest in the right table): an equality join on these finds all candidates, and few others. Titles that are null or blank are similar to none. Equal titles are
    compared once, a distance only as far as it can count, and titles too long or too short for any of the other side not at all.
    """
    if not 0.5 < least <= 1:
        raise ValueError("similarities above 0.5, up to 1")
    spark = left.sparkSession
    forms = [cut(t.select(F.col("id"), _form(F.col("title")).alias("form")).where("form != ''")) for t in (left, right)]
    size = F.length("form")
    ends = [f.agg(F.min(size), F.max(size)).first() for f in forms]
    if None in (ends[0][0], ends[1][0]):
        return _named(spark.createDataFrame([], "a string, b string, score double"), forms)
    texts = [f.where((size >= least * shortest - 1e-9) & (least * size <= longest + 1e-9)).select("form").distinct() for f, (shortest, longest) in zip(forms, ends[::-1], strict=True)]
    numbers = [t.limit(few + 1).count() for t in texts]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    if min(numbers) <= few:
        small = numbers.index(min(numbers))
        sides = [F.broadcast(t) if k == small else t.repartition(tasks, "form") for k, t in enumerate(texts)]
        found = sides[0].withColumnRenamed("form", "a").join(sides[1].withColumnRenamed("form", "b"), _sizes_fit(least))
    else:
        found = _by_grams(*texts, least).repartition(tasks, "a", "b")
    longer = F.greatest(F.length("a"), F.length("b"))
    # One edit more than can count, so that rounding decides nothing here.
    near = found.withColumn("most", (F.lit(1 - least) * longer + 1).cast("int")).withColumn("edits", F.expr("levenshtein(a, b, most)")).where("edits >= 0")
    return _named(near.select("a", "b", (1 - F.col("edits") / longer).alias("score")).where(F.col("score") >= F.lit(least)), forms)


def _named(scored: DataFrame, forms: list[DataFrame]) -> DataFrame:
    """(left_id, right_id, score) of forms (a, b, score)."""
    ids = [f.select(F.col("id").alias(n), F.col("form").alias(c)) for f, n, c in zip(forms, ("left_id", "right_id"), "ab", strict=True)]
    return scored.join(ids[0], "a").join(ids[1], "b").select("left_id", "right_id", "score")


def in_order(pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, score) of pairs, one-to-one: each left title in the order of its id takes the best right one that none before it took; of equals the first by id.

    Rounds: every free left title asks for the best one it was not refused; each right one keeps the first of those that ever asked, and refuses the others. Where all right titles prefer the same order, that ends in what taking
    turns gives. A round is a few joins on the pairs; rounds are as many as refusals follow one another.
    """
    left = cut(pairs.select("left_id", "right_id", "score").distinct())
    while True:
        wish = F.min(F.struct((-F.col("score")).alias("s"), F.col("right_id").alias("r")))
        asked = left.groupBy("left_id").agg(wish.alias("w")).select("left_id", F.col("w.r").alias("right_id"), (-F.col("w.s")).alias("score"))
        held = asked.groupBy("right_id").agg(F.min("left_id").alias("holder"))
        refused = cut(asked.join(held, "right_id").where("left_id != holder").select("left_id", "right_id"))
        if refused.isEmpty():
            discard(refused)
            return asked
        before, left = left, cut(left.join(refused, ["left_id", "right_id"], "left_anti"))
        discard(before)
        discard(refused)


def outline(entries: DataFrame, headings: DataFrame, same: float = SAME, hint: float = HINT) -> DataFrame:
    """(left_id, right_id, score, kind) of entries and headings (id, title): ``same`` for pairs one-to-one, ``hint`` for the most similar heading of an entry that has none, ``alone`` for headings that no entry takes."""
    near = cut(near_titles(entries, headings, hint))
    pairs = cut(in_order(near.where(F.col("score") >= same)))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("right_id").alias("r")))
    hints = near.join(pairs.select("left_id"), "left_id", "left_anti").groupBy("left_id").agg(best.alias("w")).select("left_id", F.col("w.r").alias("right_id"), (-F.col("w.s")).alias("score"))
    alone = headings.select(F.col("id").alias("right_id")).join(pairs.select("right_id"), "right_id", "left_anti")
    alone = alone.select(F.lit(None).cast(pairs.schema["left_id"].dataType).alias("left_id"), "right_id", F.lit(None).cast("double").alias("score"))
    return pairs.withColumn("kind", F.lit("same")).unionByName(hints.withColumn("kind", F.lit("hint"))).unionByName(alone.withColumn("kind", F.lit("alone")))
