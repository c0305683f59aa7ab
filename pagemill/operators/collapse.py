"""Clusters of spacing variants made one where one goes on from another: rows (key, variant, n) in, fewer of them out.

What absorbs another adds its glued count to its own glued form and the count of its spaced form (see ``clusters.heads``) to its own; other forms of what is absorbed go.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wording
from ..sources.shared import cut, discard
from .clusters import heads, is_spaced, merged, nested


def absorbed(clusters: DataFrame, moves: DataFrame) -> DataFrame:
    """Clusters after moves (key, into); no key that something moves into moves itself."""
    each = heads(clusters).join(moves.where("key != into"), "key", "left")
    gain = each.where("into is not null").groupBy("into").agg(F.sum("glued").alias("g"), F.sum(F.coalesce("n_spaced", F.lit(0))).alias("s")).withColumnRenamed("into", "key")
    forms = each.where("into is null").join(gain, "key").select("key", F.explode(F.array(F.struct(F.col("key").alias("variant"), F.col("g").alias("n")), F.struct(F.col("spaced").alias("variant"), F.col("s").alias("n")))).alias("x"))
    left = clusters.select("key", "variant", "n").join(moves.where("key != into").select("key"), "key", "left_anti")
    return merged(left, forms.select("key", "x.variant", "x.n").where("variant is not null"))


def nested_moves(clusters: DataFrame) -> DataFrame:
    """(key, into): a cluster nested in others goes to the shortest of them that is not nested itself.

    Nesting is transitive, so every nested cluster has such a one: nothing has to follow a chain.
    """
    pairs = nested(clusters)
    tops = pairs.join(pairs.select(F.col("key").alias("under")).distinct(), "under", "left_anti")
    return tops.groupBy("key").agg(F.min_by("under", F.length("under")).alias("into"))


def without_nested(clusters: DataFrame) -> DataFrame:
    """Clusters with one whose spaced form begins with the same two words and goes on absorbed by the shorter one."""
    return absorbed(clusters, nested_moves(clusters))


def _letters(word: Column, letters: str) -> Column:
    return F.regexp_count(word, F.lit(f"[{letters}]"))


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning."""
    return F.when(b.isNull(), 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), lambda k: (F.left(a, k) == F.left(b, k)) & (F.length(a) >= k) & (F.length(b) >= k))))


def shared_beginnings(clusters: DataFrame, pivot: str = "first", least: int = 2, letters: str = "가-힣") -> DataFrame:
    """Clusters of two words that share one of them (the pivot): the other word is cut to the longest beginning it shares with any of them, and equal keys become one.

    A beginning has ``least`` letters or more. The longest one shared with any is shared with a neighbour in the order of words, so a window suffices; it holds only
    words that begin with the same characters, so that a common pivot is no hot group. Of equal keys the one whose key was shortest, then first by name, keeps its forms.
    """
    other = "second" if pivot == "first" else "first"
    words = F.filter(F.split("spaced", r"\s+"), lambda w: w != "")
    all_heads = heads(clusters).withColumn("w", words)
    two = all_heads.where(F.size("w") == 2).select("key", "glued", "n_spaced", F.get("w", F.lit(0)).alias("first"), F.get("w", F.lit(1)).alias("second"))
    near = Window.partitionBy(pivot, F.left(other, F.lit(least))).orderBy(other, "key")
    size = F.greatest(*[_common(F.col(other), f(other).over(near)) for f in (F.lag, F.lead)])
    cored = two.withColumn("core", F.left(F.col(other), size)).where((_letters(F.col("core"), letters) >= least) & (F.length("core") < F.length(other)))
    a, b = ("first", "core") if pivot == "first" else ("core", "second")
    cored = cored.select("key", F.concat(a, b).alias("new"), F.concat(F.col(a), F.lit(" "), F.col(b)).alias("spaced"), "glued", "n_spaced")
    # Cut clusters have their two forms, the others all of theirs; of clusters of one key the first one's forms stay.
    forms = F.array(F.struct(F.col("new").alias("variant"), F.col("glued").alias("n")), F.struct(F.col("spaced").alias("variant"), F.col("n_spaced").alias("n")))
    cut_rows = cored.select(F.col("new").alias("key"), F.col("key").alias("old"), F.explode(forms).alias("x")).select("key", "old", "x.variant", "x.n")
    rest = clusters.join(cored.select("key"), "key", "left_anti").select("key", F.col("key").alias("old"), "variant", "n")
    rows = cut_rows.unionByName(rest)
    first = rows.groupBy("key").agg(F.min(F.struct(F.length("old").alias("size"), F.col("old").alias("old")))["old"].alias("keeper"), F.min("old").alias("one"), F.max("old").alias("two"))
    several = first.where("one != two").select("key", "keeper")
    kept = rows.join(several, "key", "left").where("keeper is null or old = keeper")
    gone = rows.join(several, "key").where("old != keeper")
    # Within what goes, every cluster adds its glued and its first spaced count.
    gains = heads(gone.select(F.struct("key", "old").alias("key"), "variant", "n")).groupBy(F.col("key.key").alias("key")).agg(F.sum("glued").alias("g"), F.sum(F.coalesce("n_spaced", F.lit(0))).alias("s"))
    keepers = heads(kept.select("key", "variant", "n")).join(gains, "key")
    extra = keepers.select("key", F.explode(F.array(F.struct(F.col("key").alias("variant"), F.col("g").alias("n")), F.struct(F.col("spaced").alias("variant"), F.col("s").alias("n")))).alias("x"))
    return merged(kept.select("key", "variant", "n"), extra.select("key", "x.variant", "x.n").where("variant is not null"))


def unit_moves(clusters: DataFrame, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """(key, into): a key that begins with the key of a cluster of two words of ``least`` letters or more goes to the shortest such one.

    One by one, a key goes to the longest such unit, and that to the longest one it begins with in its turn: the chain ends at the shortest.
    """
    every = heads(clusters)
    words = F.filter(F.split("spaced", r"\s+"), lambda w: w != "")
    units = every.where((F.size(words) == 2) & F.forall(words, lambda w: _letters(w, letters) >= least)).select(F.col("key").alias("into"))
    sizes = F.sequence(F.lit(2 * least), F.length("key") - 1)
    begun = every.where(F.length("key") > 2 * least).select("key", F.explode(sizes).alias("k")).select("key", F.expr("left(key, k)").alias("into"))
    return begun.join(units, "into").groupBy("key").agg(F.min_by("into", F.length("into")).alias("into"))


def shorter_units(clusters: DataFrame, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """Clusters that go on from a unit of two words absorbed by it."""
    return absorbed(clusters, unit_moves(clusters, least, letters))


def cleaned(clusters: DataFrame, letters: str = "가-힣") -> DataFrame:
    """Clusters without punctuation in their forms; forms and keys that become equal add up, empty ones go."""
    form = wording.without_marks(F.col("variant"), letters)
    return clusters.select(F.regexp_replace(form, r"\s+", "").alias("key"), form.alias("variant"), "n").where("key != ''").groupBy("key", "variant").agg(F.sum("n").alias("n"))


def normalised(clusters: DataFrame, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """Clusters cleaned, without nested ones, cut to shared beginnings on either side, and absorbed by shorter units.

    Every step reads its clusters several times, so they are a table between two steps.
    """
    x = cut(cleaned(clusters, letters))
    for step in (without_nested, *[partial(shared_beginnings, pivot=p, least=least, letters=letters) for p in ("first", "second")]):
        before, x = x, cut(step(x))
        discard(before)
    return shorter_units(x, least, letters)


def conflicting(clusters: DataFrame) -> DataFrame:
    """Clusters with a glued and a spaced form found at least once each."""
    both = clusters.where("n > 0").groupBy("key").agg(F.bool_or(is_spaced(F.col("variant"))).alias("s"), F.bool_or(~is_spaced(F.col("variant"))).alias("g")).where("s and g")
    return clusters.join(both.select("key"), "key", "left_semi")
