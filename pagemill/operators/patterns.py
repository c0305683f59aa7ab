"""Pattern rules: "affix @" or "@ affix" written glued or spaced, taken from choices, and the forms of a corpus that follow them or go against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clusters import heads, is_spaced, is_weak_affix


def _words(form: Column) -> Column:
    return F.filter(F.split(form, r"\s+"), lambda w: w != "")


def candidates(clusters: DataFrame, chosen: DataFrame, least_keys: int = 2, share: float = 0.8, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """(affix_type, affix, direction, keys, findings, score) of rules that the choices (key, chosen) suggest.

    The first and last word of a cluster's spaced form of two words are affixes; a rule has ``least_keys`` keys or more, of which at least that share is chosen glued (or spaced). The score is the
    keys' findings and 10 for each key, as for the support of patterns.
    """
    two = heads(clusters).where(F.size(_words(F.col("spaced"))) == 2).select("key", F.element_at(_words(F.col("spaced")), 1).alias("a"), F.element_at(_words(F.col("spaced")), 2).alias("b"))
    totals = clusters.groupBy("key").agg(F.sum("n").alias("n"))
    each = two.join(chosen.select("key", (~is_spaced(F.col("chosen"))).alias("glued")), "key").join(totals, "key")
    sides = each.select("key", "glued", "n", F.explode(F.array(F.struct(F.lit("prefix").alias("affix_type"), F.col("a").alias("affix")), F.struct(F.lit("suffix").alias("affix_type"), F.col("b").alias("affix")))).alias("x"))
    sums = sides.select("key", "glued", "n", "x.*").where(~is_weak_affix(F.col("affix"), least, letters)).groupBy("affix_type", "affix").agg(F.count("*").alias("keys"), F.count_if("glued").alias("g"), F.sum("n").alias("findings"))
    glued = F.col("g") / F.col("keys")
    direction = F.when(glued >= share, "glued").when(1 - glued >= share, "spaced")
    return sums.where(F.col("keys") >= least_keys).withColumn("direction", direction).where("direction is not null").select("affix_type", "affix", "direction", "keys", "findings", (F.col("findings") + 10 * F.col("keys")).alias("score"))


def forms(index: DataFrame, rules: DataFrame, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """(affix_type, affix, key, form, n, follows, other) of the index' forms (variant, n) of one or two words in a rule's slot, a form and rule once.

    follows says whether the form is written as the rule's direction asks; other is the other way to write it. What stands beside the affix has ``least`` letters or more. Any number of rules costs
    one pass: forms are cut at every length at which a rule's affix ends, and the pieces meet the rules by equality. Only those lengths reach the driver.
    """
    kinds = rules.select("affix_type", "affix", "direction").distinct()
    lengths = {r.affix_type: sorted(r.lengths) for r in kinds.groupBy("affix_type").agg(F.collect_set(F.length("affix")).alias("lengths")).collect()}
    words = _words(F.col("variant"))
    two = F.size(words) == 2
    glued = F.regexp_replace("variant", r"\s+", "")
    base = index.where(F.size(words) <= 2).select(F.col("variant").alias("form"), "n", glued.alias("key"), F.when(two, F.get(words, F.lit(0))).alias("a"), F.when(two, F.get(words, F.lit(1))).alias("b"))
    parts = []
    for kind, end in (("prefix", False), ("suffix", True)):
        sizes = F.array(*[F.lit(k) for k in lengths.get(kind, [])]) if kind in lengths else F.expr("cast(array() as array<int>)")
        whole = F.col("b" if end else "a")
        at = F.when(whole.isNotNull(), F.array(F.length(whole))).otherwise(F.filter(sizes, lambda k: k < F.length("key")))
        each = base.select("form", "n", "key", whole.isNotNull().alias("spaced"), F.explode(at).alias("k"))
        affix = F.expr("right(key, k)") if end else F.expr("left(key, k)")
        rest = F.expr("left(key, length(key) - k)") if end else F.expr("substring(key, k + 1)")
        parts.append(each.select(F.lit(kind).alias("affix_type"), affix.alias("affix"), rest.alias("rest"), "form", "n", "key", "spaced"))
    hit = parts[0].unionByName(parts[1]).where(F.regexp_count("rest", F.lit(f"[{letters}]")) >= least).join(kinds, ["affix_type", "affix"])
    spaced = F.when(F.col("affix_type") == "prefix", F.concat("affix", F.lit(" "), "rest")).otherwise(F.concat("rest", F.lit(" "), "affix"))
    return hit.select("affix_type", "affix", "key", "form", "n", (F.col("spaced") == (F.col("direction") == "spaced")).alias("follows"), F.when(F.col("spaced"), F.col("key")).otherwise(spaced).alias("other"))


def mismatches(index: DataFrame, rules: DataFrame, skip: DataFrame | None = None, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """(affix_type, affix, key, form, other, n) of forms that go against a rule, without the keys to skip."""
    found = forms(index, rules, least, letters).where("not follows").drop("follows")
    return found if skip is None else found.join(skip.select("key").distinct(), "key", "left_anti").select(*found.columns)
