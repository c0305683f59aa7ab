"""Near spellings: pairs of forms within a few edits, and the spellings that one foreign word in brackets stands behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jamo


def _shorter(form: Column, radius: int) -> Column:
    """A form and all that is left of it without up to ``radius`` characters."""
    out = F.array(form)
    for _ in range(radius):
        once = F.flatten(F.transform(out, lambda f: F.transform(F.sequence(F.lit(1), F.greatest(F.length(f), F.lit(1))), lambda k: F.concat(F.substr(f, F.lit(1), k - 1), F.substr(f, k + 1)))))
        out = F.array_distinct(F.concat(out, once))
    return out


def near_forms(forms: DataFrame, radius: int = 1, form: str = "form") -> DataFrame:
    """(a, b, distance) of all pairs a < b of different forms at an edit distance of up to ``radius`` (1 or 2), exactly.

    Two such forms become equal by taking up to that many characters from each: an equality join on what is left finds every candidate, and the distance is then taken. Null forms are none.
    """
    if radius not in (1, 2):
        raise ValueError("a radius of 1 or 2")
    each = forms.select(F.col(form).alias("f")).where("f is not null").distinct()
    left = each.select("f", F.explode(_shorter(F.col("f"), radius)).alias("rest"))
    pairs = left.select(F.col("f").alias("a"), "rest").join(left.select(F.col("f").alias("b"), "rest"), "rest").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= radius)


def anchored(pairs: DataFrame, radius: int = 1, letters: str = "가-힣") -> DataFrame:
    """(anchor, form, n, majority, distance) of the spellings that stand before one foreign word: pairs (head, inner, n) of a word and what follows it in brackets.

    Anchors are the Latin words, in lower case without blanks. The commonest spelling of an anchor, of equals the first by name, is the majority; others stay if they are
    within ``radius`` edits of it, letter by letter of their syllables. Anchors with one spelling only are none.
    """
    anchor = F.lower(F.regexp_replace("inner", r"\s+", ""))
    clean = pairs.where(F.col("inner").rlike(r"^[A-Za-z][A-Za-z .'-]*$") & F.col("head").rlike(f"^[{letters}]{{2,}}$")).groupBy(anchor.alias("anchor"), F.col("head").alias("form")).agg(F.sum("n").alias("n"))
    best = clean.groupBy("anchor").agg(F.min(F.struct((-F.col("n")).alias("n"), "form"))["form"].alias("majority"))
    close = clean.join(best, "anchor").withColumn("distance", F.levenshtein(jamo(F.col("form")), jamo(F.col("majority")))).where(F.col("distance") <= radius)
    several = close.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    return close.join(several, "anchor", "left_semi").select("anchor", "form", "n", "majority", "distance")
