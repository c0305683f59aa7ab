"""Figures and orders of result reports: totals, dominance, titles, spans, quotas and last mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed

#: Checks a day, and on a day with feedback.
LIMIT, LIMIT_WITH_FEEDBACK = 1, 2
#: Share from which a spacing is dominant.
DOMINANT = 0.8


def dominant_spacing(glued: Column, spaced: Column, share: float = DOMINANT) -> Column:
    """'glued' or 'spaced' if that share of all findings is of that kind, else null."""
    total = glued + spaced
    return F.when(glued / total >= share, "glued").when(spaced / total >= share, "spaced")


def spacing_totals(variants: DataFrame, by: str) -> DataFrame:
    """(by, glued, spaced, total, dominant) of variants (by, variant, n)."""
    is_spaced = F.col("variant").contains(" ")
    sums = variants.groupBy(by).agg(F.sum(F.when(is_spaced, 0).otherwise(F.col("n"))).alias("glued"), F.sum(F.when(is_spaced, F.col("n")).otherwise(0)).alias("spaced"))
    return sums.withColumn("total", F.col("glued") + F.col("spaced")).withColumn("dominant", dominant_spacing(F.col("glued"), F.col("spaced")))


def standalone_title(line: Column, title: Column) -> Column:
    """Whether a line is the title alone, or the title and up to three closing marks."""
    a, b = squeezed(line), squeezed(title)
    rest = F.trim(F.substr(a, F.length(b) + 1))
    return (a != "") & (b != "") & F.startswith(a, b) & (F.length(rest) <= 3) & rest.rlike(r"^[.:：)·\\s]*$")


def stem_span(matched: Column, stems: list[str]) -> Column:
    """(offset, text) of the longest stem that a match ends with, else of the whole match."""
    out = F.struct(F.lit(0).alias("offset"), matched.alias("text"))
    for s in sorted(stems, key=len):
        out = F.when(F.endswith(matched, F.lit(s)), F.struct((F.length(matched) - len(s)).alias("offset"), F.lit(s).alias("text"))).otherwise(out)
    return out


def stems_of(cell: Column, label: Column) -> Column:
    """A cell's comma list; null if it is empty or only repeats the label."""
    items = F.filter(F.transform(F.split(cell, "[,，]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((F.size(items) > 0) & ~((F.size(items) == 1) & (items[0] == label)), items)


def checks_left(used: Column, with_feedback: Column, bonus: Column) -> Column:
    """Checks that are left: of the day's limit, and of the bonus."""
    limit = F.when(with_feedback, LIMIT_WITH_FEEDBACK).otherwise(LIMIT)
    return F.greatest(F.lit(0), limit - F.least(F.greatest(F.lit(0), used), limit)) + F.greatest(F.lit(0), bonus)


def last_mappings(rules: DataFrame) -> DataFrame:
    """(correction, unified): of rules (ord, correction, unified) the last unified form of each correction; blank ones do not count."""
    good = rules.select("ord", F.trim("correction").alias("correction"), F.trim("unified").alias("unified")).where("correction != '' and unified != ''")
    return good.groupBy("correction").agg(F.max_by("unified", "ord").alias("unified"))


def book_page(page: Column) -> Column:
    """Printed number of a file page in a book without shifts."""
    return F.greatest(F.lit(1), page)


def page_of_printed_left(left: Column, shift: int, anchor: int, first_single: bool = True) -> Column:
    """File page of a printed left page: in the body (shifted) from the anchor on, before it in the front matter."""
    body, front = (left - shift) / 2 + 1, left / 2 + 1
    natural = (1 if anchor <= 1 else (anchor - 1) * 2) if first_single else anchor * 2 - 1
    out = F.when((body >= anchor) & (body == F.floor(body)), body).when((front >= 2) & (front < anchor), front).when(left == natural + shift, F.lit(float(anchor))).otherwise(F.greatest(F.lit(1.0), F.floor(front + 0.5).cast("double")))
    return F.when(left <= 1, 1.0).otherwise(out) if first_single else out
