"""The match operator: where rules match, with offsets, boundary and exclusion filters, overlap folding and grouping."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import in_batches
from ..sources.tables import Rule


FOUND = "rule int, replace string, leading_boundary boolean, category string, before string, start long, matched string"


def _fastest(pattern: str) -> regex.Pattern | re.Pattern:
    """The pattern for the plain engine where that reads it without a doubt, which is faster; else for the one that knows more."""
    known = regex.compile(pattern)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return re.compile(pattern)
    except (re.error, Warning):
        return known


def compiled(rules: list[Rule]) -> tuple[list[tuple[Rule, regex.Pattern]], list[tuple[int, str]]]:
    """Enabled rules with their patterns, and (rule, error) of those whose pattern cannot be read: these match nothing and stop no run."""
    good, bad = [], []
    for r in rules:
        try:
            if r.enabled:
                good.append((r, _fastest(r.pattern())))
        except regex.error as e:
            bad.append((r.ord, str(e)))
    return good, bad


def _plain(text: str | None) -> str:
    return " ".join((text or "").split())


def rejected(rule: Rule, match: regex.Match, text: str) -> bool:
    """Whether a match falls under its rule's exclusions.

    By prefix: its first group is one of them. By phrase: it equals one, or one begins where it begins, or where the longest of
    the rule's stems that it ends with begins. Runs of blanks count as one. An auxiliary verb's match is not one of it (``Auxiliary.is_other``).
    """
    if rule.auxiliary and rule.auxiliary.is_other(match[1], not any(c.isspace() for c in match[0])):
        return True
    if rule.exclude_prefixes and _plain(match[1] if match.re.groups else "") in map(_plain, rule.exclude_prefixes):
        return True
    matched = _plain(match[0])
    stems = [s for s in sorted(rule.stems, key=len, reverse=True) if _plain(s) and matched.endswith(_plain(s))]
    for phrase in rule.exclude_phrases:
        plain = _plain(phrase)
        if plain and (matched == plain or _plain(text[match.start() : match.start() + len(phrase)]) == plain):
            return True
        # A stem's continuation: enough of the text that blanks cannot hide the phrase from view.
        if plain and any(_plain(text[match.end() - len(s) : match.end() - len(s) + 4 * len(phrase)]).startswith(plain) for s in stems):
            return True
    return False


#: Matches that a task holds before it hands them on.
PART_MATCHES = 1 << 14
KINDS = (pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string())


def positions(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """One row per match of each enabled rule: docs' other columns, the rule's, before (the character before it), start and matched.

    Offsets are code points from 0. A task reads each text once, in Arrow batches of bounded bytes, with every rule compiled once, and hands matches on in parts; the text
    goes no further, there is no shuffle, and any number of rules will do. A null text has no matches.
    """
    keep = [c for c in docs.columns if c != text]
    names = [*keep, *[x.split()[0] for x in FOUND.split(", ")]]
    patterns = [(r, p, bool(r.exclude_prefixes or r.exclude_phrases or r.auxiliary)) for r, p in compiled(rules)[0]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, rows, starts, before, found = [], [], [], [], []

            def part() -> pa.RecordBatch:
                kept = batch.take(pa.array(rows, pa.int64()))  # noqa: B023
                of = [patterns[k][0] for k in places]  # noqa: B023
                columns = [[r.ord for r in of], [r.replace for r in of], [r.leading_boundary for r in of], [r.category for r in of], before, starts, found]  # noqa: B023
                out = pa.RecordBatch.from_arrays([*[kept.column(c) for c in range(len(keep))], *[pa.array(c, kind) for c, kind in zip(columns, KINDS, strict=True)]], names)
                for c in (places, rows, starts, before, found):  # noqa: B023
                    c.clear()
                return out

            for k, t in enumerate(batch.column(len(keep)).to_pylist()):
                for place, (r, p, checked) in enumerate(patterns) if t else ():
                    for m in p.finditer(t):
                        a, b = m.span()
                        if b > a and not (checked and rejected(r, m, t)):
                            places.append(place)
                            rows.append(k)
                            starts.append(a)
                            before.append(t[a - 1] if a else "")
                            found.append(t[a:b])
                            if len(rows) >= PART_MATCHES:
                                yield part()
            yield part()

    base = docs.select(*keep, text)
    return in_batches(base, run, T.StructType([*[base.schema[c] for c in keep], *T._parse_datatype_string(FOUND).fields]))


def bad_rules(docs: DataFrame, rules: list[Rule], by: str = "doc_id") -> DataFrame:
    """(rule, docs, error) of all enabled rules: in how many texts each matches, or the error of one that cannot be read, which stops no other."""
    spark = docs.sparkSession
    good, bad = compiled(rules)
    known = spark.createDataFrame([(r.ord, None) for r, _ in good] + bad, "rule int, error string")
    counts = positions(docs, rules).groupBy("rule").agg(F.countDistinct(by).alias("n"))
    return known.join(counts, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("docs"), "error")


def leading_boundary(matches: DataFrame) -> DataFrame:
    """Without matches of boundary rules that follow a letter or digit."""
    return matches.where(~F.col("leading_boundary") | ~F.col("before").rlike(r"[\p{L}\p{N}]"))


def without_excluded(matches: DataFrame, phrases: list[str]) -> DataFrame:
    """Without matches that equal an excluded phrase, spaces aside."""
    plain = F.trim(F.regexp_replace("matched", " +", " "))
    return matches.where(~plain.isin([" ".join(p.split()) for p in phrases]))


def longest_wins(matches: DataFrame, by: list[str]) -> DataFrame:
    """Greedy choice per text: longest first, then earliest, then rule; what overlaps a chosen match goes.

    Overlaps are only possible within a run of touching matches, so the fold works on such clusters: a cluster is bounded by
    its stretch of text, not by the number of matches of a document.
    """
    ends = matches.withColumn("stop", F.col("start") + F.length("matched"))
    before = Window.partitionBy(*by).orderBy("start", "stop", "rule").rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("start") >= F.coalesce(F.max("stop").over(before), F.lit(0))).cast("int")
    numbered = ends.withColumn("__opens", opens).withColumn("__cluster", F.sum("__opens").over(Window.partitionBy(*by).orderBy("start", "stop", "rule")))
    one = F.struct((-F.length("matched")).alias("size"), F.col("start").alias("start"), F.col("rule").alias("rule"), F.col("stop").alias("stop"), F.col("matched").alias("matched"))
    grouped = numbered.groupBy(*by, "__cluster").agg(F.array_sort(F.collect_list(one)).alias("found"))

    def choose(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda c: (x["start"] < c["stop"]) & (c["start"] < x["stop"]))
        return F.when(clash, acc).otherwise(F.array_append(acc, x))

    empty = F.expr("cast(array() as array<struct<size:int,start:bigint,rule:int,stop:bigint,matched:string>>)")
    chosen = grouped.select(*by, F.explode(F.aggregate("found", empty, choose)).alias("x"))
    return chosen.select(*by, F.col("x.rule").alias("rule"), F.col("x.start").alias("start"), F.col("x.matched").alias("matched"))
