"""Series: clusters of spacing variants that share a beginning or an end, each in one series, given by greedy choice in distributed rounds.

Clusters are rows (key, variant, n): a key's glued and spaced forms with their counts; its spaced form is that of ``clusters.heads``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, discard
from .clusters import heads, is_spaced, is_weak_affix, is_weak_filler

#: Members that make a series; longest beginning taken from a key without a spaced form.
LEAST, LONGEST_FALLBACK = 2, 4


def _edge_word(spaced: Column, end: bool) -> Column:
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.element_at(words, -1 if end else 1))


def _slices(word: Column, longest: Column, least: int, end: bool, letters: str) -> Column:
    sizes = F.when(longest >= least, F.sequence(longest, F.lit(least), F.lit(-1)))
    cut_at = lambda n: F.substr(word, F.length(word) - n + 1 if end else F.lit(1), n)
    return F.filter(F.transform(sizes, cut_at), lambda a: ~is_weak_affix(a, least, letters))


def candidates(clusters: DataFrame, end: bool = False, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """(key, affix): the beginnings (or ends) under which a cluster may be listed.

    These are the first (last) word of its spaced form and its beginnings (ends) of ``least`` characters or more. Where that word makes no affix, or there is no spaced form, the beginnings (ends) of
    the key's first (last) run of letters, of four characters at most and less than the run.
    """
    word = _edge_word(F.col("spaced"), end)
    runs = F.regexp_extract_all("key", F.lit(f"[{letters}]+"), F.lit(0))
    run = F.try_element_at(runs, F.lit(-1 if end else 1))
    whole = _slices(word, F.length(word), least, end, letters)
    spare = _slices(run, F.least(F.lit(LONGEST_FALLBACK), F.length(run) - 1), least, end, letters)
    good = word.isNotNull() & ~is_weak_affix(word, least, letters)
    return heads(clusters).select("key", F.explode(F.when(good, whole).otherwise(spare)).alias("affix"))


def greedy(offers: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, affix) of offers (key, affix, rank): affixes are taken by rank, the smallest first; one that at least ``least`` keys still free offer takes them all.

    Ranks order the affixes and do not tie within a key. A key that every better affix has failed is free at the turn of its best one left. So in a round an affix that is
    the best left for ``least`` keys is sure to be taken, and has these; other keys come to it once their better ones have failed. Affixes that are not sure and have too few free keys
    fail, as free keys only grow fewer. The best affix of all always decides, so every round makes progress; what stays open after the first ones are affixes that are the best for too few.
    """
    open_, tables = offers.select("key", "affix", "rank").where("key is not null and affix is not null").distinct().withColumn("sure", F.lit(False)), []
    while True:
        live = open_.groupBy("affix").agg(F.count("*").alias("members"), F.bool_or("sure").alias("safe")).where(F.col("safe") | (F.col("members") >= least))
        left = open_.join(live.select("affix"), "affix", "left_semi")
        best = left.groupBy("key").agg(F.min("rank").alias("best"))
        with_best = left.join(best, "key").withColumn("first", F.col("rank") == F.col("best")).drop("best")
        firsts = with_best.groupBy("affix").agg(F.count_if("first").alias("firsts"))
        marked = cut(with_best.join(firsts, "affix").select("key", "affix", "rank", "first", (F.col("sure") | (F.col("firsts") >= least)).alias("sure")))
        if marked.isEmpty():
            discard(marked)
            break
        tables.append(marked)
        open_ = marked.join(marked.where("first and sure").select("key"), "key", "left_anti").drop("first")
    taken = [t.where("first and sure").select("key", "affix") for t in tables]
    if not taken:
        return offers.select("key", "affix").limit(0)
    return reduce(DataFrame.unionByName, taken)


def by_length(offers: DataFrame) -> DataFrame:
    """Longest affix first."""
    return offers.withColumn("rank", F.struct((-F.length("affix")).alias("size"), F.col("affix").alias("affix")))


def longest_first(clusters: DataFrame, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """(key, affix_type, affix): series by the longest beginning that two clusters or more share, then of the rest by the longest end."""
    prefix = cut(greedy(by_length(candidates(clusters, False, least, letters))))
    suffixes = candidates(clusters, True, least, letters).join(prefix.select("key"), "key", "left_anti")
    suffix = greedy(by_length(suffixes))
    return prefix.select("key", F.lit("prefix").alias("affix_type"), "affix").unionByName(suffix.select("key", F.lit("suffix").alias("affix_type"), "affix"))


def largest_first(clusters: DataFrame, members: int = LEAST, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """(key, affix_type, affix): series by the first or last word of the spaced form, those of most clusters first, of equals beginnings before ends, then by name.

    Words that are no affix, and clusters with a single letter or a digit beside theirs, are left out; clusters in no series are no rows.
    """
    spaced = heads(clusters).where("spaced is not null")
    sides = [spaced.select("key", F.lit(kind).alias("affix_type"), _edge_word(F.col("spaced"), end).alias("affix")).where(~is_weak_filler(F.col("key"), F.col("affix"), end, letters)) for kind, end in (("prefix", False), ("suffix", True))]
    offers = cut(sides[0].unionByName(sides[1]).where(F.col("affix").isNotNull() & ~is_weak_affix(F.col("affix"), least, letters)))
    sizes = offers.groupBy("affix_type", "affix").agg(F.count("*").alias("size"))
    ranked = offers.join(sizes, ["affix_type", "affix"]).withColumn("rank", F.struct((-F.col("size")).alias("size"), "affix_type", "affix"))
    one = F.struct("affix_type", "affix")
    return greedy(ranked.select("key", one.alias("affix"), "rank"), members).select("key", "affix.affix_type", "affix.affix")


def satellites_of(singles: DataFrame, heads_: DataFrame, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """(key, affix_type, affix): single forms (key, variant) that belong to a series (affix_type, affix, n), each to one: beginnings before ends, then the series of most findings, then by name.

    A form of two words belongs to the series of either word, a glued one to those of its beginnings (ends) of two to four letters, if more than one letter and no digit is beside them.
    """
    words = F.filter(F.split("variant", r"\s+"), lambda w: w != "")
    sides, fits, none = [], {}, F.expr("cast(array() as array<string>)")
    for kind, end in (("prefix", False), ("suffix", True)):
        run = F.try_element_at(F.regexp_extract_all("key", F.lit(f"[{letters}]+"), F.lit(0)), F.lit(-1 if end else 1))
        glued = _slices(run, F.least(F.lit(LONGEST_FALLBACK), F.length(run) - 1), least, end, letters)
        spaced = F.when(F.size(words) == 2, F.array(F.get(words, F.lit(1 if end else 0))))
        of = lambda a: F.struct(F.lit(kind).alias("affix_type"), a.alias("affix"))  # noqa: B023, E731
        sides.append(F.transform(F.coalesce(F.when(is_spaced(F.col("variant")), spaced).otherwise(glued), none), of))
        beside = F.endswith("key", "affix") if end else F.startswith("key", "affix")
        fits[kind] = beside & ~is_weak_filler(F.col("key"), F.col("affix"), end, letters)
    # Series are few beside single forms: they go to these, which stay where they are.
    each = singles.select("key", F.inline(F.concat(*sides))).join(F.broadcast(heads_), ["affix_type", "affix"])
    offers = each.where(~is_weak_affix(F.col("affix"), least, letters) & F.when(F.col("affix_type") == "suffix", fits["suffix"]).otherwise(fits["prefix"]))
    first = F.min(F.struct("affix_type", (-F.col("n")).alias("n"), "affix")).alias("x")
    return offers.groupBy("key").agg(first).select("key", "x.affix_type", "x.affix")


def kept_series(series: DataFrame, satellites: DataFrame) -> DataFrame:
    """(key, affix_type, affix, role) of conflicts in series and satellites (key, affix_type, affix): a series of two conflicts, or of one and a satellite, stays.

    Conflicts of other series come back as ``single``, without an affix; satellites of other series go.
    """
    by = ["affix_type", "affix"]
    both = series.withColumn("role", F.lit("conflict")).unionByName(satellites.select("key", *by).withColumn("role", F.lit("satellite")))
    counts = both.groupBy(*by).agg(F.count_if(F.col("role") == "conflict").alias("c"), F.count("*").alias("m"))
    keep = counts.select(*by, ((F.col("c") >= 2) | ((F.col("c") >= 1) & (F.col("m") > F.col("c")))).alias("keep"))
    marked = both.join(keep, by)
    alone = marked.where("not keep and role = 'conflict'").select("key", F.lit(None).cast("string").alias("affix_type"), F.lit(None).cast("string").alias("affix"), F.lit("single").alias("role"))
    return marked.where("keep").select("key", *by, "role").unionByName(alone)


def listed(conflicts: DataFrame, singles: DataFrame, least: int = 2, letters: str = "가-힣") -> DataFrame:
    """(key, affix_type, affix, role) of clusters of conflicts (key, variant, n) and single forms (key, variant): series with their satellites, and conflicts that stay alone.

    A word of one conflict is a series for the time being, so that single forms can join it. Single forms of keys in conflict, and those that join no series, are no rows.
    """
    groups = cut(largest_first(conflicts, 1, least, letters))
    sizes = conflicts.groupBy("key").agg(F.sum("n").alias("n"))
    findings = groups.join(sizes, "key").groupBy("affix_type", "affix").agg(F.sum("n").alias("n"))
    keys = conflicts.select("key").distinct()
    satellites = satellites_of(singles, findings, least, letters).join(keys, "key", "left_anti")
    found = cut(kept_series(groups, satellites))
    nothing = F.lit(None).cast("string")
    return found.unionByName(keys.join(found.select("key"), "key", "left_anti").select("key", nothing.alias("affix_type"), nothing.alias("affix"), F.lit("single").alias("role")))
