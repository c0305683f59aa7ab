"""Figures of whole documents and pages: corpus statistics, extraction quality, HTML lines, tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity, squeezed


def corpus_stats(docs: DataFrame, by: str) -> DataFrame:
    """Per group: documents, characters that are not blank, Latin letters, digits, and the Latin share."""
    ink, latin = F.regexp_count("text", F.lit(r"[^ \t\n\r]")), F.regexp_count("text", F.lit("[A-Za-z]"))
    sums = docs.groupBy(by).agg(F.count("*").alias("docs"), F.sum(ink).alias("ink"), F.sum(latin).alias("latin"), F.sum(F.regexp_count("text", F.lit("[0-9]"))).alias("digits"))
    return sums.withColumn("latin_share", F.round(F.col("latin") / F.greatest(F.lit(1), "ink"), 6))


def extraction_quality(docs: DataFrame) -> DataFrame:
    """Per document: words, one-letter words and their share, and whether the text looks broken apart."""
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    sized = docs.select("doc_id", F.size(words).cast("long").alias("words"), F.size(F.filter(words, lambda w: F.length(w) == 1)).cast("long").alias("single"))
    share = F.round(F.col("single") / F.greatest(F.lit(1), "words"), 6)
    return sized.withColumn("single_share", share).withColumn("broken", F.col("single_share") > 0.1)


def html_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_num, line): text lines of pages without tags, each line once per page, where it stands first."""
    plain = F.regexp_replace(F.regexp_replace("html", "<(br|/p|/h1|/h2|/li|/div)>", "\n"), "<[^>]*>", "")
    each = pages.select("page_id", F.posexplode(F.split(plain, "\n")).alias("line_num", "raw")).select("page_id", "line_num", squeezed(F.col("raw")).alias("line")).where("line != ''")
    return each.groupBy("page_id", "line").agg(F.min("line_num").cast("long").alias("line_num"))


def headings(pages: DataFrame, tag: str = "h[12]") -> DataFrame:
    """(page_id, title): headings of the levels that the pattern names, whatever their attributes and inner tags, as the page's table of contents."""
    found = F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))
    plain = squeezed(F.regexp_replace("title", "<[^>]*>", ""))
    return pages.select("page_id", F.explode(found).alias("title")).withColumn("title", plain).where("title != ''").distinct()


def without_headings(html: Column, tag: str = "h[12]") -> Column:
    """A page's body: without what ``headings`` reads and without its title."""
    for t in (tag, "title"):
        html = F.regexp_replace(html, rf"(?is)<{t}(?:\s[^>]*)?>.*?</{t}\s*>", "")
    return html


def toc_classes(titles: DataFrame, bodies: DataFrame) -> DataFrame:
    """(page_id, title, status): whether a title stands in its page's body as it is, only with other spacing or case, or not at all."""
    joined = titles.join(bodies, "page_id")
    loose = lambda c: F.lower(F.regexp_replace(c, " +", ""))
    exact = F.expr("contains(body, title)")
    near = loose(F.col("body")).contains(loose(F.col("title")))
    return joined.select("page_id", "title", F.when(exact, "match").when(near, "mismatch").otherwise("missing").alias("status"))


def best_title(titles: DataFrame, candidates: DataFrame, by: str, title: str, other: str, shared: Column, least: float) -> DataFrame:
    """Of candidates that share a word with a title, the most similar one; ties go to the first by name."""
    pairs = titles.join(candidates, shared)
    scored = pairs.withColumn("score", F.round(similarity(F.col(title), F.col(other)), 6)).where(F.col("score") >= least)
    w = Window.partitionBy(by).orderBy(F.desc("score"), other)
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
