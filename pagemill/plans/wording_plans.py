"""Queries over word forms, scalar labels and placed items. The harness texts have no Hangul, so lists and letters are Latin here."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import wording
from ..operators import layout
from ..sources.tables import lines, table

LATIN = "a-zA-Z"
SUFFIXES = ["ations", "ation", "ings", "ing", "ed", "es", "s", "e"]
TAILS = {2: ["ing", "ed"], 4: ["s", "e"]}
QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


WORDS = "w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS word FROM documents) WHERE regexp_matches(word, '^[a-zA-Z]+$') GROUP BY word)"


def _words(spark, sf_dir):
    """(word, n): words of Latin letters; counted first, so that the list work runs once for each form."""
    each = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("word"))
    return each.where(F.col("word").rlike("^[a-zA-Z]+$")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""WITH {WORDS}, s AS (SELECT word, n, list_filter({_list(SUFFIXES)}, lambda s: ends_with(word, s) AND length(word) - length(s) >= 2 AND NOT (s = 'e' AND length(word) = 4))[1] AS s FROM w)
SELECT CASE WHEN s IS NULL THEN word ELSE left(word, length(word) - length(s)) END AS stem, sum(n)::BIGINT AS n, count(*) AS forms FROM s GROUP BY ALL""")
def suffix_strip(spark, sf_dir):
    stem = wording.stripped(F.col("word"), SUFFIXES, 2, LATIN, ("e",), 4)
    return _words(spark, sf_dir).groupBy(stem.alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query(f"""WITH {WORDS}, s AS (SELECT DISTINCT word, n, unnest(list_prepend(word, list_transform(list_filter({_list(SUFFIXES)}, lambda s: ends_with(word, s) AND length(word) - length(s) >= 2), lambda s: left(word, length(word) - length(s))))) AS stem FROM w)
SELECT stem, count(*) AS forms, sum(n)::BIGINT AS n FROM s GROUP BY stem HAVING count(*) > 1""")
def stem_candidates(spark, sf_dir):
    """Stems that several words share, each word standing for itself and for what each suffix leaves of it."""
    each = _words(spark, sf_dir).select("n", F.explode(wording.stems(F.col("word"), SUFFIXES)).alias("stem"))
    return each.groupBy("stem").agg(F.count("*").alias("forms"), F.sum("n").alias("n")).where("forms > 1")


@query(f"""WITH {WORDS} SELECT word, n FROM w WHERE {" OR ".join(f"(ends_with(word, '{t}') AND length(word) >= {len(t) + k})" for k, ts in TAILS.items() for t in ts)}""")
def tail_words(spark, sf_dir):
    return _words(spark, sf_dir).where(wording.has_tail(F.col("word"), TAILS))


@query("""SELECT doc_id, line_num, array_to_string(list_filter(list_transform(list_filter(string_split_regex(l, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '[''`´‘’“”„«»「」『』]', '', 'g'), '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g')), lambda x: x <> ''), ' ') AS form FROM (SELECT doc_id, unnest(range(0, len(s))) AS line_num, unnest(s) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))""")
def unmarked_forms(spark, sf_dir):
    """Lines without marks at the ends of their words."""
    return lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_num").cast("long").alias("line_num"), wording.without_marks(F.col("line"), LATIN).alias("form"))


PART_FORM = "p_size || ' ' || p_name || p_size || ' ' || p_size || 'x ' || p_size"


@query(f"""WITH f AS (SELECT p_partkey, regexp_replace(regexp_replace({PART_FORM}, '^([0-9]+( |$))+', ''), '(( |^)[0-9]+)+$', '') AS t FROM part)
SELECT p_partkey, array_to_string(list_transform(string_split(t, ' '), lambda x: CASE WHEN len(regexp_extract_all(regexp_extract(x, '^[0-9]+([a-zA-Z].*)$', 1), '[a-zA-Z]')) >= 2 THEN regexp_extract(x, '^[0-9]+([a-zA-Z].*)$', 1) WHEN len(regexp_extract_all(regexp_extract(x, '^([a-zA-Z].*?)[0-9]+$', 1), '[a-zA-Z]')) >= 2 THEN regexp_extract(x, '^([a-zA-Z].*?)[0-9]+$', 1) ELSE x END), ' ') AS form FROM f""")
def edge_digits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", wording.without_edge_digits(F.expr(PART_FORM), 2, LATIN).alias("form"))


@query(f"""WITH {WORDS}, a AS (SELECT word, n, unnest(list_transform(range(length(word), 2, -1), lambda k: left(word, k))) AS affix FROM w WHERE length(word) >= 3)
SELECT affix, count(*) AS forms, sum(n)::BIGINT AS n FROM a GROUP BY affix HAVING count(*) >= 2""")
def series_prefixes(spark, sf_dir):
    """Beginnings of three letters or more that several words share."""
    each = _words(spark, sf_dir).select("n", F.explode(wording.affixes(F.col("word"), 3)).alias("affix"))
    return each.groupBy("affix").agg(F.count("*").alias("forms"), F.sum("n").alias("n")).where("forms >= 2")


@query(f"""WITH {WORDS}, a AS (SELECT word, n, unnest(list_transform(range(length(word), 2, -1), lambda k: right(word, k))) AS affix FROM w WHERE length(word) >= 3)
SELECT affix, count(*) AS forms, sum(n)::BIGINT AS n FROM a GROUP BY affix HAVING count(*) >= 2""")
def series_suffixes(spark, sf_dir):
    each = _words(spark, sf_dir).select("n", F.explode(wording.affixes(F.col("word"), 3, end=True)).alias("affix"))
    return each.groupBy("affix").agg(F.count("*").alias("forms"), F.sum("n").alias("n")).where("forms >= 2")


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1f', floor(b / 1024 * 10 + 0.5) / 10) || 'KB' ELSE printf('%.1f', floor(b / 1048576 * 10 + 0.5) / 10) || 'MB' END AS size,
CASE WHEN n_chars <= 50 THEN '1-50' WHEN n_chars <= 150 THEN '51-150' WHEN n_chars <= 300 THEN '151-300' ELSE '301+' END AS pages,
CASE WHEN n_chars <= 0 THEN '0' WHEN n_chars <= 10 THEN '1-10' WHEN n_chars <= 30 THEN '11-30' WHEN n_chars <= 100 THEN '31-100' ELSE '101+' END AS rules,
CASE WHEN b * 100 / 1048576 <= 10 THEN '0-10' WHEN b * 100 / 1048576 <= 30 THEN '10-30' WHEN b * 100 / 1048576 <= 50 THEN '30-50' ELSE '50+' END AS megabytes FROM (SELECT doc_id, n_chars, strlen(text) AS b FROM documents)""")
def size_labels(spark, sf_dir):
    b, n = F.octet_length("text"), F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", fn.file_size(b).alias("size"), fn.page_bucket(n).alias("pages"), fn.rule_bucket(n).alias("rules"), fn.megabyte_bucket(b * 100).alias("megabytes"))


TOC_LINE = "p_name || CASE p_size % 4 WHEN 0 THEN ' ..... ' WHEN 1 THEN '  ' WHEN 2 THEN '…' ELSE '' END || p_size"


@query(f"""WITH t AS (SELECT p_partkey, {TOC_LINE} AS l, p_size, p_name FROM part)
SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN p_name || p_size ELSE p_name END AS title, CASE WHEN p_size % 4 < 3 THEN p_size::INTEGER END AS page FROM t""")
def toc_lines(spark, sf_dir):
    """Titles and page numbers of table-of-contents lines: leaders or blanks stand before a page, a digit in the title stays."""
    line = F.expr(TOC_LINE)
    return table(spark, sf_dir, "part").select("p_partkey", fn.toc_title(line).alias("title"), fn.toc_page(line).alias("page"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber::INTEGER AS first, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 1 ELSE l_linenumber END::INTEGER AS last, CASE WHEN l_linenumber <= 1 THEN 1 ELSE l_linenumber - l_linenumber % 2 END::INTEGER AS spread FROM lineitem""")
def page_inputs(spark, sf_dir):
    n = F.col("l_linenumber")
    entry = F.when(n % 2 == 0, F.concat(F.lit("P."), n.cast("string"), F.lit(" - "), (n + 1).cast("string"))).otherwise(F.concat(n.cast("string"), F.lit("P")))
    got = table(spark, sf_dir, "lineitem").select("l_orderkey", n, "l_partkey", fn.page_range(entry).alias("r"), fn.spread_left(n).cast("int").alias("spread"))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", F.col("r.first").alias("first"), F.col("r.last").alias("last"), "spread")


@query("""SELECT event_id, greatest(0, ceil((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 86400000000.0))::BIGINT AS days FROM events""")
def retention_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.days_left(F.lit("2024-01-20 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")).alias("days"))


def _items(spark, sf_dir):
    """Order lines as placed items: a customer's order is a page, ship mode the text."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_idx"), F.col("l_returnflag").alias("str"),
        F.col("l_quantity").cast("double").alias("x"), (F.col("l_linenumber") * 3).cast("double").alias("y"), F.lit(10.0).alias("size"),
    )


ITEMS = "i AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS item_idx, l_returnflag AS s, l_quantity::DOUBLE AS x, (l_linenumber * 3)::DOUBLE AS y, 10.0::DOUBLE AS size FROM lineitem)"


@query(f"WITH {ITEMS} SELECT page, item_idx FROM (SELECT *, row_number() OVER (PARTITION BY page, s, floor(x / 2 + 0.5), floor(y / 2 + 0.5) ORDER BY item_idx) AS k FROM i) WHERE k = 1")
def overlay_dedupe(spark, sf_dir):
    return layout.without_overlays(_items(spark, sf_dir)).select("page", "item_idx")


@query(f"""WITH {ITEMS}, g AS (SELECT page, x - lag(x) OVER w AS gap, (x + lag(x) OVER w) / 2 AS middle FROM i WINDOW w AS (PARTITION BY page ORDER BY x, item_idx))
SELECT page, gap, middle FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap DESC, middle) AS k FROM g WHERE middle BETWEEN 15 AND 35) WHERE k = 1""")
def spread_gutter(spark, sf_dir):
    return layout.widest_gap(_items(spark, sf_dir), 15, 35)


@query(f"""WITH RECURSIVE {ITEMS}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY item_idx, x, s) AS n FROM i WHERE s <> ''),
f AS (SELECT DISTINCT page, 0::BIGINT AS n, []::DOUBLE[] AS tops, NULL::BIGINT AS k FROM o
  UNION ALL SELECT page, n, CASE WHEN hit IS NULL THEN list_append(tops, y) ELSE tops END, coalesce(hit, len(tops) + 1)
  FROM (SELECT o.page, o.n, o.y, f.tops, nullif(list_position(list_transform(f.tops, lambda t: abs(t - o.y) <= greatest(o.size, 8) * 0.55), true), 0)::BIGINT AS hit FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1))
SELECT page, y, text, max_size, min_x FROM (
  SELECT f.page, f.tops[f.k] AS y, trim(string_agg(o.s, '' ORDER BY o.x, o.item_idx, o.s)) AS text, max(o.size) AS max_size, min(o.x) AS min_x FROM f JOIN o USING (page, n) GROUP BY ALL) WHERE text <> ''""")
def physical_lines(spark, sf_dir):
    return layout.physical_lines(_items(spark, sf_dir))
