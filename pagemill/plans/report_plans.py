"""Queries of result reports, quotas and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grams, matching, reports, spacing
from ..sources.tables import Rule, table
from .text_plans import CHOSEN, FILTERED, RULES, TOKENS, _filtered, _conflicts, _index_sql, _matches, _positions, _tokens

QUERIES: dict = {}
EXCLUDING = [Rule(1, "tion", exclude_phrases=("tional", "tions")), Rule(2, "([sc])?tion", regex=True, exclude_prefixes=("s",))]
STEMS = ["tion", "ation", "ing", "ed"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""SELECT * FROM (SELECT doc_id, 1 AS rule, (len(regexp_extract_all(text, 'tion')) - len(regexp_extract_all(text, 'tional|tions')))::BIGINT AS n FROM documents
UNION ALL SELECT doc_id, 2, len(list_filter(regexp_extract_all(text, '[sc]?tion'), lambda x: x <> 'stion'))::BIGINT FROM documents) WHERE n > 0""")
def match_exclusions(spark, sf_dir):
    """Matches that no excluded phrase or prefix of their rule rejects."""
    found = matching.positions(table(spark, sf_dir, "documents").select("doc_id", "text"), EXCLUDING)
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("""SELECT 1 AS rule, count(*) FILTER (contains(text, 'ation')) AS docs, NULL::VARCHAR AS error FROM documents
UNION ALL SELECT 2, 0, 'missing )' UNION ALL SELECT 3, count(*) FILTER (regexp_matches(text, '[aeiou]{4}')), NULL FROM documents""")
def bad_pattern_rows(spark, sf_dir):
    """A rule whose pattern cannot be read gives an error row beside the findings of the others."""
    rules = [Rule(1, "ation"), Rule(2, "(a", regex=True), Rule(3, "[aeiou]{4}", regex=True)]
    return matching.bad_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), rules).withColumn("error", F.substring("error", 1, 9))


TIER = "CASE r.category WHEN 'consistency' THEN 0 WHEN 'spelling' THEN 1 ELSE 2 END"


@query(f"WITH {_positions(RULES)}, {FILTERED}, {CHOSEN}, rc AS (SELECT rule, count(*) AS n, min(doc_id) AS first_doc FROM o GROUP BY rule) SELECT {TIER} AS tier, first_doc, rule, n FROM rc JOIN rules r USING (rule)")
def results_for_display(spark, sf_dir):
    """Rules with findings by category tier, then first document, then rule."""
    chosen = matching.longest_wins(_filtered(spark, sf_dir), ["doc_id"]).groupBy("rule").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    tiers = spark.createDataFrame([(r.ord, {"consistency": 0, "spelling": 1}.get(r.category, 2)) for r in RULES if r.enabled], "rule int, tier int")
    return chosen.join(tiers, "rule").select("tier", "first_doc", "rule", "n").orderBy("tier", "first_doc", "rule")


@query(f"WITH {_positions(RULES)}, g AS (SELECT category, rule, count(*) AS n FROM m GROUP BY ALL) SELECT category, sum(n)::BIGINT AS findings, count(*) AS groups_with_findings, count(*) FILTER (n >= 1000) AS large_groups FROM g GROUP BY category")
def findings_by_category(spark, sf_dir):
    groups = _matches(spark, sf_dir).groupBy("category", "rule").agg(F.count("*").alias("n"))
    return groups.groupBy("category").agg(F.sum("n").alias("findings"), F.count("*").alias("groups_with_findings"), F.count_if(F.col("n") >= 1000).alias("large_groups"))


@query(f"WITH {_index_sql(6)} SELECT affix, glued, spaced, glued + spaced AS total, CASE WHEN glued / (glued + spaced) >= 0.8 THEN 'glued' WHEN spaced / (glued + spaced) >= 0.8 THEN 'spaced' END AS dominant FROM (SELECT affix, coalesce(sum(n) FILTER (NOT contains(variant, ' ')), 0)::BIGINT AS glued, coalesce(sum(n) FILTER (contains(variant, ' ')), 0)::BIGINT AS spaced FROM a GROUP BY affix)")
def spacing_totals(spark, sf_dir):
    return reports.spacing_totals(spacing.with_affix(_conflicts(spark, sf_dir)), "affix")


@query(f"WITH {_index_sql(6)} SELECT key, total, dual FROM (SELECT key, sum(n)::BIGINT AS total, bool_or(key = variant) AND bool_or(key <> variant) AS dual FROM x GROUP BY key) WHERE total >= 10")
def cluster_order(spark, sf_dir):
    """Frequent clusters: those of both forms first, then the commonest, then by key."""
    glued = F.col("key") == F.col("variant")
    c = grams.selected(table(spark, sf_dir, "documents").select("text"), total=10).groupBy("key").agg(F.sum("n").alias("total"), (F.bool_or(glued) & F.bool_or(~glued)).alias("dual")).where("total >= 10")
    return c.orderBy(F.desc("dual"), F.desc("total"), "key")


LINE = "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ' :' WHEN 2 THEN '...' WHEN 3 THEN ' and more' ELSE ' .:.:' END"


@query(f"SELECT p_partkey, p_size % 5 IN (0, 1, 2) AS alone FROM part")
def standalone_titles(spark, sf_dir):
    """Whether a name stands alone on its line, closing marks aside."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", reports.standalone_title(F.concat("p_name", F.expr(LINE)), F.col("p_name")).alias("alone"))


@query(f"WITH {TOKENS} SELECT token, CASE WHEN ends_with(token, 'ation') THEN length(token) - 5 WHEN ends_with(token, 'tion') THEN length(token) - 4 WHEN ends_with(token, 'ing') THEN length(token) - 3 WHEN ends_with(token, 'ed') THEN length(token) - 2 ELSE 0 END AS span_at, CASE WHEN ends_with(token, 'ation') THEN 'ation' WHEN ends_with(token, 'tion') THEN 'tion' WHEN ends_with(token, 'ing') THEN 'ing' WHEN ends_with(token, 'ed') THEN 'ed' ELSE token END AS span FROM tk")
def caution_spans(spark, sf_dir):
    s = _tokens(spark, sf_dir).select("token", reports.stem_span(F.col("token"), STEMS).alias("s"))
    return s.select("token", F.col("s.offset").cast("long").alias("span_at"), F.col("s.text").alias("span"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name || '|' || p_brand END AS stems FROM part")
def sheet_stems(spark, sf_dir):
    """Stems of a sheet cell: its comma list, null if it only repeats the label."""
    cell = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ,， "), F.col("p_brand"), F.lit(",")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(reports.stems_of(cell, F.col("p_name")), "|").alias("stems"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS cloud, count(*) FILTER (event_type = 'click') AS own, count(*) FILTER (event_type = 'signup') AS bonus, bool_or(event_type = 'error') AS feedback FROM events GROUP BY user_id),
m AS (SELECT *, greatest(cloud, own) AS used FROM u) SELECT user_id, used, greatest(0, (CASE WHEN feedback THEN 2 ELSE 1 END) - least(used, CASE WHEN feedback THEN 2 ELSE 1 END)) + bonus AS checks_left FROM m""")
def quota_left(spark, sf_dir):
    """Checks used, the larger of two sources' counts, and what is left with feedback and bonus."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.greatest(of("view"), of("click")).alias("used"), of("signup").alias("bonus"), F.bool_or(F.col("event_type") == "error").alias("feedback"))
    return u.select("user_id", "used", reports.checks_left(F.col("used"), F.col("feedback"), F.col("bonus")).cast("long").alias("checks_left"))


@query("SELECT o_custkey::VARCHAR AS correction, arg_max(o_orderpriority, o_orderkey) AS unified FROM orders GROUP BY o_custkey")
def unify_mappings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.col("o_custkey").cast("string"), F.lit(" ")).alias("correction"), F.col("o_orderpriority").alias("unified"))
    return reports.last_mappings(o)


@query("SELECT p_partkey, p_size < 5 AS dirty FROM part")
def dirty_sets(spark, sf_dir):
    """Records that differ from their checkpoint, by a hash of their JSON form."""
    of = lambda size: F.sha2(F.to_json(F.struct(size.alias("size"), "p_brand")), 256)
    return table(spark, sf_dir, "part").select("p_partkey", (of(F.col("p_size").cast("long")) != of(F.greatest("p_size", F.lit(5)).cast("long"))).alias("dirty"))


@query("SELECT l_orderkey, l_linenumber, greatest(1, l_partkey)::BIGINT AS book_page, CASE WHEN p <= 1 THEN 1.0 WHEN (p - 6) / 2 + 1 >= 20 AND (p - 6) % 2 = 0 THEN (p - 6) / 2 + 1 WHEN p / 2 + 1 >= 2 AND p / 2 + 1 < 20 THEN p / 2 + 1 WHEN p = 44 THEN 20.0 ELSE greatest(1.0, floor(p / 2 + 1.5)) END::DOUBLE AS file_page FROM (SELECT *, l_partkey AS p FROM lineitem)")
def book_pages(spark, sf_dir):
    """Printed numbers of file pages, and file pages of printed left pages (shift 6 from page 20 on)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", reports.book_page(F.col("l_partkey")).cast("long").alias("book_page"), reports.page_of_printed_left(F.col("l_partkey"), 6, 20).cast("double").alias("file_page"))


@query("SELECT user_id, event_type AS query, min(ts) AS first_at, count(*) AS times FROM events GROUP BY ALL")
def find_decisions(spark, sf_dir):
    """A ledger of distinct queries: those at hand, then the new ones that are not among them."""
    e = table(spark, sf_dir, "events")
    each = e.groupBy("user_id", F.col("event_type").alias("query"), F.col("ts") < F.lit("2024-01-15").cast("timestamp")).agg(F.min("ts").alias("first_at"), F.count("*").alias("times"))
    return each.groupBy("user_id", "query").agg(F.min("first_at").alias("first_at"), F.sum("times").alias("times"))
