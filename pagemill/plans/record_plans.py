"""Queries over orders, parts and line items: merging, validation, report figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import finding_bucket, printed_left, printed_page
from ..operators import merging
from ..sources.tables import table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _halves(spark, sf_dir):
    """Two copies of the orders that overlap: all but every third key, and all but every fifth, the second with later dates for even keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    a = o.where("o_orderkey % 3 != 0")
    b = o.where("o_orderkey % 5 != 0").withColumn("o_orderdate", F.expr("case when o_orderkey % 2 = 0 then o_orderdate + interval 1 day else o_orderdate end")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return a, b


HALVES = """a AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate FROM orders WHERE o_orderkey % 5 <> 0)"""
LWW = f"""WITH {HALVES} SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, src FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, src) AS k FROM (SELECT *, 'a' AS src FROM a UNION ALL SELECT *, 'b' FROM b)) WHERE k = 1"""


@query(LWW)
def lww_merge(spark, sf_dir):
    return merging.last_writer_wins(*_halves(spark, sf_dir), "o_orderkey", "o_orderdate")


@query(f"""WITH m AS ({LWW}), t AS (SELECT o_orderkey AS id, max(d) AS deleted_at FROM (
  SELECT o_orderkey, TIMESTAMP '1998-01-01' AS d FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, TIMESTAMP '1999-06-01' FROM orders WHERE o_orderkey % 14 = 0) GROUP BY 1)
SELECT 'row' AS kind, o_orderkey AS id, o_orderdate AS at FROM m LEFT JOIN t ON id = o_orderkey WHERE id IS NULL OR o_orderdate > deleted_at
UNION ALL SELECT 'tombstone', id, deleted_at FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE o_orderkey = id AND o_orderdate > deleted_at)""")
def tombstone_apply(spark, sf_dir):
    rows = lww_merge(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    dead = lambda n, day: o.where(F.col("id") % n == 0).withColumn("deleted_at", F.lit(day).cast("timestamp"))
    tombs = merging.newest_tombstones(dead(7, "1998-01-01"), dead(14, "1999-06-01")).withColumn("deleted_at", F.col("deleted_at").cast(rows.schema["o_orderdate"].dataType))
    kept = merging.apply_tombstones(rows, tombs, "o_orderkey", "o_orderdate").select(F.lit("row").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    left = merging.surviving_tombstones(tombs, rows, "o_orderkey", "o_orderdate").select(F.lit("tombstone").alias("kind"), "id", F.col("deleted_at").alias("at"))
    return kept.unionByName(left)


@query("SELECT p_name, p_partkey, p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey DESC) AS k FROM part) WHERE k = 1")
def dedupe_by_name(spark, sf_dir):
    return merging.newest_per(table(spark, sf_dir, "part"), "p_name", [F.desc("p_retailprice"), F.desc("p_partkey")]).select("p_name", "p_partkey", "p_brand", "p_retailprice")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders)
WHERE o_orderstatus = 'P' OR k <= 5""")
def preset_quota(spark, sf_dir):
    """Newest five orders of a customer; pending ones count as drafts and always stay."""
    return merging.within_quota(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 5, F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS pinned, max(o_orderdate) AS at FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1""")
def asof_decision(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate < timestamp'1999-01-01'")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("pinned"), F.max("o_orderdate").alias("at"))


@query("SELECT o_custkey, o_orderkey, o_orderdate + INTERVAL 30 DAY AS expires_at FROM orders WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1999-01-01'")
def ttl_listing(spark, sf_dir):
    """Unexpired rows of all customers, newest first."""
    o = table(spark, sf_dir, "orders").withColumn("expires_at", F.col("o_orderdate") + F.expr("interval 30 days"))
    return o.where("expires_at > timestamp'1999-01-01'").select("o_custkey", "o_orderkey", "expires_at").orderBy(F.desc("expires_at"), "o_orderkey")


@query("""SELECT p_partkey, 'price out of range' AS issue FROM part WHERE p_retailprice < 950 OR p_retailprice > 1050
UNION ALL SELECT p_partkey, 'no size' FROM part WHERE p_size IS NULL OR p_size <= 2
UNION ALL SELECT p_partkey, 'duplicate name' FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT p_partkey, 'conflicting type' FROM part WHERE (p_name, p_brand) IN (SELECT (p_name, p_brand) FROM part GROUP BY p_name, p_brand HAVING count(DISTINCT p_type) > 1)""")
def rule_validation(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    issue = lambda df, text: df.select("p_partkey", F.lit(text).alias("issue"))
    names = p.groupBy("p_name").agg(F.count("*").alias("k")).where("k > 1").select("p_name")
    types = p.groupBy("p_name", "p_brand").agg(F.countDistinct("p_type").alias("k")).where("k > 1").select("p_name", "p_brand")
    return (
        issue(p.where("p_retailprice < 950 or p_retailprice > 1050"), "price out of range")
        .unionByName(issue(p.where("p_size is null or p_size <= 2"), "no size"))
        .unionByName(issue(p.join(names, "p_name", "left_semi"), "duplicate name"))
        .unionByName(issue(p.join(types, ["p_name", "p_brand"], "left_semi"), "conflicting type"))
    )


@query("SELECT p_brand, p_type, count(*) AS rules, count(*) FILTER (p_size <= 25) AS active FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), ())")
def active_rule_totals(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupingSets([[F.col("p_brand"), F.col("p_type")], [F.col("p_brand")], []], "p_brand", "p_type").agg(F.count("*").alias("rules"), F.count(F.when(F.col("p_size") <= 25, 1)).alias("active"))


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part")
def tag_list(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).distinct()


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <= 1 THEN 1 ELSE (l_linenumber - 1) * 2 END::INTEGER AS printed_left, CASE WHEN l_linenumber >= 3 THEN l_linenumber + 10 ELSE l_linenumber END::INTEGER AS printed FROM lineitem")
def printed_pages(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", printed_left(n).cast("int").alias("printed_left"), printed_page(n, 10, 3).cast("int").alias("printed"))


@query("""SELECT CASE WHEN l_quantity <= 0 THEN '0' WHEN l_quantity <= 20 THEN '1-20' WHEN l_quantity <= 100 THEN '21-100' WHEN l_quantity <= 500 THEN '101-500' ELSE '501+' END AS bucket, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL""")
def finding_buckets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(finding_bucket(F.col("l_quantity")).alias("bucket"), "l_returnflag").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT p_partkey, p_name FROM part) , n AS (SELECT DISTINCT p_name FROM x),
s AS (SELECT DISTINCT a.p_name FROM n a JOIN n b ON contains(b.p_name, a.p_name) AND length(b.p_name) > length(a.p_name))
SELECT p_name, count(*) AS parts FROM x WHERE p_name IN (FROM s) GROUP BY 1""")
def shadowed_titles(spark, sf_dir):
    """Names contained in a longer name; substrings of every name are joined on equality, so nothing is compared pairwise."""
    p = table(spark, sf_dir, "part").select("p_name")
    names = p.distinct()
    starts = names.select("p_name", F.explode(F.sequence(F.lit(1), F.length("p_name"))).alias("i"))
    parts = starts.select("p_name", "i", F.explode(F.sequence(F.lit(1), F.length("p_name") - F.col("i") + 1)).alias("m")).where(F.col("m") < F.length("p_name")).select(F.expr("substring(p_name, i, m)").alias("part"))
    shadowed = names.join(parts.distinct(), F.col("p_name") == F.col("part"), "left_semi")
    return p.join(shadowed, "p_name", "left_semi").groupBy("p_name").agg(F.count("*").alias("parts"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::INTEGER AS distance
FROM n a JOIN n b ON a.p_name < b.p_name AND length(a.p_name) = length(b.p_name) AND hamming(a.p_name, b.p_name) <= 2 WHERE levenshtein(a.p_name, b.p_name) <= 2""")
def near_form_pairs(spark, sf_dir):
    """Names of equal length that differ in at most two characters: equal once the same two places are blanked, so the join hashes."""
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    short = n.where("length(p_name) = 1").select("p_name", F.lit("").alias("k"))  # any two letters differ in one place
    i = n.where("length(p_name) >= 2").select("p_name", F.explode(F.sequence(F.lit(1), F.length("p_name") - 1)).alias("i"))
    ij = i.select("p_name", "i", F.explode(F.sequence(F.col("i") + 1, F.length("p_name"))).alias("j"))
    keyed = ij.select("p_name", "i", "j", F.expr("concat(substring(p_name, 1, i - 1), '\\u0001', substring(p_name, i + 1, j - i - 1), '\\u0001', substring(p_name, j + 1))").alias("k")).select("p_name", "k").unionByName(short)
    pairs = keyed.alias("x").join(keyed.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.p_name") < F.col("y.p_name"))).select(F.col("x.p_name").alias("a"), F.col("y.p_name").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b"))
