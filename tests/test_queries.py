"""Every query with SQL against DuckDB, and operators on small frames."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as fn
from pagemill.operators import events, matching, merging
from pagemill.plans import catalogue
from pagemill.sources.tables import Rule, lines

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    rel = con.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    theirs = sorted(tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == theirs


@pytest.mark.parametrize("parts", [1, 5])
def test_match_offsets_whatever_the_partitions(spark, parts):
    docs = spark.createDataFrame([(1, "조선시대입니다."), (2, "고려 시대와 조선시대, a조선시대"), (3, None)], "doc_id long, text string").repartition(parts)
    m = matching.positions(docs, [Rule(1, "조선시대", leading_boundary=True), Rule(2, "x", enabled=False), Rule(3, "(?", regex=True)])
    assert sorted((r.doc_id, r.start, r.before) for r in m.collect()) == [(1, 0, ""), (2, 7, " "), (2, 14, "a")]
    assert matching.leading_boundary(m).count() == 2


def test_longest_wins(spark):
    rows = [(1, 1, 0, "aaaa"), (1, 2, 2, "aaaaaa"), (1, 3, 7, "aa"), (1, 4, 20, "b")]
    m = spark.createDataFrame(rows, "doc_id long, rule int, start long, matched string")
    assert sorted(r.rule for r in matching.longest_wins(m, ["doc_id"]).collect()) == [2, 4]


def test_lines(spark):
    docs = spark.createDataFrame([(1, "ab\n\nc")], "doc_id long, text string")
    assert [(r.line_num, r.start, r.line) for r in lines(docs).orderBy("line_num").collect()] == [(0, 0, "ab"), (1, 3, ""), (2, 4, "c")]


def test_session_gap_is_strict(spark):
    e = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:00:09.999"), (3, 1, "2024-01-01 00:00:19.999")], "event_id long, user_id long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in events.sessions(e, "user_id", "ts", 10, "event_id").collect()) == [1, 2]


def test_jamo_and_titles(spark):
    row = spark.range(1).select(fn.jamo_distance(F.lit("가디건"), F.lit("카디건")).alias("d"), fn.toc_title(F.lit("제1장 서론 15")).alias("t"), fn.toc_page(F.lit("제1장 서론 15")).alias("p")).first()
    assert tuple(row) == (1, "제1장 서론", 15)


def test_last_writer(spark):
    a = spark.createDataFrame([(1, 5, "x"), (2, 1, "x")], "id long, at long, v string")
    b = spark.createDataFrame([(1, 5, "y"), (2, 2, "y"), (3, 1, "y")], "id long, at long, v string")
    assert sorted((r.id, r.v) for r in merging.last_writer_wins(a, b, "id", "at").collect()) == [(1, "x"), (2, "y"), (3, "y")]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
