"""Queries over events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import kst_day, upload_bucket
from ..operators import events as ev
from ..operators.merging import merge_histories
from ..operators.spacing import first_of
from ..sources.shared import shared_folder
from ..sources.tables import table
from ..streaming import quota

GAP, LIMIT = 3600, 3
QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def daily_active_of(events):
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


RUNS = """
SELECT user_id, run, event_type, count(*) AS n FROM (
  SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM (
    SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS f FROM events))
GROUP BY ALL"""


@query(RUNS)
def run_length_groups(spark, sf_dir):
    return ev.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


SESSIONS = f"""
SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (
  SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (
    SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= {GAP * 1_000_000})::BIGINT, 1) AS f FROM events))
GROUP BY ALL"""


@query(SESSIONS)
def session_coalesce(spark, sf_dir):
    return ev.sessions(table(spark, sf_dir, "events"), "user_id", "ts", GAP, "event_id")


@query(f"SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session DESC) AS k FROM ({SESSIONS})) WHERE k <= 7")
def recent_sessions(spark, sf_dir):
    return first_of(session_coalesce(spark, sf_dir), ["user_id"], [F.desc("session")], 7)


@query("""
WITH d AS (SELECT user_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, event_id, event_type FROM events),
a AS (SELECT user_id, day, count(*) FILTER (event_type = 'view') AS views, NULLIF(count(*) FILTER (event_type = 'click'), 0) AS clicks FROM d WHERE event_id % 2 = 0 GROUP BY ALL),
b AS (SELECT user_id, day, count(*) FILTER (event_type = 'view') AS views, NULLIF(count(*) FILTER (event_type = 'click'), 0) AS clicks FROM d WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, coalesce(a.views, b.views) AS views, coalesce(a.clicks, b.clicks) AS clicks
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day""")
def history_full_outer(spark, sf_dir):
    """Two histories (events of even and of odd ids) of daily counts, merged; the first wins where it has a count."""
    e = table(spark, sf_dir, "events").withColumn("day", kst_day(F.col("ts")))
    part = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id", "day").agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("views"), F.nullif(F.count(F.when(F.col("event_type") == "click", 1)), F.lit(0)).alias("clicks"))
    return merge_histories(part(0), part(1), ["user_id", "day"], ["views", "clicks"])


@query(f"""SELECT event_id, user_id, day, nth, nth <= {LIMIT} AS allowed FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS nth FROM (SELECT *, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM events))""")
def quota_consume(spark, sf_dir):
    return ev.consumed(table(spark, sf_dir, "events"), LIMIT).select("event_id", "user_id", "day", "nth", "allowed")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def daily_active(spark, sf_dir):
    return daily_active_of(table(spark, sf_dir, "events"))


@query("SELECT event_type, (props::JSON->>'k')::BIGINT // 25 AS quarter, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def event_breakdown(spark, sf_dir):
    quarter = F.floor(F.get_json_object("props", "$.k").cast("long") / 25)
    return table(spark, sf_dir, "events").groupBy("event_type", quarter.alias("quarter")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""
WITH a AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'view' GROUP BY 1),
b AS (SELECT a.user_id, t0, min(ts) AS t FROM a JOIN events e USING (user_id) WHERE event_type = 'click' AND ts >= t0 AND ts <= t0 + INTERVAL 7 DAY GROUP BY ALL),
c AS (SELECT b.user_id, min(ts) AS t FROM b JOIN events e USING (user_id) WHERE event_type = 'purchase' AND ts >= t AND ts <= t0 + INTERVAL 7 DAY GROUP BY ALL)
SELECT 'view' AS step, count(*) AS users FROM a UNION ALL SELECT 'click', count(*) FROM b UNION ALL SELECT 'purchase', count(*) FROM c""")
def funnel_7d(spark, sf_dir):
    return ev.funnel(table(spark, sf_dir, "events"), ["view", "click", "purchase"], 7)


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1")
def cohort_repeat(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cohort = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("k")).where("k >= 2").select("user_id")
    return e.join(cohort, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN nth >= 4 THEN '4+' ELSE nth::VARCHAR END AS bucket, count(*) AS n, round(avg(value), 6) AS mean_value FROM (
  SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type = 'signup') GROUP BY 1""")
def upload_ordinal_bucket(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select("value", upload_bucket(nth).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT user_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def consumed_stream(spark, sf_dir):
    """Daily counts by Structured Streaming over the events folder, taken once."""
    stream = quota.daily_counts(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema, lateness=None)
    return quota.run_once(stream, f"{shared_folder(spark)}/consumed_{uuid.uuid4().hex}")


@query("SELECT event_id, user_id, event_type, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY ts, event_id) = 1")
def first_of_day(spark, sf_dir):
    """The one event of a kind that a user may have a day, as with exports."""
    e = table(spark, sf_dir, "events").withColumn("day", kst_day(F.col("ts")))
    return first_of(e, ["user_id", "event_type", "day"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "day")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def daily_series(spark, sf_dir):
    one = lambda kind: F.count(F.when(F.col("event_type") == kind, 1)).alias(kind)
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(one("click"), one("purchase"), one("view"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users, count(*) AS n FROM events WHERE (props::JSON->>'k')::BIGINT >= 50 GROUP BY 1")
def property_daily(spark, sf_dir):
    wanted = F.get_json_object("props", "$.k").cast("long") >= 50
    return daily_active_of(table(spark, sf_dir, "events").where(wanted))


@query("""SELECT user_id, day, arg_max(value, o) FILTER (event_type = 'view') AS view, arg_max(value, o) FILTER (event_type = 'click') AS click
FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, {'ts': ts, 'event_id': event_id} AS o FROM events) GROUP BY ALL""")
def history_by_day(spark, sf_dir):
    """A day's entries of a user as one: the last value there is of each kind."""
    last = lambda kind: F.max_by(F.when(F.col("event_type") == kind, F.col("value")), F.when((F.col("event_type") == kind) & F.col("value").isNotNull(), F.struct("ts", "event_id"))).alias(kind)
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("user_id", "day").agg(last("view"), last("click"))
