"""Events: sessions, runs, quotas, funnels and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kst_day


def runs(events: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    """Consecutive rows of equal key as one: by, run (from 1), key, n."""
    w = Window.partitionBy(by).orderBy(*order)
    fresh = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("long")
    return events.withColumn("__f", fresh).withColumn("run", F.sum("__f").over(w)).groupBy(by, "run", key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, by: str, at: str, gap_seconds: float, tie: str) -> DataFrame:
    """Events merged while the gap is below the limit (a gap of exactly the limit opens a session): by, session, started, ended, n."""
    w = Window.partitionBy(by).orderBy(at, tie)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    fresh = F.coalesce((gap >= int(gap_seconds * 1_000_000)).cast("long"), F.lit(1).cast("long"))
    return events.withColumn("__f", fresh).withColumn("session", F.sum("__f").over(w)).groupBy(by, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))


def consumed(events: DataFrame, limit: int) -> DataFrame:
    """Events with their ordinal among the user's of the day in Korea, and whether the daily limit allows them."""
    day = kst_day(F.col("ts"))
    nth = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return events.withColumn("day", day).withColumn("nth", nth.cast("long")).withColumn("allowed", F.col("nth") <= limit)


def funnel(events: DataFrame, steps: list[str], days: int) -> DataFrame:
    """(step, users): users whose first event of each step follows the one before within the days.

    A step counts from the first event of its kind at or after the previous step's, within the window of the first step.
    """
    first = events.where(F.col("event_type") == steps[0]).groupBy("user_id").agg(F.min("ts").alias("t0"))
    reached, out = first.withColumn("t", F.col("t0")), []
    out.append(reached.agg(F.count("*").alias("users")).select(F.lit(steps[0]).alias("step"), "users"))
    for s in steps[1:]:
        nxt = events.where(F.col("event_type") == s).select("user_id", F.col("ts").alias("u"))
        reached = reached.join(nxt, "user_id").where((F.col("u") >= F.col("t")) & (F.col("u") <= F.col("t0") + F.expr(f"interval {days} days"))).groupBy("user_id", "t0").agg(F.min("u").alias("t"))
        out.append(reached.agg(F.count("*").alias("users")).select(F.lit(s).alias("step"), "users"))
    all_steps = out[0]
    for x in out[1:]:
        all_steps = all_steps.unionByName(x)
    return all_steps
