"""Merging records: last writer wins, tombstones, names, quotas of presets, histories, as-of choice, byte budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_writer_wins(a: DataFrame, b: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of both sides, the newer one per key; of equally old ones that of a. Adds src ('a' or 'b')."""
    both = a.withColumn("src", F.lit("a")).unionByName(b.withColumn("src", F.lit("b")))
    columns = [c for c in both.columns if c != key]
    newest = F.max_by(F.struct(*columns), F.struct(F.col(at).alias("at"), (F.col("src") == "a").cast("int").alias("first")))
    return both.groupBy(key).agg(newest.alias("x")).select(key, "x.*")


def newest_tombstones(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("id").agg(F.max("deleted_at").alias("deleted_at"))


def apply_tombstones(rows: DataFrame, tombstones: DataFrame, key: str, at: str) -> DataFrame:
    """rows that no tombstone covers, or that were saved after it."""
    return rows.join(tombstones, rows[key] == tombstones["id"], "left").where(F.col("deleted_at").isNull() | (F.col(at) > F.col("deleted_at"))).drop("id", "deleted_at")


def surviving_tombstones(tombstones: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    return tombstones.join(rows, (rows[key] == tombstones["id"]) & (rows[at] > tombstones["deleted_at"]), "left_anti")


def newest_per(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__n = 1").drop("__n")


def within_quota(rows: DataFrame, by: str, order: list[Column], most: int, always: Column) -> DataFrame:
    """The first ``most`` rows of each group, and those that are always kept (they do not count)."""
    n = F.row_number().over(Window.partitionBy(by, always).orderBy(*order))
    return rows.withColumn("__n", n).where(always | (F.col("__n") <= most)).drop("__n")


def merge_histories(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer merge; a's value wins where it has one."""
    x, y = a.alias("x"), b.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return x.join(y, condition, "full_outer").select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in [*key, *values]])


def byte_budget(rows: DataFrame, by: str, order: str, size: Column, limit: int, parts: int = 4096) -> DataFrame:
    """Leading rows of each group whose sizes sum to at most the limit; adds used, the sum so far. Rows without an order come first.

    A group's range of the (numeric) order is cut into parts of equal width. Sums of parts say what stands before each; only parts that begin within the limit are
    summed row by row, each on its own, so that a large group is no single task.
    """
    ends = rows.groupBy(by).agg(F.min(order).cast("double").alias("__a"), F.max(order).cast("double").alias("__b"))
    at = F.when(F.col("__a") < F.col("__b"), F.expr(f"width_bucket(cast({order} as double), __a, __b, {parts})"))
    placed = rows.join(ends, rows[by].eqNullSafe(ends[by])).drop(ends[by]).withColumn("__part", F.when(F.col(order).isNull(), -1).otherwise(F.coalesce(at, F.lit(0)))).drop("__a", "__b").withColumn("__size", size)
    sums = placed.groupBy(by, "__part").agg(F.sum("__size").alias("__sum")).withColumn("__all", F.sum("__sum").over(Window.partitionBy(by).orderBy("__part")))
    open_ = sums.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), (F.col("__all") - F.col("__sum")).alias("__before")).where(F.col("__before") <= limit)
    kept = placed.join(open_, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p")))
    used = F.col("__before") + F.sum("__size").over(Window.partitionBy(by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("used", used.cast("long")).where(F.col("used") <= limit).drop("__by", "__p", "__part", "__before", "__size")
