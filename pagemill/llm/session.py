"""Small helpers on the Spark session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import BATCH_BYTES, cut, discard, in_batches, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def sampled(df: DataFrame, column: str, n: int, rows: int) -> list[str]:
    """About n distinct texts of a column, at most 2 n: those of the smallest hashes, so that a text is in or out whatever its row.

    rows is the number of df's rows. Only chosen texts leave their tasks.
    """
    h = F.xxhash64(column)
    share = min(1.0, n / max(1, rows))
    edge = (1 << 63) - 1 if share == 1 else int(-(1 << 63) + share * (1 << 64))
    chosen = df.where(h <= F.lit(edge)).select(h.alias("h"), column).groupBy("h").agg(F.first(column).alias("x"))
    return [r.x for r in sorted(chosen.limit(2 * n).collect(), key=lambda r: r.h)]
