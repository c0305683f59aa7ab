"""Structured Streaming form of the daily counters: events in, (user, day) counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import kst_day


def daily_counts(spark: SparkSession, folder: str, pattern: str, schema, lateness: str | None = "1 day", files_per_trigger: int = 4) -> DataFrame:
    """A streaming DataFrame (user_id, day, n) over Parquet files, of names by the pattern, that arrive in a folder.

    Repeated event ids within the lateness count once; state beyond it is dropped with the watermark. Without a lateness no event
    is late, and all event ids stay in the state.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    once = events.dropDuplicates(["event_id"]) if lateness is None else events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("user_id", kst_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, at: str) -> DataFrame:
    """Take all that has arrived, and give the counts as a DataFrame over Parquet tables in this folder of the shared file system.

    Each trigger writes the counts it changed; counts only grow, so the largest is the last.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{at}/counts/batch={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    none = spark.createDataFrame([], stream.schema)
    written = none if query.lastProgress is None else spark.read.schema(stream.schema).parquet(f"{at}/counts/batch=*")
    return written.groupBy("user_id", "day").agg(F.max("n").alias("n"))
