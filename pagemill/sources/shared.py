"""Tables in the folder that all executors share, and Arrow passes with batches of bounded bytes."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch (a longer row is a batch of its own), so that a Python worker holds a few megabytes of text at a time.
BATCH_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share. Only a local session may do without: it gets one of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
    return named


#: Where the tables of cut() lie that are still there.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder; it is Parquet, so it is small and later steps read only the columns they need.

    Tables go with ``discard``. A table that a lazy result reads stays until the application ends: the file system deletes it then.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    df.write.parquet(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    _places[out] = at
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of a frame that cut() gave and that nothing reads any more; other frames are left alone."""
    at = _places.pop(df, None)
    if at is not None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes: the session's limit is lowered to BATCH_BYTES, or left if it is lower."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)
