"""The corpus pipeline: classify, deduplicate, cut repeats, decontaminate, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents (doc_id, text, lang, source, n_chars). Rows and columns with nulls follow the
operators' own rules; a stage never drops a row for a null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, quality, simhash_sets, substring_dedup
from pagemill.llm.queries import tokenizer_path
from pagemill.llm.session import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.classify(docs).where("keep").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8), the one of the smallest doc_id; texts without words stay."""
    return simhash_sets.one_of_each(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one; n_chars follows the text."""
    out = substring_dedup.remove_repeats(docs.select(*COLUMNS), clean_layout=False)
    changed = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", changed).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontaminate.judge(docs, table(spark, sf_dir, "benchmark")).where("n_items = 0").select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): token ids, and whether decoding gives the text back."""
    path = tokenizer_path()
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    return out.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality", classify), ("near_dedup", deduplicate), ("substring_dedup", cut_repeats), ("decontamination", decontaminated), ("bpe", tokenise)]

#: Posteriors, fingerprints and merges have no SQL form; tests/llm compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between two stages is a table in the shared folder, removed once the next one is written."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
