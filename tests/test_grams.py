"""Packed windows of words against the whole index, with buckets so small that borders run through most keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import grams, spacing
from pagemill.plans import catalogue
from pagemill.sources.tables import lines

SF = "/root/testdata/sf0.001"


def texts(spark, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice("aab é\n ") for _ in range(rng.randrange(300))) for _ in range(30)] + [None, "", " ", "x" * 70000 + " y " + "x" * 300, "a\0 a", "a \0", "엔드 가 나\n가나"]
    return spark.createDataFrame([(t,) for t in made], "text string").repartition(3)


@pytest.mark.parametrize("most", [2, 6])
@pytest.mark.parametrize("cut", [1, 8, 1000])
def test_index_by_buckets(spark, monkeypatch, cut, most):
    t = texts(spark, cut)
    index = spacing.ngram_index(lines(t.withColumn("doc_id", F.lit(1))).select("line"), most)
    keys = sorted({int.from_bytes(r.key.encode()[:8].ljust(8, b"\0"), "big") for r in index.collect()})
    monkeypatch.setattr(grams, "_borders", lambda *a: np.array(keys[1::cut], np.uint64))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(grams.selected(t, most).select(*index.columns)) == rows(index)
    several = index.groupBy("key").agg(F.sum("n").alias("t"), F.count("*").alias("f")).where("t >= 4 and f >= 2").select("key")
    assert rows(grams.selected(t, most, 4, 2).select(*index.columns)) == rows(index.join(several, "key", "left_semi").select(*index.columns))
    alone = index.groupBy("key").agg(F.count("*").alias("f"), F.first("variant").alias("variant")).where("f = 1").select("key", "variant")
    assert rows(grams.singles(t, most)) == rows(alone)
    by = index.groupBy((F.length("variant") - F.length("key") + 1).alias("words")).agg(F.count("*"), F.sum("n"), F.max("n"))
    assert rows(grams.sizes(t, most)) == rows(by)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    t = spark.createDataFrame([("ab c a bc\nabc x yz",)], "text string")
    index = spacing.ngram_index(lines(t.withColumn("doc_id", F.lit(1))).select("line"), 3)
    bucket = next(iter(grams._packed(spacing.Chunk(["ab c a bc\nabc x yz"]), 3, np.zeros(0, np.uint64))))
    monkeypatch.setattr(grams.Bucket, "_hashes", lambda self, most: [np.zeros(len(self.starts), np.uint64)] * most)
    found = grams.Bucket([{"words": bucket[1], "windows": bucket[2]}], 3, np.zeros(0, np.uint64))
    assert sorted((found.form(k), int(found.n[k])) for k in range(len(found.n))) == sorted((r.variant, r.n) for r in index.collect())


@pytest.mark.parametrize("name", ["ngram_index", "cluster_order", "strong_clusters", "series_list"])
def test_queries_send_no_index(spark, monkeypatch, name):
    monkeypatch.setattr(spacing, "ngram_index", lambda *a, **b: pytest.fail("the whole index"))
    assert catalogue.queries()[name](spark, SF).count()
