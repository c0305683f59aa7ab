"""Each stage against a plain version, on its own input."""

import re
import sys
from pathlib import Path

import numpy as np
import tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402
from tests.llm.test_operators import brute_repeats, odd_docs  # noqa: E402
from tests.llm.test_simhash_sets import brute_kept  # noqa: E402

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(cp.STAGES)[name]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    assert docs.columns == cp.COLUMNS

    kept = {r.doc_id for r in stage("quality")(spark, docs, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not [i for i, good in labels.items() if good and i not in kept]
    assert sum(i in kept for i, good in labels.items() if not good) <= 2

    assert {r.doc_id for r in stage("near_dedup")(spark, docs, SF).collect()} == brute_kept([(r.doc_id, r.text) for r in rows])

    cut = {r.doc_id: r for r in stage("substring_dedup")(spark, docs, SF).collect()}
    for i, _, n_removed, text in brute_repeats([(r.doc_id, r.text) for r in rows]):
        assert cut[i].text.encode().split() == text.encode().split()
        assert n_removed or cut[i].text == next(r.text for r in rows if r.doc_id == i)
        assert cut[i].n_chars == len(cut[i].text)

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in stage("decontamination")(spark, docs, SF).collect()} == {r.doc_id for r in rows if not any(i in r.text for i in items)}

    tokens = stage("bpe")(spark, docs, SF)
    assert tokens.count() == len(rows) and tokens.where(~F.col("round_trip")).count() == 0


def test_odd_rows_and_run(spark):
    docs = odd_docs(spark)
    for name, f in cp.STAGES:
        out = f(spark, docs, SF)
        assert name == "bpe" or out.columns == cp.COLUMNS
        assert out.count() > 0 and f(spark, docs.where("false"), SF).count() == 0


def test_run_is_the_stages_one_after_the_other(spark):
    rows = [(r.doc_id, r.text) for r in stage("quality")(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()]
    kept = brute_kept(rows)
    rows = brute_repeats([x for x in rows if x[0] in kept])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    library = tokenizers.Tokenizer.from_file(cp.tokenizer_path())
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    left = {i: text for i, _, _, text in rows if not any(x in text for x in items)}
    assert set(out) <= set(left)
    for i in set(left) - set(out):  # what is left of an item there is at least half of its windows
        w = re.findall(r"\w+", left[i].lower())
        windows = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        of = [[tuple(x[k : k + 8]) for k in range(max(1, len(x) - 7))] for x in (re.findall(r"\w+", t.lower()) for t in items)]
        assert any(sum(x in windows for x in item) * 2 >= len(item) for item in of)
    assert all(r.round_trip for r in out.values())
    for i, _, n_removed, _ in rows:
        if i in out and not n_removed:
            assert np.frombuffer(out[i].ids, "<u4").tolist() == library.encode(whole[i], add_special_tokens=False).ids
