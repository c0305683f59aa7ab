"""The pipeline's near-dedup stage against brute-force Jaccard pairs."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402
from pagemill.llm import simhash  # noqa: E402
from tests.llm.test_operators import words  # noqa: E402


def brute_kept(rows):
    sets = {}
    for i, text in rows:
        w = words((text or "").encode().lower().decode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and a == b or 0 < max(len(a), len(b)) * 4 <= min(len(a), len(b)) * 5 and len(a & b) * 5 >= len(a | b) * 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in ids}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_stage_keeps_one_of_each_similar_group(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in cp.deduplicate(spark, docs, "").collect()} == brute_kept(rows)


def test_edited_copies(spark):
    random.seed(4)
    base = [[f"w{random.randrange(400)}" for _ in range(random.randint(3, 90))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 1, 2, 3, 4):
            c = list(b)
            for _ in range(edits):
                c[random.randrange(len(c))] = f"e{random.randrange(9)}"
            texts.append(" ".join(c))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + f" {k} {k + 1} {k * 7}" + " tail" * (k % 5) for k in range(50)] + ["", " ", "A b", "a B"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.deduplicate(spark, docs.repartition(5), "").collect()} == brute_kept(rows)


def test_rows_of_one_id_and_rows_without_words(spark):
    rows = [(3, "one"), (3, "two other words"), (4, None), (5, None), (6, ""), (7, "One"), (8, "two  other words"), (9, "x y z"), (9, "x y z"), (None, "one"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in cp.simhash_sets.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(3, "one"), (3, "two other words"), (4, None), (5, None), (6, ""), (9, "x y z"), (None, "one"), (None, None)], key=str)


def test_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cp.simhash_sets, "BLOCK", 60)
    monkeypatch.setattr(cp.simhash_sets, "BLOCK_ITEMS", 3000)
    random.seed(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(200):  # copies with several edits: some are similar to one another, few to the first
        c = list(base)
        for _ in range(random.randint(1, 2)):
            c[random.randrange(len(c))] = f"e{random.randrange(99)}"
        rows.append((i, " ".join(c)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in cp.simhash_sets.one_of_each(docs).collect()} == brute_kept(rows)


def test_bit_planes_of_several_words():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, (150, 4)).astype(np.uint64)
    fps[1::2] = fps[::2]
    fps[1::2, 2] ^= rng.integers(0, 2**20, 75).astype(np.uint64)
    hits = np.unpackbits(simhash.near(fps[:64], simhash.planes(fps), 9).view(np.uint8), axis=1, bitorder="little")[:, :150]
    assert (hits == (np.bitwise_count(fps[:64, None] ^ fps[None]).sum(axis=2) <= 9)).all()
