"""Aligned segments against whole texts tokenised at once, link by link."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import alignment
from pagemill.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
MARKS = ["a", "B", "word", "don't", "Ünï", "漢字", "😀", "é", " ", "  ", "   ", "\n", "\n\n", "\t", "\r", "\r\n", "\v", "\f", " ", " ", "᠎", "\u0085", "\x1c", ";", "}", "{", "()", "12", "3.5", "'s", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "\u0000", "ﬁ"]


def plain(texts):
    """For each text [n_a, n_b, n_groups, n_links, n_best, count_sum, groups], from the whole text at once."""
    both = alignment.tokens(A, B)
    per, holders = [], Counter()
    for t in texts:
        ends, ids = [], []
        if t:
            a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
            raws = [[both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]]
            if all(b"".join(r) == (" " + t).encode() for r in raws):
                ids = [a, b]
                ends = [[sum(map(len, r[: k + 1])) for k in range(len(r))] for r in raws]
        if not ids:
            per.append(None)
            continue
        starts = [[0, *e[:-1]] for e in ends]
        links = [(ids[0][i], ids[1][j]) for i in range(len(ids[0])) for j in range(len(ids[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        groups, last = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(x) for x, e in zip(i, es) if last < e <= cut) for i, es in zip(ids, ends)))
            last = cut
        holders.update(set(links))
        per.append((len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    best = {}
    for (a, _), n in holders.items():
        best[a] = max(best.get(a, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (*p[:3], len(p[3]), sum(holders[x] == best[x[0]] for x in p[3]), sum(holders[x] for x in p[3]), p[4]) for p in per]


def ours(df, **options):
    out = alignment.align(df, A, B, **options).collect()
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("mine")).withColumn("segment", F.lit(1)).repartition(parts)


@pytest.mark.parametrize("block_chars, most_pairs", [(200, 0), (200, 10**6), (1 << 20, 0), (1 << 20, 10**6)])
def test_equals_whole_texts(spark, block_chars, most_pairs):
    rng = random.Random(block_chars)
    texts = [None, "", " ", "    ", "\n", "x", "▁", "a ▁b", "same text, twice", "same text, twice", "x" * 3000, "no spaces" * 50]
    texts += ["".join(rng.choice(MARKS) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    rows = [*enumerate(texts), (None, "null id"), (5, "again"), (5, "again")]
    expected = sorted((str(k), *p) for (k, _), p in zip(rows, plain([t for _, t in rows]), strict=True))
    assert ours(frame(spark, rows), block_chars=block_chars, bucket_chars=500, most_pairs=most_pairs) == expected


def test_equals_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted((str(k), *p) for (k, _), p in zip(rows, plain([t for _, t in rows]), strict=True))
    assert ours(docs) == expected


def test_empty_table(spark):
    assert ours(frame(spark, [])) == []


def test_where_segments_begin():
    both = alignment.tokens(A, B)
    assert " " in both.before and "\n" in both.before and "\r" not in both.before  # "}\r" and the like are pieces
    assert both.segments("a  b\n\n c\r d  e") == [" a", "  b", "\n\n c\r d  e"]
    assert both.segments("\n") == [" \n"]


def test_a_block_costs_little_more_than_a_sort():
    """CPU time of a block of half a million tokens of each side, against that of a sort of as many numbers: about 1.5 times; hashed sets of ends and pairs took 7.5 times."""
    rng = random.Random(13)
    words = [" " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 14))) for _ in range(8000)]
    kinds = alignment.tokens(A, B).tokenise(words)
    times = 500_000 // len(kinds[1])
    row = {"doc_ids": list(range(800)), "sizes": alignment.packed(np.full(800, 10 * times)), "numbers": alignment.packed(np.arange(8000 * times))}
    row |= {name: alignment.packed(np.tile(x, times)) for name, x in zip(["a_sizes", "a_ids", "b_sizes", "b_ids"], kinds, strict=True)}
    tables = alignment._tables(A, B)

    def whole():
        block = alignment.Block(row, tables)
        assert len(block.groups()) == 8000 * times and block.pair_counts()[1].sum() > 0

    def least(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    mixed = np.random.default_rng(13).integers(0, 1 << 40, 1_000_000)
    assert least(whole) < 4 * least(lambda: mixed.argsort(kind="stable"))
