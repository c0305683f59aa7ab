"""Operators against plain versions of their methods."""

import itertools
import random

import numpy as np
import tokenizers
from pyspark.sql import functions as F

from pagemill.llm import ann, bpe, decontaminate, licenses, quality
from pagemill.llm.queries import tokenizer_path


def test_em_equals_a_plain_one():
    rng = np.random.default_rng(2)
    k = len(quality.LABELLERS)
    patterns = rng.integers(0, 3, (40, k))
    counts = rng.integers(1, 50, 40).astype(float)
    got = quality.expectation_maximisation(patterns, counts, rounds=7)
    prior, table = 0.8, [[[0.3, 0.4, 0.3] for _ in range(k)], [[0.01, 0.69, 0.3] for _ in range(k)]]
    for _ in range(7):
        post = []
        for p in patterns:
            like = [1 - prior, prior]
            for c in (0, 1):
                for j in range(k):
                    like[c] *= table[c][j][p[j]] if p[j] != quality.NONE else 1
            post.append(like[1] / (like[0] + like[1]))
        prior = sum(p * n for p, n in zip(post, counts)) / counts.sum()
        table = [[[1.0] * 3 for _ in range(k)] for _ in (0, 1)]
        for p, w, n in zip(patterns, post, counts):
            for j in range(k):
                table[1][j][p[j]] += w * n
                table[0][j][p[j]] += (1 - w) * n
        for c in (0, 1):
            for j in range(k):
                t = [x / sum(table[c][j]) for x in table[c][j]]
                told = t[0] + t[1]
                bad = min(t[quality.BAD], quality.MOST_ALARMS[c] * told)
                t[quality.BAD], t[quality.GOOD] = bad, told - bad
                table[c][j] = t
    assert abs(got["prior"] - prior) < 1e-9 and np.allclose(got["table"], table)


def test_scorer_ends_where_the_gradient_is_nought():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 4)), rng.random(200)
    w = quality.fit_scorer(x, y, rounds=3000)
    full = np.concatenate([x, np.ones((200, 1))], axis=1)
    slope = [sum((1 / (1 + np.exp(-row @ w)) - t) * row[j] for row, t in zip(full, y)) / 200 + 1e-5 * w[j] for j in range(5)]
    assert max(map(abs, slope)) < 1e-6


def test_recall_over_several_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 32))
    vectors = (centres[rng.integers(0, 300, 20_000)] + 0.5 * rng.normal(size=(20_000, 32))).astype(np.float32)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>").repartition(8)
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 500 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, 20_000, 500):
        score = ann.cosine(vectors[i].astype(float), vectors.astype(float))
        score[i] = -2
        hits += len(got[i] & set(np.lexsort((np.arange(20_000), -score))[:5].tolist()))
    assert ann.BLOCK < 20_000 and len(got) == 40 and hits >= 0.9 * 200


def test_very_small_and_large_vectors(spark):
    rows = [(0, [1e-170, 0.0]), (1, [1e-170, 1e-170]), (2, [1e200, 0.0]), (3, [0.0, 3e300]), (4, [1.0, 1.0]), (5, [5e-324, 0.0])]
    got = [tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [r[2] for r in got] == [2, 5, 1, 4, 3] and got[0][3] == got[1][3] == 1.0 and abs(got[2][3] - 0.5**0.5) < 1e-15 and got[4][3] == 0.0


def plain_expression(tokens):
    """Score of an expression by recursive descent: OR weakest, then AND, then WITH."""

    def level(k):
        if k == 3:
            t = tokens.pop(0)
            if t == "(":
                x = level(0)
                tokens.pop(0)
                return x
            label = licenses.label_of(t)
            return licenses.FREEDOM.get(label, 0.0)
        x = level(k + 1)
        while tokens and tokens[0] == ("OR", "AND", "WITH")[k]:
            tokens.pop(0)
            y = level(k + 1)
            x = (max(x, y), min(x, y), (1 + x) / 2)[k]
        return x

    return level(0)


def test_expressions_equal_recursive_descent():
    random.seed(6)
    names = ["MIT", "GPL-2.0-only", "CC-BY-NC-4.0", "Other-1.0", "MPL-2.0"]

    def make(depth):
        if depth == 0 or random.random() < 0.3:
            return [random.choice(names)]
        inside = [*make(depth - 1), random.choice(["AND", "OR"]), *make(depth - 1)]
        return ["(", *inside, ")"] if random.random() < 0.5 else inside

    for _ in range(200):
        tokens = make(3)
        score = licenses.evaluate(licenses.parse(" ".join(tokens)))[0]
        assert abs(score - plain_expression(list(tokens))) < 1e-12


def test_identifiers_are_whole_tokens():
    of = licenses.label_of
    assert [of(x) for x in ("MIT", "mit-0", "Mitre-1.0", "Apache-2.0", "Apache-9", "GPL-3.0+", "LGPL-2.1-or-later", "BSD-3-Clause-Clear", "GPL-CC-1.0", "CC-BY-SA-4.0", "CC-BY-NC-ND-3.0")] == ["mit", "mit", None, "apache", None, "gpl", "lgpl", "bsd", None, "cc-by-sa", "cc-by-nc"]
    scan = lambda t: licenses.scan(t.encode())
    assert scan("SPDX-License-Identifier: GPL-2.0 WITH GPL-CC-1.0")[5:] == ("gpl", 0.7)
    assert scan("SPDX-License-\n * Identifier: MIT\nx")[5:] == ("mit", 1.0)
    assert scan("spdx license identifier")[5:] == ("unparsed", 0.0)
    assert scan("é mit license, x apache\tLicense MIT license")[:4] == (8, 3, 1, 6)


def test_short_items_and_equal_values(spark):
    items = spark.createDataFrame([(1, "pears"), (2, "two pears"), (3, "The shop sells 3 pears and 3 plums to each of its guests today"), (4, "Red pears fall")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "I like pears very much"), (2, "Pears"), (3, "I know the shop sells 5 pears and 7 plums to each of its guests today and more"), (4, "she said red pears fall often"), (5, "a two pears b")], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.judge(docs, items).collect()}
    assert got == {1: "", 2: "1", 3: "3", 4: "4", 5: ""}


def plain_windows(text):
    """Lower-case words of a text without capitals or numbers, in windows of 8."""
    w = text.split()
    return [tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))]


def test_plain_texts_by_brute_force(spark):
    random.seed(8)
    vocabulary = [f"w{c}" for c in "abcdefghijklmnop"]
    vocabulary = [a + b for a, b in itertools.product("bcdfgk", "aeiou")]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.randint(4, 20)))) for i in range(12)]
    docs = []
    for i in range(60):
        w = [random.choice(vocabulary) for _ in range(20)]
        t = random.choice(items)[1].split()
        if i % 2:
            a = random.randrange(len(t))
            w[5:5] = t[a:] if i % 4 == 1 else t
        docs.append((i, " ".join(w)))
    got = {r.doc_id: r.item_ids for r in decontaminate.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in docs:
        w = text.split()
        want = []
        for k, t in items:
            n = min(8, len(t.split()))
            of = plain_windows(t)
            there = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}
            if sum(x in there for x in of) * 2 >= len(of):
                want.append(k)
        assert got[i] == ",".join(map(str, sorted(want)))


def test_long_words_equal_the_library():
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    c = bpe.codec(tokenizer_path())
    random.seed(9)
    for size in (63, 64, 65, 130, 400, 900):
        for letters in ("ab", "etaoinshr", "xyzéß", "0123456789", "-=/"):
            word = "".join(random.choice(letters) for _ in range(size))
            assert np.frombuffer(c.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_hashes_of_a_text_are_independent(spark):
    """xxhash64(text, 1) is a function of xxhash64(text); xxhash64(1, text) is not."""
    rows = spark.createDataFrame([("a",), ("b",)], "t string").select(F.xxhash64("t").alias("h"), F.xxhash64("t", F.lit(1)).alias("chained"), F.xxhash64(F.lit(1), F.col("t")).alias("t2"), F.expr("xxhash64(1)").alias("one")).collect()
    for r in rows:
        again = spark.range(1).select(F.xxhash64(F.lit("x")).alias("x")).first()
        assert r.t2 != r.chained and r.t2 != r.h and again.x


def test_rows_of_one_query_id_are_searches_of_their_own(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.0]), *[(k, [1.0, 0.1 * k]) for k in range(1, 8)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 50 == 0, k=3).collect())
    assert got == sorted([(1, 1), (2, 2), (3, 3), (1, 7), (2, 6), (3, 5)])


def test_long_texts_of_few_words_are_told_like_short_ones():
    import pyarrow as pa

    rng = random.Random(4)
    few, many = [f"w{k}" for k in range(60)], [f"v{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(few) for _ in range(5000)), " ".join(rng.choice(many) for _ in range(5000)), " ".join(rng.choice(few[:8]) for _ in range(60)), " ".join(rng.choice(many) for _ in range(60))]
    told = np.concatenate([quality.votes(quality._measures(*x)[0], np.zeros(len(x[2]) - 1, bool))[:, 7] for x in quality._chunks(pa.array(texts))])
    assert told.tolist() == [quality.BAD, quality.GOOD, quality.BAD, quality.GOOD]


def test_further_identifiers_and_unknown_ones():
    scan = lambda t: licenses.scan(t.encode())[5:]
    assert [licenses.label_of(x) for x in ("Zlib", "BSL-1.0", "EUPL-1.2", "Artistic-2.0", "OFL-1.1", "CDDL-1.0", "PostgreSQL", "Zlibx")] == ["zlib", "bsl", "eupl", "artistic", "ofl", "cddl", "permissive", None]
    assert scan("SPDX-License-Identifier: MIT AND BSL-1.0") == ("bsl,mit", 1.0)
    assert scan("SPDX-License-Identifier: MIT OR Other-9") == ("mit,unknown", 1.0)
    assert scan("under the BSD 3-Clause License")[0] == "bsd" and scan("GNU AGPL v3")[0] == "agpl"


def test_written_shards_hold_every_row_within_the_limit(spark, tmp_path):
    from pagemill.llm import sharding

    rows = [(k, f"text {k} " * (k % 7)) for k in range(200)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("mine"))
    at = f"{tmp_path}/shards"
    sharding.write_shards(docs, at, limit=400)
    back = spark.read.option("basePath", at).schema("doc_id long, text string, shard string").parquet(at).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(rows, key=str)
    sizes = {}
    for r in back:
        sizes[r.shard] = sizes.get(r.shard, 0) + len((r.text or "").encode())
    assert len(sizes) > 10 and max(sizes.values()) <= 400
