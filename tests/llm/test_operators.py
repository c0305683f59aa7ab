"""The ten operators against brute force, libraries and round trips, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import ann, bpe, chat, components, decontaminate, html_blocks, html_extract, licenses, lstm, quality, sharding, simhash, substring_dedup
from pagemill.llm import queries as q
from pagemill.llm import textarrays as ta
from pagemill.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  \n\t ", "one", "a b", "ÄÖ ü é 漢字 😀 x", "w " * 3000, "Same text here " * 9, "Same text here " * 9, "x" * 5000]


def odd_docs(spark, extra: str = ""):
    """Nulls in any column, empty and long texts, repeated rows, and columns with the names that operators use."""
    rows = [(k, t, None, "s", None) for k, t in enumerate(ODD)] + [(None, "Same text here " * 9, "en", None, 3), (3, "one", None, "s", None), (3, "two other words", None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in extra.split():
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


def real_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# --- 1


def brute_fingerprint(text):
    w = words((text or "").encode().lower().decode())
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> i & 1 for s in shingles) for i in range(64)]
    return sum(1 << i for i in range(64) if counts[i] * 2 > len(shingles))


def test_simhash_fingerprints_and_components(spark):
    docs = real_docs(spark).select("doc_id", "text").limit(60).unionByName(odd_docs(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text")).where("doc_id is not null")
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {(r.doc_id, brute_fingerprint(r.text)) for r in rows}
    assert {(g.doc_id, int(g.fingerprint, 16)) for g in got} == prints
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= 2 or i == j:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {(g.doc_id, g.component_id) for g in got} == {(i, find(i)) for i, _ in prints}


@pytest.mark.parametrize("most", [2, 64, 2048])
def test_links_connect_what_is_near(spark, most):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:12]:
        for _ in range(25):  # chains of near values around a few centres
            fps.add(int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 4), replace=False)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, node long")
    edges = {tuple(sorted((r.a, r.b))) for r in simhash.links(frame, 2, most).collect()}
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 * len(fps) for a, b in edges)

    def classes(pairs):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return [find(i) for i in range(len(fps))]

    exact = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert classes(edges) == classes(exact)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_carry_save_counters(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    fps[60:90] = fps[:30] ^ np.uint64(0b1011)
    hits = np.unpackbits(simhash.near(fps, simhash.planes(fps), radius).view(np.uint8), axis=1, bitorder="little")[:, :130]
    assert (hits.astype(bool) == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)], "a long, b long")
    assert {(r.node, r.root) for r in components.components(edges).collect()} == {(k, 1) for k in range(2, 41)} | {(101, 100), (102, 100)}


def test_one_of_each_keeps_null_ids(spark):
    kept = simhash.one_of_each(odd_docs(spark)).collect()
    texts = [r.text for r in kept if r.doc_id is not None]
    assert texts.count("Same text here " * 9) == 1
    assert sum(r.doc_id is None for r in kept) == 1


# --- 2


@pytest.mark.parametrize("limit", [500, 20_000, 1 << 30])
def test_shards_fit(spark, limit):
    docs = real_docs(spark).select("doc_id", "text")
    rows = sharding.assign(docs, limit).collect()
    assert len(rows) == docs.count()
    sums = {}
    for r in rows:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
    assert all(sums[r.shard] == r.shard_bytes and (r.shard_bytes <= limit or sums[r.shard] == r.n_bytes) for r in rows)
    names = sorted(s for s in sums if "#" not in s)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    for n in names:  # no shard could have stayed whole
        if n and n[:-1] not in names:
            assert sum(v for k, v in sums.items() if k.startswith(n[:-1])) > limit


def test_shards_page_rows_of_one_hash(spark):
    docs = spark.createDataFrame([(7, "x" * 100)] * 50 + [(None, None), (8, "")], "doc_id long, text string")
    rows = sharding.assign(docs, 1000).collect()
    assert len(rows) == 52
    assert sorted({r.shard_bytes for r in rows if r.doc_id == 7}) == [1000]
    assert len({r.shard for r in rows if r.doc_id == 7}) == 5
    assert sharding.assign(docs.where("false"), 10).count() == 0


# --- 3


def test_quality_on_labels(spark):
    d = "/root/testdata/sf0.01"
    got = q.op3_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert sum((r.quality == 1) == r.keep for r in got) >= 0.97 * len(got)
    assert sum(r.quality == 1 and not r.keep for r in got) <= 0.01 * len(got)


def test_quality_odd(spark):
    out = quality.classify(odd_docs(spark, "score keep"))
    rows = out.collect()
    assert len(rows) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.keep for r in rows if not (r.text or "").strip())
    assert quality.classify(odd_docs(spark).where("false")).count() == 0


# --- 4


def test_decontamination(spark):
    bench = spark.createDataFrame(
        [(1, "A train leaves the town of Leeds at 40 km per hour and stops twice before noon on that day"), (2, "short item here"), (None, "no id at all"), (3, None)],
        "item_id long, text string",
    )
    docs = spark.createDataFrame(
        [
            (1, "Before. a train leaves the town of Leeds at 40 km per hour and stops twice before noon on that day, and more."),
            (2, "He said a train leaves the town of Paris at 75 miles per hour and stops twice before noon on that day"),
            (3, "a train leaves the town and stops"),
            (4, "there is a short item here indeed"),
            (5, None),
            (None, "a train leaves the town of Leeds at 40 km per hour and stops twice before noon on that day"),
        ],
        "doc_id long, text string",
    ).withColumn("hash", F.lit(1)).withColumn("item_ids", F.lit("old"))
    got = {r.doc_id: (r.item_ids, r.n_items) for r in decontaminate.judge(docs, bench).collect()}
    assert got == {1: ("1", 1), 2: ("1", 1), 3: ("", 0), 4: ("2", 1), 5: ("", 0), None: ("1", 1)}
    same = {r.doc_id: r.same_slots for r in decontaminate.contamination(docs, bench).where("item_id = 1").collect()}
    assert same[1] and not same[2]


def test_decontamination_wants_consistent_slots(spark):
    item = "Anna gave Bert 3 pears then Anna gave Bert 3 plums and after that Anna gave Bert 3 figs for the day"
    mixed = "Here Carl gave Dora 5 pears then Emma gave Fred 7 plums and after that Gina gave Hugo 9 figs for the day"
    swapped = "Here Carl gave Dora 5 pears then Carl gave Dora 5 plums and after that Carl gave Dora 5 figs for the day"
    bench = spark.createDataFrame([(1, "So " + item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, mixed), (2, swapped)], "doc_id long, text string")
    assert {r.doc_id: r.n_items for r in decontaminate.judge(docs, bench).collect()} == {1: 0, 2: 1}


def test_planted_items(spark):
    d = "/root/testdata/sf0.01"
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    expected = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").collect() if any(i in r.text for i in items)}
    assert {r.doc_id for r in q.op4_decontamination(spark, d).where("n_items > 0").collect()} == expected


# --- 5


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "ok"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, None, None), (None, 0, "user", "x")],
        "conv_id long, turn long, role string, text string",
    )
    got = {r.pair_id: r for r in chat.format_pairs(chat.pair_with_next(turns)).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.n_shared == 1 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert one.chosen == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nok<|im_end|>\n"
    assert one.rejected == "<|im_start|>assistant\nno<|im_end|>\n"
    a, b = map(int, one.chosen_mask.split("-"))
    assert one.chosen[a:b] == "yes<|im_end|>\n"
    assert got[2].rejected == "" and got[2].rejected_mask == ""
    assert got[3].n_shared == 1
    pairs = spark.createDataFrame([(1, None, None)], "pair_id long, chosen array<struct<turn:bigint,role:string,text:string>>, rejected array<struct<turn:bigint,role:string,text:string>>")
    assert chat.format_pairs(pairs).first().prompt == ""


# --- 6


def test_neighbours_recall_and_scores(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    got = {}
    for r in q.op6_neighbours(spark, d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for k in np.flatnonzero(ids % 50 == 0):
        score = ann.cosine(vectors[k], vectors)
        score[k] = -2
        best = np.lexsort((ids, -score))[:5]
        mine = sorted(got[ids[k]])
        hits += len({v for _, v, _ in mine} & set(ids[best].tolist()))
        total += 5
        for _, v, s in mine:
            assert s == score[np.flatnonzero(ids == v)[0]]
    assert hits >= 0.9 * total


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 2.0]), (None, [1.0, 1.0]), (50, [0.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = [tuple(r) for r in ann.search(frame, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.0), (0, 4, 50, 0.0), (50, 1, 8, 1.0), (50, 2, 0, 0.0), (50, 3, 1, 0.0), (50, 4, 2, 0.0)]
    assert ann.search(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


# --- 7


def test_blocks():
    html = '<head><title>T</title></head><body><nav><a href=x>a</a></nav><script>var x="</p>"</script><article><h1>A &amp; b</h1><p>one\n <b>two</b><br>three<p>four &lt;x&gt;</article><!-- no -->&copy; x'
    assert [(b.path[-1], b.text) for b in html_blocks.blocks(html)] == [("nav", "a"), ("h1", "A & b"), ("p", "one two three"), ("p", "four <x>"), ("body", "© x")]


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lstm.new_weights(5, 3, 1).items()}
    x, mask = lstm.pad([rng.normal(size=(4, 5)), rng.normal(size=(2, 5))])
    y = rng.integers(0, 2, mask.shape).astype(float)
    _, g = lstm.gradients(w, x, mask, y)
    for name in w:
        at = tuple(int(rng.integers(s)) for s in w[name].shape)
        step = 1e-3
        up, down = ({**w, name: w[name].copy()} for _ in range(2))
        up[name][at] += step
        down[name][at] -= step
        slope = (lstm.gradients(up, x, mask, y)[0] - lstm.gradients(down, x, mask, y)[0]) / (2 * step)
        assert abs(slope - g[name][at]) < 2e-3


def test_extract_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "plain")], "page_id long, url string, html string"))
    rows = {r.page_id: r for r in html_extract.extract(pages.withColumn("text", F.lit("old"))).collect()}
    assert rows[-1].text == "" and rows[-2].n_chars == 0
    for r in pages.where("page_id >= 0").collect():
        main = "\n".join(b.text for b in html_blocks.blocks(r.html) if "article" in b.path)
        assert rows[r.page_id].text == main and rows[r.page_id].n_chars == len(main)
    assert html_extract.extract(pages.where("false")).count() == 0


# --- 8


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    lib = Tokenizer.from_file(path)
    random.seed(1)
    alphabet = [*range(32, 127), *range(0xA0, 0x250), 0x4E00, 0x1F600, 10, 9, 0x2028, 0x85, 0x1C]
    texts = ["", "  ", "a<|endoftext|>b <|endoftext|>", "'ll we'll I've  \n\n x\t", "x" * 1000, "ab" * 700 + " 日本語" * 50, "!" * 900, " " * 500 + "a", "n_o _ __ 12_3"]
    texts += ["".join(chr(random.choice(alphabet)) for _ in range(120)) for _ in range(100)]
    codec = bpe.codec(path)
    for t, ids in zip(texts, codec.encode_all(texts), strict=True):
        expected = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert codec.decode(ids) == lib.decode(expected, skip_special_tokens=False) == t


def test_bpe_frames(spark):
    path = tokenizer_path()
    docs = odd_docs(spark, "ids decoded n_tokens")
    out = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(out) == docs.count() and all(r.decoded == (r.text or "") and r.n_tokens * 4 == len(r.ids) for r in out)
    assert bpe.encode(docs.where("false"), path).count() == 0


# --- 9


def test_licenses_against_regular_expressions(spark):
    docs = real_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "MIT License, mit-license; Apache\nLICENSE general public license"), (-2, "the mit licenses"), (-3, None)], "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for r in docs.collect():
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().lower())
        w = [x.decode() for x in w]
        at = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in licenses.BASE_PHRASES.items()}
        every = [i for x in at.values() for i in x]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k, x in at.items() if x)))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1
    assert licenses.scan_licenses(odd_docs(spark, "labels score")).count() == len(ODD) + 3


@pytest.mark.parametrize(
    "text, postfix",
    [("MIT OR GPL-2.0 AND ISC", ["MIT", "GPL-2.0", "ISC", "and", "or"]), ("(MIT OR ISC) AND BSD-3-Clause", ["MIT", "ISC", "or", "BSD-3-Clause", "and"]), ("GPL-2.0 WITH Classpath and MIT", ["GPL-2.0", "Classpath", "with", "MIT", "and"]), ("AND MIT", None), ("(MIT", None), ("", None)],
)
def test_expressions(text, postfix):
    assert licenses.parse(text) == postfix


def test_expression_scores():
    score = lambda e: licenses.evaluate(licenses.parse(e))[0]
    assert score("MIT OR GPL-2.0") == 1 and score("MIT AND GPL-2.0") == 0.4 and score("GPL-2.0 WITH X") == 0.7 and score("Unknown-1.0") == 0


# --- 10


def brute_repeats(rows, size=13):
    rows = [(i, words(t)) for i, t in rows]
    first = {}
    for i, w in rows:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def test_repeats_equal_brute_force(spark):
    random.seed(5)
    vocabulary = ["a", "b", "c"]
    texts = [" ".join(random.choice(vocabulary) for _ in range(random.randint(0, 60))) for _ in range(60)] + ["w " * 40, "w " * 30, " w" * 12, "w " * 13, "q w " * 20, "q w " * 25 + "z", "r " + "q w " * 15, "z q w q " * 12 + "q w " * 9]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k + 100, t) for k, t in enumerate(texts[:20])] + [(5, texts[30]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == brute_repeats(rows)


def test_repeats_do_not_depend_on_chunks(spark, monkeypatch):
    docs = real_docs(spark).select("doc_id", "text").limit(80)
    expected = brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    for parts in (1, 9):
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs.repartition(parts)).collect())
        assert got == expected


def test_repeats_odd(spark):
    docs = odd_docs(spark, "seeds spans n_words c0")
    out = substring_dedup.remove_repeats(docs).collect()
    assert len(out) == docs.count()
    by = [(r.doc_id, r.n_removed) for r in out if r.text and r.text.startswith("Same")]
    assert sorted(by, key=str) == [(7, 0), (8, 27), (None, 0)]
    assert substring_dedup.remove_repeats(docs.where("false")).count() == 0
    kept = substring_dedup.remove_repeats(docs, clean_layout=False).collect()
    assert all(r.kept_text == (r.text or "") for r in kept if not r.n_removed)


def test_word_arrays():
    texts = ["a  bb", "", " c", None, "dd"]
    raw, offsets = ta.buffers(pa.array(texts))
    w = ta.split(raw, offsets, ~ta.WHITE[raw])
    assert [bytes(raw[s:e]) for s, e in zip(w.start, w.end)] == [b"a", b"bb", b"c", b"dd"] and w.row.tolist() == [0, 0, 2, 4]
    again = ta.buffers(pa.array(["bb x dd"]))
    v = ta.split(*again, ~ta.WHITE[again[0]])
    assert v.hashes()[0] == w.hashes()[1] and v.hashes()[2] == w.hashes()[3]
    values = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for size in (1, 2, 5, 9):
        assert ta.sliding_min(values, size).tolist() == [min(values[i : i + size]) for i in range(51 - size)]


@pytest.mark.parametrize("name", ["op2_sharding", "op5_preferences", "op10_substrings"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(q.oracle_sql()[name])
    df = q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    theirs = sorted(str(tuple(r[rel.columns.index(c)] for c in cols)) for r in rel.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == theirs


def test_digests(spark):
    r = q.op8_bpe(spark, SF).orderBy("doc_id").first()
    text = real_docs(spark).where(F.col("doc_id") == r.doc_id).first().text
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
