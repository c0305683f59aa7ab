"""Joined lines against joining them one after another."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import wraps
from pagemill.plans import catalogue
from pagemill.sources.tables import lines

HANGUL = lambda c: "가" <= c <= "힣"


def breaks(a, b):
    word = a.split()[-1]
    if not (HANGUL(a[-1]) and HANGUL(b[0])) or sum(map(HANGUL, word)) != 1:
        return False
    if a[-1] in wraps.PARTICLES or word in wraps.STANDALONE or (b[0] in wraps.PARTICLES and not HANGUL(b[1:2] or " ")):
        return False
    return not (a[-1] in wraps.CLOSING and len(b) > 1 and HANGUL(b[1]))


def plain(text):
    out, at = [], 0
    for n, raw in enumerate(text.split("\n")):
        line = raw.strip(" \t")
        start = at + len(raw) - len(raw.lstrip(" \t"))
        at += len(raw) + 1
        if not line:
            continue
        if out and breaks(out[-1][1], line):
            first, whole, pieces = out[-1]
            out[-1] = (first, whole + line, [*pieces, (len(whole), start)])
        else:
            out.append((n, line, [(0, start)]))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_one_after_another(spark, seed):
    rng = random.Random(seed)
    texts = ["우리 나라에는 명\n지 계곡 외에도 영월\n수도\n있다", "가\n나\n다\n라\n바", "물가 간\n악순환", "바 다\n가 있다", "보인 다\n그래서", "", " \n\t\n", "명  \n\n  지 계곡"]
    texts += ["".join(rng.choice("명지계곡다가간 \n\na\t") for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").repartition(3)
    got = {}
    for r in wraps.joined_lines(lines(docs)).collect():
        got.setdefault(r.doc_id, []).append((r.line_num, r.line, [tuple(p) for p in r.pieces]))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain(t) for k, t in enumerate(texts) if plain(t)}


def test_places_in_the_text(spark):
    text = "우리 나라에는  명 \n  지 계곡 외에도"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = wraps.joined_lines(lines(docs)).first()
    assert whole.line == "우리 나라에는  명지 계곡 외에도"
    every = wraps.joined_lines(lines(docs)).select("line", "pieces", F.explode(F.sequence(F.lit(0), F.length("line") - 1)).alias("k")).select(F.substr("line", F.col("k") + 1, F.lit(1)).alias("c"), wraps.in_text(F.col("pieces"), F.col("k")).alias("at"))
    assert all(text[r["at"]] == r["c"] for r in every.collect())


def test_registered(spark):
    rows = catalogue.queries()["joined_lines"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.lines >= r.joined for r in rows)
