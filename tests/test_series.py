"""Series and collapsed clusters against lists that take clusters one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.operators import clusters, collapse, series, spacing
from pagemill.plans import catalogue, series_plans, text_plans
from pagemill.sources.tables import lines, table

SF = "/root/testdata/sf0.001"
HANGUL, LETTERS = "가-힣", r"\p{L}"


def is_letter(c, letters):
    return c.isalpha() if letters == LETTERS else "가" <= c <= "힣"


def count(word, letters):
    return sum(is_letter(c, letters) for c in word)


def ranked(forms):
    return sorted(forms, key=lambda v: (-forms[v], v.count(" "), v))


def spaced_of(forms):
    return next((v for v in ranked(forms) if " " in v), None)


def weak(affix, least, letters):
    return not affix.strip() or re.fullmatch("[0-9]+", affix.strip()) is not None or count(affix, letters) < least


def offers(key, forms, end, least, letters):
    spaced = spaced_of(forms)
    if spaced and len(spaced.split()) >= 2:
        word = spaced.split()[-1 if end else 0]
        if not weak(word, least, letters):
            parts = [word[len(word) - n :] if end else word[:n] for n in range(len(word), least - 1, -1)]
            return [p for p in parts if not weak(p, least, letters)]
    runs = "".join(c if is_letter(c, letters) else " " for c in key).split()
    if not runs:
        return []
    run = runs[-1 if end else 0]
    parts = [run[len(run) - n :] if end else run[:n] for n in range(min(4, len(run) - 1), least - 1, -1)]
    return [p for p in parts if not weak(p, least, letters)]


def one_by_one(wanted, order, least):
    """Affixes in order take the keys that still are free."""
    free, out = set(wanted), {}
    for a in order:
        members = [k for k in wanted if a in wanted[k] and k in free]
        if len(members) >= least:
            free -= set(members)
            out |= dict.fromkeys(members, a)
    return out


def plain_longest(cl, least, letters):
    out = set()
    left = dict(cl)
    for kind, end in (("prefix", False), ("suffix", True)):
        wanted = {k: offers(k, f, end, least, letters) for k, f in left.items()}
        found = one_by_one(wanted, sorted({a for w in wanted.values() for a in w}, key=lambda a: (-len(a), a)), 2)
        out |= {(kind, a, k) for k, a in found.items()}
        left = {k: f for k, f in left.items() if k not in found}
    return out


def filler_weak(key, affix, end, letters):
    rest = key[: len(key) - len(affix)] if end else key[len(affix) :]
    return bool(rest) and (any(c.isascii() and c.isdigit() for c in rest) or count(rest, letters) < 2)


def plain_largest(cl, members, least, letters):
    wanted = {}
    for key, forms in cl.items():
        words = (spaced_of(forms) or "").split()
        if len(words) >= 2:
            sides = [("prefix", words[0]), ("suffix", words[-1])]
            wanted[key] = [s for s in sides if not weak(s[1], least, letters) and not filler_weak(key, s[1], s[0] == "suffix", letters)]
    size = {}
    for w in wanted.values():
        for a in w:
            size[a] = size.get(a, 0) + 1
    return {(*a, k) for k, a in one_by_one(wanted, sorted(size, key=lambda a: (-size[a], a)), members).items()}


def add(target, source, key):
    """A cluster's glued and first spaced counts go to another's."""
    t, s = spaced_of(target), spaced_of(source)
    target[key] = target.get(key, 0) + sum(n for v, n in source.items() if " " not in v)
    if t and s:
        target[t] += source[s]


def plain_nested(cl):
    out, gone = {k: dict(f) for k, f in cl.items()}, set()
    order = sorted(out, key=lambda k: (len(k), k))
    for i, short in enumerate(order):
        for long in order[i + 1 :]:
            a, b = (spaced_of(out[short]) or "").split(), (spaced_of(out[long]) or "").split()
            if short not in gone and long not in gone and len(a) >= 2 and a[:2] == b[:2] and len(b) > len(a) and len(long) > len(short) and long.startswith(short):
                add(out[short], out[long], short)
                gone.add(long)
    return {k: f for k, f in out.items() if k not in gone}


def plain_shared(cl, pivot, least, letters):
    order = sorted(cl, key=lambda k: (len(k), k))
    words = {k: spaced_of(cl[k]).split() for k in order if spaced_of(cl[k]) and len(spaced_of(cl[k]).split()) == 2}
    fixed, moving = (0, 1) if pivot == "first" else (1, 0)
    out = {}
    for key in order:
        forms, new = dict(cl[key]), key
        if key in words:
            best, mine = "", words[key][moving]
            for other, w in words.items():
                if other != key and w[fixed] == words[key][fixed]:
                    n = 0
                    while n < min(len(mine), len(w[moving])) and mine[n] == w[moving][n]:
                        n += 1
                    if count(mine[:n], letters) >= least and n > len(best):
                        best = mine[:n]
            if best and len(best) < len(mine):
                pair = [words[key][0], best] if pivot == "first" else [best, words[key][1]]
                forms, new = {"".join(pair): sum(n for v, n in forms.items() if " " not in v), " ".join(pair): forms[spaced_of(forms)]}, "".join(pair)
        if new in out:
            add(out[new], forms, new)
        else:
            out[new] = forms
    return out


def plain_units(cl, least, letters):
    out, gone = {k: dict(f) for k, f in cl.items()}, set()
    for long in sorted(out, key=lambda k: (-len(k), k)):
        fits = [k for k in out if k not in gone and len(k) < len(long) and long.startswith(k)]
        fits = [k for k in fits if spaced_of(out[k]) and len(spaced_of(out[k]).split()) == 2 and all(count(w, letters) >= least for w in spaced_of(out[k]).split())]
        if fits:
            add(out[max(fits, key=len)], out[long], max(fits, key=len))
            gone.add(long)
    return {k: f for k, f in out.items() if k not in gone}


def plain_normalised(cl, least, letters):
    x = plain_nested(cl)
    for pivot in ("first", "second"):
        x = plain_shared(x, pivot, least, letters)
    return plain_units(x, least, letters)


def frame(spark, cl):
    rows = [(k, v, n) for k, f in cl.items() for v, n in f.items()]
    return spark.createDataFrame(rows, "key string, variant string, n long").withColumn("into", F.lit("x")).repartition(3)


def read(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.key, {})[r.variant] = r.n
    return out


def random_clusters(seed, letters="가나다", size=40):
    rng = random.Random(seed)
    out = {}
    for _ in range(size):
        key = "".join(rng.choice(letters) for _ in range(rng.randrange(3, 8)))
        forms = {key: rng.randrange(1, 5)} if rng.random() < 0.9 else {}
        for _ in range(rng.randrange(1, 3)):
            at = sorted(rng.sample(range(1, len(key)), rng.randrange(1, min(3, len(key) - 1) + 1)))
            forms[" ".join(key[a:b] for a, b in zip([0, *at], [*at, len(key)]))] = rng.randrange(1, 5)
        out[key] = forms
    return out


@pytest.mark.parametrize("seed", range(2))
def test_series_one_by_one(spark, seed):
    cl = random_clusters(seed) | {"12가": {"12가": 1, "12 가": 1}, "가": {"가": 4}}
    df = frame(spark, cl)
    as_set = lambda x: {(r.affix_type, r.affix, r.key) for r in x.collect()}
    assert as_set(series.longest_first(df)) == plain_longest(cl, 2, HANGUL)
    for members in (1, 2):
        assert as_set(series.largest_first(df, members)) == plain_largest(cl, members, 2, HANGUL)


@pytest.mark.parametrize("seed", range(2))
def test_collapse_one_by_one(spark, seed):
    cl = random_clusters(seed, "가나다" if seed % 2 else "가나", 50)
    df = frame(spark, cl)
    assert read(collapse.without_nested(df)) == plain_nested(cl)
    for pivot in ("first", "second"):
        assert read(collapse.shared_beginnings(df, pivot)) == plain_shared(cl, pivot, 2, HANGUL)
    assert read(collapse.shorter_units(df)) == plain_units(cl, 2, HANGUL)
    assert read(collapse.normalised(df)) == plain_normalised(cl, 2, HANGUL)


def test_collapse_by_hand(spark):
    cl = {"경제회복": {"경제회복": 1, "경제 회복": 2}, "경제회복력": {"경제회복력": 3, "경제 회복력": 1}, "경제회복세": {"경제회복세": 1, "경제 회복세": 1}, "가치평가에": {"가치평가에": 1, "가치평가 에": 1}, "가치평가": {"가치평가": 2, "가치 평가": 2}}
    assert read(collapse.normalised(frame(spark, cl))) == {"경제회복": {"경제회복": 5, "경제 회복": 4}, "가치평가": {"가치평가": 3, "가치 평가": 3}}
    assert read(collapse.cleaned(frame(spark, {"가나,다": {"가나, 다": 2, "가나 다": 1}}))) == {"가나다": {"가나 다": 3}}


def test_nothing(spark):
    none = frame(spark, {"가나": {"가나": 1}}).where("n > 1")
    for f in (series.longest_first, series.largest_first, collapse.normalised, collapse.shorter_units):
        assert f(none).collect() == []
    assert series.listed(none, none.select("key", "variant")).collect() == []


def test_series_keep_two_conflicts_or_one_with_a_satellite(spark):
    cl = {"세계경제": {"세계경제": 3, "세계 경제": 1}, "국제경기": {"국제경기": 1, "국제 경기": 1}, "개인소득": {"개인소득": 1, "개인 소득": 1}, "개인사업": {"개인사업": 1, "개인 사업": 1}}
    singles = spark.createDataFrame([("세계시장", "세계 시장"), ("개인용품", "개인용품"), ("개인", "개인"), ("개인용", "개인용"), ("세계경제", "세계경제"), ("나라살림", "나라 살림")], "key string, variant string")
    got = {(r.key, r.affix, r.role) for r in series.listed(frame(spark, cl), singles).collect()}
    assert got == {("세계경제", "세계", "conflict"), ("세계시장", "세계", "satellite"), ("개인소득", "개인", "conflict"), ("개인사업", "개인", "conflict"), ("개인용품", "개인", "satellite"), ("국제경기", None, "single")}


def test_whole_table(spark):
    cl = read(text_plans._conflicts(spark, SF))
    assert read(series_plans.QUERIES["normalised_clusters"][0](spark, SF)) == plain_normalised({k: f for k, f in read(collapse.cleaned(text_plans._conflicts(spark, SF), LETTERS)).items()}, 3, LETTERS)
    assert {(r.affix_type, r.affix, r.key) for r in catalogue.queries()["series_by_size"](spark, SF).collect()} == plain_largest(cl, 2, 2, LETTERS)
    assert {r.role for r in catalogue.queries()["series_list"](spark, SF).collect()} >= {"conflict"}


def test_index_of_conflicts(spark):
    rows = [("가나 다라\n가나다라 x",), ("a  b c\nab c",), ("abc",), ("ab\nc",), (None,), ("",), (" \n ",), ("é é\néé" * 3,), ("w " * 2000 + "ww",)]
    texts = spark.createDataFrame(rows, "text string")
    full = spacing.ngram_index(lines(texts.withColumn("doc_id", F.lit(1))).select("line"), 4)
    both = full.join(spacing.conflicts(full).select("key"), "key", "left_semi")
    assert sorted(map(tuple, spacing.conflict_index(texts, 4).collect())) == sorted(map(tuple, both.collect()))
    assert spacing.conflict_index(texts.limit(0)).collect() == []


def in_turns(offers, least):
    free, out = {k for k, _, _ in offers}, set()
    for _, affix in sorted({(r, a) for _, a, r in offers}):
        keys = {k for k, a, _ in offers if a == affix and k in free}
        if len(keys) >= least:
            free -= keys
            out |= {(k, affix) for k in keys}
    return out


def test_greedy_takes_turns(spark):
    rng = random.Random(4)
    for least in (1, 2, 3):
        offers = {(f"k{rng.randrange(40)}", f"a{n}", n) for n in rng.choices(range(25), k=150)}
        got = series.greedy(spark.createDataFrame(sorted(offers), "key string, affix string, rank int"), least)
        assert {tuple(r) for r in got.collect()} == in_turns(offers, least)


@pytest.mark.parametrize("least", [1, 2])
def test_greedy_rounds_do_not_follow_chains(spark, monkeypatch, least):
    # Every affix is the best one for two keys of its own and shares a key with the next.
    offers = {(f"{side}{n}", f"a{n:02}", n) for n in range(15) for side in "xy"} | {(f"z{n}", f"a{m:02}", m) for n in range(14) for m in (n, n + 1)}
    rounds = []
    monkeypatch.setattr(series, "cut", lambda df, cut=series.cut: rounds.append(1) or cut(df))
    got = series.greedy(spark.createDataFrame(sorted(offers), "key string, affix string, rank int"), least)
    assert {tuple(r) for r in got.collect()} == in_turns(offers, least) and len(rounds) <= 2


def test_totals_from_counts(spark):
    rows = ["the end", "e nd end e nd", "t he the en d", "t", "엔드 t h e", None, "", "th\ne", "  end  e  nd "]
    texts = spark.createDataFrame([(t,) for t in rows], "text string").repartition(2)
    x = spacing.ngram_index(lines(texts.withColumn("doc_id", F.lit(1))).select("line"), 4)
    part = x.where("startswith(key, 'e')")
    choices = part.select("key", F.lit("e nd").alias("chosen")).distinct()
    got = clusters.totals_of(spacing.gram_counts(texts, 4, "th"), part, choices)
    assert got.collect() == clusters.totals(x, choices, x.where("startswith(key, 'th')").select("key")).collect()
    assert {r.words: r.n for r in spacing.gram_counts(texts, 2).collect()} == {1: x.where("key = variant").agg(F.sum("n")).first()[0], 2: x.where("length(variant) = length(key) + 1").agg(F.sum("n")).first()[0]}


def test_choice_totals_build_no_index(spark, monkeypatch):
    monkeypatch.setattr(spacing, "ngram_index", lambda *a, **b: pytest.fail("the whole index"))
    assert catalogue.queries()["choice_totals"](spark, SF).count() == 1
