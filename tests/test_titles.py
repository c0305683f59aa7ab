"""Similar titles and one-to-one matching against all pairs and turns."""

import random

import pytest

from pagemill.operators import titles
from pagemill.plans import catalogue

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def score(a, b):
    a, b = ("".join((t or "").split()).lower() for t in (a, b))
    return 1 - distance(a, b) / max(len(a), len(b)) if a and b else 0.0


def plain(left, right, least):
    return {(i, j): score(a, b) for i, a in left for j, b in right if score(a, b) >= least}


def turns(pairs):
    used, out = set(), {}
    for i in sorted({i for i, _ in pairs}):
        free = [(-s, j) for (k, j), s in pairs.items() if k == i and j not in used]
        if free:
            out[i] = min(free)[1]
            used.add(out[i])
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string").repartition(3)


def words(rng, letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(most)))


@pytest.mark.parametrize("seed, least", [(0, 0.72), (1, 0.88), (2, 0.55)])
def test_near_titles_are_all_found(spark, seed, least):
    rng = random.Random(seed)
    left = [(k, words(rng, "ab c", 14 if k % 2 else 40)) for k in range(60)] + [(90, None), (91, ""), (92, " "), (93, "가나다라"), (94, "É"), (94, "é")]
    right = [(k, words(rng, "ab c", 14)) for k in range(60)] + [(70 + i, "".join(c for c in (t or "") if rng.random() < 0.9)) for i, (_, t) in enumerate(left)] + [(200, "가나다"), (201, "é")]
    got = {(r.left_id, r.right_id): r.score for r in titles.near_titles(frame(spark, left), frame(spark, right), least).collect()}
    expected = plain(left, right, least)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("few", [0, 70])
def test_few_titles_and_many(spark, few):
    rng = random.Random(8)
    left = [(k, words(rng, "ab c", 14 if k % 2 else 40)) for k in range(60)] + [(90, None), (91, " "), (92, "É")]
    right = [(k, words(rng, "ab c", 14)) for k in range(90)] + [(100 + i, "".join(c for c in (t or "") if rng.random() < 0.9)) for i, (_, t) in enumerate(left)] + [(200, "a" * 5000), (201, "é")]
    for a, b in ((left, right), (right, left)):
        got = {(r.left_id, r.right_id): r.score for r in titles.near_titles(frame(spark, a), frame(spark, b), 0.72, few).collect()}
        expected = plain(a, b, 0.72)
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert titles.near_titles(frame(spark, left), frame(spark, [(1, None), (2, " ")])).collect() == []


def test_few_titles_are_compared_in_many_tasks(spark):
    left, right = [(k, f"title {k}") for k in range(30)], [(k, f"a title {k}") for k in range(300)]
    near = titles.near_titles(frame(spark, left), frame(spark, right))
    assert near.count() and "Generate" not in near._jdf.queryExecution().executedPlan().toString() and near._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1


def test_turns(spark):
    rng = random.Random(5)
    for _ in range(3):
        pairs = {(rng.randrange(12), rng.randrange(9)): rng.randrange(3) / 4 + 0.25 for _ in range(50)}
        df = spark.createDataFrame([(i, j, s) for (i, j), s in pairs.items()], "left_id long, right_id long, score double")
        assert {r.left_id: r.right_id for r in titles.in_order(df).collect()} == turns(pairs)
    assert titles.in_order(df.limit(0)).collect() == []


def test_outline(spark):
    entries = frame(spark, [(1, "제1장 서론"), (2, "The old mill on the river"), (3, "The old mill on the river"), (4, "An ending of some kind"), (5, "nothing like it")])
    found = frame(spark, [(10, "제 1장 서론"), (11, "the old mill on the river"), (12, "An ending of sorts"), (13, "else")])
    got = {(r.left_id, r.right_id, r.kind) for r in titles.outline(entries, found).collect()}
    assert got == {(1, 10, "same"), (2, 11, "same"), (3, 11, "hint"), (None, 12, "alone"), (None, 13, "alone")} | ({(4, 12, "hint")} if score("An ending of some kind", "An ending of sorts") >= 0.72 else set())


def test_whole_table(spark):
    rows = lambda name, key: [(r[key], (r.text or "").split(".")[0]) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    left, right = rows("benchmark", "item_id"), [(k, t) for k, t in rows("documents", "doc_id")]
    near = plain(left, right, 0.72)
    got = catalogue.queries()["title_pairs"](spark, SF).collect()
    assert {r.left_id: r.right_id for r in got if r.kind == "same"} == turns({k: s for k, s in near.items() if s >= 0.88})
    assert {r.right_id for r in got if r.kind in ("same", "alone")} == {j for j, _ in right}
