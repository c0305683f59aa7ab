"""Pattern rules by hand and against every rule tried on every form."""

import random

from pyspark.sql import functions as F

from pagemill.operators import patterns


def test_rules_from_choices(spark):
    rows = [("세계경제", "세계 경제", 2), ("세계경제", "세계경제", 1), ("세계시장", "세계 시장", 1), ("세계시장", "세계시장", 3), ("국제경제", "국제 경제", 1), ("국제경제", "국제경제", 1)]
    clusters = spark.createDataFrame(rows, "key string, variant string, n long")
    chosen = spark.createDataFrame([("세계경제", "세계 경제"), ("세계시장", "세계 시장"), ("국제경제", "국제경제")], "key string, chosen string")
    got = {tuple(r) for r in patterns.candidates(clusters, chosen).collect()}
    assert got == {("prefix", "세계", "spaced", 2, 7, 27)}
    assert patterns.candidates(clusters.limit(0), chosen).collect() == []


def test_every_rule_on_every_form(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("가나다") for _ in range(rng.randrange(1, 6)))
    forms = {" ".join(word() for _ in range(rng.randrange(1, 4))): rng.randrange(1, 5) for _ in range(150)} | {"가나12": 1, "": 1}
    rules = {(kind, word()): rng.choice(["glued", "spaced"]) for _ in range(12) for kind in ("prefix", "suffix")}
    expected = set()
    for form, n in forms.items():
        parts = form.split()
        for (kind, affix), direction in rules.items():
            if len(parts) == 2 and parts[0 if kind == "prefix" else 1] == affix:
                rest, spaced = parts[1 if kind == "prefix" else 0], True
            elif len(parts) == 1 and (form.startswith(affix) if kind == "prefix" else form.endswith(affix)):
                rest, spaced = form[len(affix) :] if kind == "prefix" else form[: len(form) - len(affix)], False
            else:
                continue
            if sum("가" <= c <= "힣" for c in rest) >= 2:
                key = "".join(parts)
                other = key if spaced else f"{affix} {rest}" if kind == "prefix" else f"{rest} {affix}"
                expected.add((kind, affix, key, form, n, spaced == (direction == "spaced"), other))
    index = spark.createDataFrame(list(forms.items()), "variant string, n long").repartition(3)
    table = spark.createDataFrame([(*r, d, 1) for r, d in rules.items()], "affix_type string, affix string, direction string, keys long")
    assert {tuple(r) for r in patterns.forms(index, table).collect()} == expected
    skip = index.select(F.lit("가나다가").alias("key"))
    assert {tuple(r) for r in patterns.mismatches(index, table, skip).select("affix_type", "affix", "key", "form", "n", "other").collect()} == {(*e[:5], e[6]) for e in expected if not e[5] and e[2] != "가나다가"}
    assert patterns.forms(index, table.limit(0)).collect() == [] and patterns.forms(index.limit(0), table).collect() == []
