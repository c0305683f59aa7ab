"""Near spellings against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import orthography


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("radius", [1, 2])
def test_all_near_pairs(spark, radius):
    rng = random.Random(radius)
    forms = {"".join(rng.choice("abé") for _ in range(rng.randrange(6))) for _ in range(120)} | {"카디건", "가디건", "카디간", ""}
    df = spark.createDataFrame([(f, 1) for f in sorted(forms)] + [(None, 1), ("", 2)], "form string, rest int").repartition(3)
    got = {(r.a, r.b, r.distance) for r in orthography.near_forms(df, radius).collect()}
    assert got == {(a, b, distance(a, b)) for a in forms for b in forms if a < b and distance(a, b) <= radius}
    assert orthography.near_forms(df.limit(0), radius).collect() == []


def test_spellings_behind_a_foreign_word(spark):
    rows = [("카디건", "cardigan", 3), ("가디건", "Cardigan", 2), ("카디간", "card igan", 1), ("조끼", "cardigan", 1), ("솔루션", "solution", 2), ("설루션", "2nd", 1), (None, "x", 1), ("아", "a", 1)]
    pairs = spark.createDataFrame(rows, "head string, inner string, n long").withColumn("form", F.lit("mine"))
    got = {tuple(r) for r in orthography.anchored(pairs).collect()}
    assert got == {("cardigan", "카디건", 3, "카디건", 0), ("cardigan", "가디건", 2, "카디건", 1), ("cardigan", "카디간", 1, "카디건", 1)}
