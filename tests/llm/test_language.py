"""Cross-parsing against plain substring search, and accuracy on documents held out."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import language
from pagemill.llm import queries as q

SF = "/root/testdata/sf0.01"


def plain_phrases(stretch: bytes, reference: bytes) -> int:
    at = n = 0
    while at < len(stretch):
        size = 0
        while at + size < len(stretch) and stretch[at : at + size + 1] in reference:
            size += 1
        at, n = at + max(1, size), n + 1
    return n


def plain(model_texts, text):
    """(language, score) by searching each phrase in the pieces, joined as the model joins them."""
    t = language.fold(text)
    if not t or not model_texts:
        return "und", 0.0
    import math

    bits = {}
    for lang, pieces in model_texts.items():
        reference = b"\0".join(pieces)
        bits[lang] = math.log2(1 + len(reference)) * sum(plain_phrases(t[a : a + language.STRETCH], reference) for a in range(0, len(t), language.STRETCH))
    order = sorted(bits.values())
    return min(bits, key=lambda x: (bits[x], x)), 1 - order[0] / order[1] if len(order) > 1 else 1.0


TEXTS = {
    "en": [language.fold("The quick brown fox jumps over the lazy dog"), language.fold("and then there were none of them left")],
    "de": [language.fold("Der schnelle braune Fuchs springt über den faulen Hund"), language.fold("und dann war keiner mehr übrig")],
    "el": [language.fold("Η γρήγορη καφέ αλεπού πηδάει πάνω από τον τεμπέλη σκύλο")],
}
ODD = [None, "", "   ", "123 !? ½ 4_5", "x", "über", "ÜBER", "über", "the dog und der Hund", "漢字", "σκύλος", "the " * 2000, "fox\u0000fox", "a" * 3000, "🙂", "ª"]


@pytest.mark.parametrize("langs", [[], ["de"], ["de", "en"], ["de", "el", "en"]])
def test_equals_plain_parsing(langs, monkeypatch):
    monkeypatch.setattr(language, "LANES", 7)
    texts = {x: TEXTS[x] for x in langs}
    rng = random.Random(1)
    asked = ODD + ["".join(rng.choice(["the ", "und ", "fox", "Hund", "ü", "π", "7", " ", "ö"]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    names, scores = language.Model.of(texts).identify(asked)
    for text, name, score in zip(asked, names, scores, strict=True):
        expected = plain(texts, text)
        assert (name, score) == (expected[0], pytest.approx(expected[1])), text


def test_automaton_holds_all_substrings():
    rng = random.Random(2)
    for _ in range(30):
        text = bytes(rng.choice(b"abc") for _ in range(40))
        edges = language.automaton(text)
        for _ in range(200):
            asked, s = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 7))), 0
            for b in asked:
                s = edges[s].get(b) if s is not None else None
            assert (s is not None) == (asked in text)


def test_odd_tables(spark):
    rows = [(k, t, None if k % 4 == 0 else "xx" if k % 2 else "de", "mine") for k, t in enumerate([*ODD, "Der Hund und die Katze"])] + [(None, "der Hund", "de", "mine"), (3, "der Hund", "de", "mine"), (3, "der Hund", "de", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumn("h", F.lit(1)).withColumn("piece", F.lit(1))
    out = language.identify(docs, F.lit(True)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.text in (None, "", "   ", "🙂", "123 !? ½ 4_5")} == {"und"}
    assert {r.lang_pred for r in out if r.text == "der Hund"} == {"de"}
    assert language.identify(docs.limit(0), F.lit(True)).collect() == []
    assert {r.lang_pred for r in language.identify(docs, F.lit(False)).collect()} == {"und"}


def test_many_languages_share_the_pieces(spark):
    docs = spark.createDataFrame([(k, f"wort{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} " * 99, f"l{k}") for k in range(100)], "doc_id long, text string, lang string")
    model = language.fit(docs, pieces=50, all_pieces=200)
    assert len(model.langs) == 100 and model.identify(["wortck wortck"])[0] == ["l2"]


def test_held_out_documents(spark):
    out = q.op12_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    held = out.where("held_out").collect()
    right = [r.lang == r.lang_pred for r in held]
    assert len(held) > 250 and sum(right) / len(right) > 0.97
