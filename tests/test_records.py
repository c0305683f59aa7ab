"""Rule sheets, spellings, loanwords and records on small frames, most of them Hangul, which the harness tables lack."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import spelling
from pagemill.operators import clusters, loanwords, records, rulebook


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_sheet_file(spark, tmp_path):
    (tmp_path / "rules.csv").write_text(' Find ,replace,finds\n"a,""b""",x,\n,,\n"two\nlines",y,"p, q"\n', encoding="utf-8")
    rows = rulebook.rule_rows(rulebook.sheet(spark, str(tmp_path / "rules.csv"))).collect()
    assert sorted((r.find, r.replace, r.finds) for r in rows) == [('a,"b"', "x", None), ("two\nlines", "y", ["two\nlines", "p", "q"])]


def test_modes_and_patterns(spark):
    modes = [rulebook.match_mode(F.lit(x)) for x in (" Space-Stem", "space", "붙임", "fixedphrase", None)]
    assert one(spark, *modes) == ("stem-list", "spaced-before", "attached-before", "fixed-phrase", "any-before")
    hit = lambda text, label, mode: F.regexp_like(F.lit(text), rulebook.item_pattern(F.lit(label), F.lit(mode)))
    assert one(spark, hit("여름가지", "가지", "attached-before"), hit("물가지수", "가지", "attached-before"), hit("앞말 이중", "이중", "spaced-before"), hit("이중", "이중", "spaced-before")) == (True, False, True, False)


def test_a_skipped_rule_claims_nothing(spark):
    rows = spark.createDataFrame([("s", 1, ["a"]), ("s", 2, ["a", "b"]), ("s", 3, ["b"]), ("t", 1, ["a"])], "sheet string, ord long, forms array<string>")
    got = rulebook.first_wins(rows, "sheet", "ord").orderBy("sheet", "ord").collect()
    assert [(r.sheet, r.ord, r.kept, r.clash) for r in got] == [("s", 1, True, None), ("s", 2, False, "a"), ("s", 3, True, None), ("t", 1, True, None)]


def test_first_rules_win_one_by_one(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["s", "t", None]), rng.randrange(12), [rng.choice("abcdefgh") for _ in range(rng.randrange(4))] if rng.random() < 0.9 else None) for _ in range(60)] + [("s", 99, [None, "a"])]
    expected = []
    for sheet in ("s", "t", None):
        seen = set()
        for o, f in sorted(((o, f) for s, o, f in rows if s == sheet), key=lambda x: (x[0], x[1] is not None, [(v is not None, v or "") for v in x[1] or []])):
            clash = next((x for x in f or [] if x is not None and x in seen), None)
            expected.append((str(sheet), o, clash is None, str(clash)))
            seen |= set() if clash else {x for x in f or [] if x is not None}
    got = rulebook.first_wins(spark.createDataFrame(rows, "sheet string, ord long, forms array<string>").repartition(3), "sheet", "ord").collect()
    assert sorted((str(r.sheet), r.ord, r.kept, str(r.clash)) for r in got) == sorted(expected)


def test_slots_and_pins(spark):
    assert one(spark, rulebook.slot_pattern(F.lit("@ 시대")), rulebook.slot_pattern(F.lit("@ 1")), rulebook.phrase_pattern(F.lit(" a.b  c "))) == ("[^\\s\\x{FFFD}]+[ \\x{A0}]+시대", None, "a\\.b[ \\x{A0}]+c")
    rules = spark.createDataFrame([("가˅나", True, False, None), ("가나", True, True, "x"), ("z", False, False, "k")], "tail string, unify boolean, pinned boolean, overlay string")
    once = rulebook.pinned(rules, "가 나")
    assert sorted((r.tail, r.pinned, r.overlay) for r in once.collect()) == [("z", False, "k"), ("가˅나", True, None), ("가나", False, "가 나")]
    assert sorted((r.tail, r.pinned, r.overlay) for r in rulebook.pinned(once, "가 나").collect()) == [("z", False, "k"), ("가˅나", False, None), ("가나", False, None)]
    assert rulebook.pinned(rules, " ").collect() == rules.collect()


def test_spellings(spark):
    v = lambda a, b: spelling.is_spelling_variant(F.lit(a), F.lit(b))
    assert one(spark, v("가디건", "거디건"), v("가디건", "카디건"), v("가디건", "가디건"), v("가디", "가디건"), v("자식", "지식"), v("", "")) == (True, False, True, False, False, False)
    assert one(spark, spelling.onset(F.lit("까치")), spelling.onset(F.lit("abc")), spelling.syllable_differences(F.lit("가나"), F.lit("가다라"))) == ("ㄲ", "", ["나↔다", "len:2↔3"])
    assert one(spark, spelling.with_marks(F.lit("a b c�")), spelling.variant_form(F.lit("˅a˅˅b ")), spelling.slot_text(F.lit("� 경제  "))) == ("a˅b˅c˅", "a b", "경제")
    assert one(spark, spelling.is_latin_key(spelling.latin_key(F.lit(" Solution "))), spelling.is_latin_key(F.lit("say no")), spelling.is_latin_key(F.lit("abc"))) == (True, False, False)


@pytest.mark.parametrize("most", [100, 0])
def test_places_of_a_form_follow_one_another(spark, most):
    forms = ["thed the", "hed thed th", "aa aa", "word"]
    texts = ["nthed thed thed thed the", "thed thed thed\nthed thed the", "aa aa aa aa\naa", "word aaa aa aa aaword", "xhed thed thed thed thed"]
    expected = set()
    for k, t in enumerate(texts):
        found = []
        for f in forms:
            at = t.find(f)
            while at >= 0:
                if not at or not t[at - 1].isalnum():
                    found.append((-len(f), at, f))
                at = t.find(f, at + len(f))
        taken = []
        for n, at, f in sorted(found):
            if all(at - n <= a or b <= at for a, b in taken):
                taken.append((at, at - n))
                expected.add((k, at, f))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = loanwords.matches(docs, spark.createDataFrame([(f,) for f in forms], "typo string"), most=most)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected) and (0, 11, "thed the") in expected


def test_loanwords(spark):
    docs = spark.createDataFrame([(1, "겨울엔 가디건을 입는다"), (2, "아지로 마을에 갔다"), (3, "제트더블유\n형 제트더블유 형"), (4, None), (5, "")], "doc_id long, text string")
    typos = spark.createDataFrame([("가디건",), ("지로",), ("제트더블유 형",), ("제트",), ("",)], "typo string")
    assert sorted((r.doc_id, r.start, r.typo) for r in loanwords.matches(docs, typos).collect()) == [(1, 4, "가디건"), (3, 0, "제트"), (3, 8, "제트더블유 형")]
    as_rows = lambda df: sorted((r.doc_id, r.start, r.typo) for r in df.collect())
    assert as_rows(loanwords.matches(docs, typos, most=0)) == as_rows(loanwords.matches(docs, typos))
    assert as_rows(loanwords.matches(docs, typos, excluded=["가디건"])) == [(3, 0, "제트"), (3, 8, "제트더블유 형")]
    assert loanwords.matches(docs, typos.limit(0)).count() == 0
    assert one(spark, loanwords.suggestion(F.array(F.lit("솔루션"), F.lit(""), F.lit("설루션"))), loanwords.bundle(F.lit("지로")), loanwords.bundle(F.lit("가디건"))) == ("솔루션 또는 설루션", "short", "main")
    assert one(spark, loanwords.tip(F.array(F.lit("카디건")), F.lit(" cardigan "))) == ("cardigan — 국어원 용례집 등재 표기는 '카디건'",)


def test_entries(spark):
    entries = spark.createDataFrame([(1, "킹, 마틴", ["마틴 킹"], ["칭"]), (2, "칭", None, None)], "ord long, head string, alternates array<string>, misspellings array<string>")
    words = spark.createDataFrame([("칭",), ("마틴킹",), ("킹",), ("없음",)], "word string")
    assert sorted(tuple(r) for r in loanwords.best_entries(words, entries, loanwords.PART).collect()) == [("마틴킹", "킹, 마틴", 80), ("칭", "칭", 100), ("킹", "킹, 마틴", 50)]
    assert sorted(tuple(r) for r in loanwords.kinds(words, entries).collect()) == [("마틴킹", "alt"), ("없음", "other"), ("칭", "exact"), ("킹", "other")]


def test_clusters(spark):
    m = lambda v: clusters.is_mono_slot(F.lit(v))
    assert one(spark, m("금융 업"), m("기술 58"), m("가 시장"), m("금융 시장"), m("금융시장")) == (True, True, True, False, False)
    w = lambda k, a: clusters.is_weak_filler(F.lit(k), F.lit(a))
    assert one(spark, w("시장가", "시장"), w("시장조사", "시장"), w("시장", "시장"), clusters.is_weak_affix(F.lit("시")), clusters.is_weak_affix(F.lit("시장"))) == (True, False, False, True, False)


def test_nearest_place_overlapping(spark):
    near = lambda t, p, at: records.nearest_place(F.lit(t), F.lit(p), F.lit(at))
    assert one(spark, near("aaaa", "aa", 1), near("aaaa", "aa", 9), near("xaxa", "a", 2), near("x", "a", 0), near("a.b+", ".b", -3)) == (1, 2, 1, None, 1)


def test_free_names(spark):
    used = spark.createDataFrame([("a(1)",), ("a(2)",), ("a(4)",), ("b",)], "name string")
    wanted = spark.createDataFrame([("a",), ("a(2)",), ("b",)], "name string")
    assert sorted(tuple(r) for r in records.free_names(wanted, used).collect()) == [("a", "a(3)"), ("a(2)", "a(3)"), ("b", "b(1)")]
