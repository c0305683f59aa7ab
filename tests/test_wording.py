"""Word forms in Hangul, scalar labels and placed items on small frames."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as fn
from pagemill.functions import wording as w
from pagemill.operators import layout


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, stem",
    [("경기 침체에서", "경기 침체"), ("가치평가", "가치평가"), ("금융위기에서부터", "금융위기"), ("사과", "사과"), ("사람들", "사람"), ("정부가", "정부"), ("", ""), (None, None), ("  주식   시장은 ", "주식 시장")],
)
def test_particles(spark, text, stem):
    assert value(spark, w.stripped(F.lit(text).cast("string"))) == stem


@pytest.mark.parametrize("text, form", [("경기 침체기", "경기 침체"), ("금융위기", "금융위기"), ("경기침체기", "경기침체"), ("‘경제왕국’이기>", "경제왕국")])
def test_bare_form(spark, text, form):
    assert value(spark, w.bare_form(F.lit(text))) == form


def test_marks_and_digits(spark):
    assert value(spark, w.without_marks(F.lit("뉴욕타임스> '경제왕국’이기 ... 1차,"))) == "뉴욕타임스 경제왕국이기 1차"
    assert [value(spark, w.without_edge_digits(F.lit(t))) for t in ("174 노동 시장", "174노동시장", "2024년", "코로나19", "12 34", "")] == ["노동 시장", "노동시장", "2024년", "코로나", "", ""]
    assert value(spark, w.spacing_key(F.lit("금융 위기!"))) == "금융위기"


@pytest.mark.parametrize("text, ok", [("금융 위기", True), ("제1차 세계대전", True), ("있 다", False), ("1차 세계", False), ("2024 년도", False), ("금융위기", False)])
def test_spaced_forms(spark, text, ok):
    assert value(spark, w.is_spaced_form(F.lit(text))) is ok


@pytest.mark.parametrize("text, out", [("개인, 은행", True), ("경기 에서", True), ("경제다!라", True), ("경제학·철학", True), ("경제왕국의", False), ("개인 소득", False), ("경제학상", False), ("!!", True)])
def test_excluded_forms(spark, text, out):
    assert value(spark, w.is_excluded_form(F.lit(text))) is out


@pytest.mark.parametrize(
    "word, kind",
    [("그리고", "conjunction"), ("없다", "verbal"), ("기업에서", "particle"), ("이든", "particle"), ("나는", "particle"), ("사과", None), ("남북한", None), ("아름다운", "adnominal"), ("기운", None), ("낮았고", "connective"), ("투자", None), ("꾸준히", "adverb"), ("가게", None), ("쉽게", "adverb"), ("년짜리", "suffix"), ("주식", None), ("", None), (None, None), ("abc", None)],
)
def test_noise_words(spark, word, kind):
    assert value(spark, w.noise_kind(F.lit(word).cast("string"))) == kind


def test_noise_forms(spark):
    got = [value(spark, w.has_noise_word(F.lit(t))) for t in ("캐나다 정부", "주식 시장", "결국 정부", "주식")]
    assert got == [False, False, True, False]
    assert value(spark, w.noise_kind(F.lit("대부분"), ["대부분"])) == "listed" and value(spark, w.noise_kind(F.lit("대부분의"), ["대부분"])) == "particle"
    assert value(spark, w.noise_kind(F.lit("살펴보니"), (), {1: ["보니"]})) == "tail"


def test_stems_and_affixes(spark):
    assert value(spark, w.stems(F.lit("정부에서는"))) == ["정부에서는", "정부", "정부에서"]
    assert value(spark, w.affixes(F.lit("금융위기"))) == ["금융위기", "금융위", "금융"] and value(spark, w.affixes(F.lit("금융위기"), end=True)) == ["금융위기", "융위기", "위기"]
    assert value(spark, w.affixes(F.lit("2024"))) == [] and value(spark, w.affixes(F.lit("금"))) == []


def test_labels(spark):
    assert [value(spark, fn.file_size(F.lit(n))) for n in (0, 1023, 1024, 1280, 5 << 20, -1)] == ["0B", "1023B", "1.0KB", "1.3KB", "5.0MB", None]
    assert [value(spark, fn.finding_bucket(F.lit(n).cast("int"))) for n in (0, 20, 21, 501, None)] == ["0", "1-20", "21-100", "501+", None]
    assert [value(spark, fn.page_range(F.lit(t))) for t in ("P.6-7", "6P", " 8 – 9 ", "0", "0-3", "x", "")] == [(6, 7), (6, 6), (8, 9), None, None, None, None]
    assert [value(spark, fn.toc_page(F.lit(t))) for t in ("제1장 서론 …… １５", "서론15", "서론 0", "│ 서론 │ 7")] == [15, None, None, 7]
    assert value(spark, fn.toc_title(F.lit("│제1장 서론 …… １５"))) == "제1장 서론"
    assert value(spark, fn.comma_list(F.lit("가, 나，\n 다,"))) == ["가", "나", "다"] and value(spark, fn.enabled(F.lit(" Yes "))) is True


def test_layout(spark):
    rows = [(1, 0, "세계", 30.0, 100.0, 10.0), (1, 1, "제1차 ", 10.0, 102.0, 12.0), (1, 2, "세계", 30.4, 100.3, 10.0), (1, 3, "아래", 10.0, 50.0, 10.0), (1, 4, " ", 10.0, 20.0, 10.0), (2, 0, "", 0.0, 0.0, 1.0)]
    items = spark.createDataFrame(rows, "page long, item_idx long, str string, x double, y double, size double").repartition(4)
    clean = layout.without_overlays(items)
    assert sorted(r.item_idx for r in clean.collect()) == [0, 1, 3, 4]
    assert [(r.y, r.text, r.max_size, r.min_x) for r in layout.physical_lines(clean).orderBy(F.desc("y")).collect()] == [(100.0, "제1차 세계", 12.0, 10.0), (50.0, "아래", 10.0, 10.0)]
    assert [tuple(r) for r in layout.widest_gap(clean, 0, 100).collect()] == [(1, 20.0, 20.0)]
    assert layout.physical_lines(items.where("false")).count() == 0
