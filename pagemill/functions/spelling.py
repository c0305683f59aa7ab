"""Spellings as Column expressions: visible blanks, broken glyphs, keys of Latin words, and Hangul forms that differ in a vowel. Texts are taken to be composed (NFC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HANGUL, jamo_distance, squeezed

# The mark of a blank, the sign of a glyph that could not be read, and the no-break space.
MARK, BROKEN, NO_BREAK = "˅", "�", " "
# Onset consonants in code point order, and vowels that are taken for another (by their place in the block).
ONSETS = ("ㄱ", "ㄲ", "ㄴ", "ㄷ", "ㄸ", "ㄹ", "ㅁ", "ㅂ", "ㅃ", "ㅅ", "ㅆ", "ㅇ", "ㅈ", "ㅉ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ")
VOWELS = ("ㅏ", "ㅐ", "ㅑ", "ㅒ", "ㅓ", "ㅔ", "ㅕ", "ㅖ", "ㅗ", "ㅘ", "ㅙ", "ㅚ", "ㅛ", "ㅜ", "ㅝ", "ㅞ", "ㅟ", "ㅠ", "ㅡ", "ㅢ", "ㅣ")
TAKEN_FOR = {"ㅏ": ("ㅓ", "ㅑ"), "ㅓ": ("ㅏ", "ㅕ"), "ㅐ": ("ㅔ",), "ㅔ": ("ㅐ",), "ㅗ": ("ㅘ", "ㅜ"), "ㅘ": ("ㅗ",), "ㅜ": ("ㅝ", "ㅗ"), "ㅝ": ("ㅜ",), "ㅡ": ("ㅜ",)}
#: Least letters of a Latin key.
LEAST_LATIN = 4


def readable(c: Column) -> Column:
    """Unreadable glyphs as blanks; offsets stay."""
    return F.translate(F.coalesce(c, F.lit("")), BROKEN, " ")


def with_marks(c: Column) -> Column:
    return F.translate(readable(c), " " + NO_BREAK, MARK * 2)


def without_space_marks(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), MARK, " ")


def slot_text(c: Column) -> Column:
    """What fills a slot, without blanks or unreadable glyphs at its ends."""
    return F.regexp_replace(readable(c), r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")


def variant_form(c: Column) -> Column:
    return squeezed(without_space_marks(c))


def distinct_forms(forms: Column) -> Column:
    """The forms of a list in their order, each once, blank ones not."""
    return F.array_distinct(F.filter(F.transform(forms, variant_form), lambda x: x != ""))


def latin_key(c: Column) -> Column:
    return F.lower(squeezed(c))


def is_latin_key(key: Column, least: int = LEAST_LATIN) -> Column:
    """Whether a key is one word of so many Latin letters."""
    k = F.trim(key)
    return ~k.rlike(r"\s") & (F.regexp_count(k, F.lit("[A-Za-z]")) >= least)


def _place(ch: Column) -> Column:
    return F.ascii(ch) - HANGUL


def onset(c: Column) -> Column:
    """The first syllable's consonant; empty if the text begins otherwise."""
    k = _place(F.substr(c, F.lit(1), F.lit(1)))
    return F.when((k >= 0) & (k < 11172), F.element_at(F.array(*[F.lit(x) for x in ONSETS]), F.floor(k / 588).cast("int") + 1)).otherwise("")


def _pairs(a: Column, b: Column) -> Column:
    both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.filter(both, lambda p: p["x"] != p["y"])


def syllable_differences(a: Column, b: Column) -> Column:
    """Characters that differ at equal places, and the lengths if they differ."""
    places = F.transform(_pairs(a, b), lambda p: F.concat(p["x"], F.lit("↔"), p["y"]))
    sizes = F.concat(F.lit("len:"), F.length(a).cast("string"), F.lit("↔"), F.length(b).cast("string"))
    return F.when(F.length(a) == F.length(b), places).otherwise(F.array_append(places, sizes))


def _taken_for(x: Column, y: Column) -> Column:
    """Whether two syllables have equal consonants, and vowels of which one is taken for the other."""
    i, j = _place(x), _place(y)
    hangul = (i >= 0) & (i < 11172) & (j >= 0) & (j < 11172)
    vowel = lambda k: F.floor(k % 588 / 28).cast("int")
    listed = [F.lit(VOWELS.index(v) * 100 + VOWELS.index(w)) for v, ws in TAKEN_FOR.items() for w in ws]
    return hangul & (F.floor(i / 588) == F.floor(j / 588)) & (i % 28 == j % 28) & F.array_contains(F.array(*listed), vowel(i) * 100 + vowel(j))


def is_spelling_variant(a: Column, b: Column, most: int = 2) -> Column:
    """Whether two forms are equal, or of equal length with one syllable that differs in a vowel taken for the other, within a jamo distance."""
    d, differ = jamo_distance(a, b), _pairs(a, b)
    near = (F.length(a) == F.length(b)) & (onset(a) == onset(b)) & (d >= 1) & (d <= most) & (F.size(differ) <= 1) & F.forall(differ, lambda p: _taken_for(p["x"], p["y"]))
    return (a != "") & (b != "") & ((a == b) | near)
