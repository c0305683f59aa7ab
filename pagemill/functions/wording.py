"""Word forms as Column expressions: particles, affixes, punctuation, and words that are no part of a compound.

Letters are a character class, Hangul by default, and every list is a parameter, so other scripts and longer harvested
lists can be given. A null word gives null from the functions on text, and false or null from the predicates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeezed

HANGUL_CLASS = "가-힣"
QUOTES = "['`´‘’“”„«»「」『』]"

# Particles at a word's end, in the order in which they are tried.
PARTICLES = (
    "에서부터", "에게서", "으로부터", "으로서", "으로써", "에서는", "에서도", "에서", "에도", "에게", "한테", "으로", "로서", "로써", "부터", "까지",
    "처럼", "만큼", "보다", "대로", "이라고", "이라서", "이라면", "이라도", "입니다", "입니까", "이었다", "이나", "이란", "이라", "이기", "이다",
    "인지", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "만", "나", "란", "로",
    "요", "께", "들",
)
AMBIGUOUS = ("가", "이")

# Particles that mark a left word, by the least number of syllables before them, and those that stand alone.
LEFT_PARTICLES = {1: ("에", "에서", "에게", "으로", "이든", "이라면", "이라도", "이나", "라도", "만이", "이", "가", "을", "를", "도", "만"), 2: ("의", "와", "과", "나", "라면", "로", "든")}
LEFT_ALL = ("에서", "에게", "으로", "이라면", "이라도", "이나", "이든", "든", "만이", "라면", "라도", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "만", "나", "로")
ALONE = ("이든", "라도", "이라도", "이나", "이라면", "라면", "만이")
TOPICS, PRONOUNS = ("은", "는"), ("나", "너", "저", "그", "이")
# Adnominal and connective tails, by the least number of syllables before them.
ADNOMINAL = {1: ("적인", "스런", "던", "는", "은", "된", "쓴"), 2: ("진", "한", "운", "낸", "난", "인", "린", "른", "온", "픈", "싼")}
CONNECTIVE = {1: ("았고", "었고", "였고", "으면서", "면서", "으면", "으며", "았다", "었다", "였다", "렸다", "랐다", "왔다", "댔다", "는다", "든다", "겠다", "는데", "을까", "일까"), 2: ("면", "며", "고", "자")}
# Words that are noise as they stand, and words that only look like it.
CONJUNCTIONS = (
    "그리고", "또", "또한", "아울러", "더불어", "게다가", "그러나", "하지만", "그렇지만", "그런데", "반면", "반면에", "오히려", "도리어", "그래서", "그래도",
    "그러므로", "따라서", "그러니까", "그러니", "왜냐하면", "그러면", "그렇다면", "그럼", "설령", "설사", "가령", "아니면", "한편", "다음으로", "아무튼", "어쨌든",
    "여하튼", "하여튼", "더구나", "뿐만", "특히", "다만", "단", "결국", "요컨대", "즉", "말하자면", "이어서", "그다음", "이후", "먼저", "우선",
)
VERBALS = ("없다", "있다", "아니다", "된다", "같다")
NO_ADNOMINAL, NO_ADVERB = ("남북한",), ("가게", "집게")


def letter_count(c: Column, letters: str = HANGUL_CLASS) -> Column:
    return F.regexp_count(c, F.lit(f"[{letters}]"))


def only_letters(c: Column, letters: str = HANGUL_CLASS) -> Column:
    return F.regexp_replace(c, f"[^{letters}]", "")


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def _words(c: Column) -> Column:
    return F.filter(F.split(squeezed(c), " "), lambda w: w != "")


def stripped(c: Column, suffixes=PARTICLES, least: int = 2, letters: str = HANGUL_CLASS, ambiguous=AMBIGUOUS, ambiguous_size: int = 4) -> Column:
    """The text without the first of the suffixes that ends its last word and leaves so many letters of it.

    An ambiguous suffix stays on a word of the ambiguous size, where it may belong to the stem.
    """
    text = squeezed(c)
    last = F.substring_index(text, " ", -1)

    def fits(s: Column) -> Column:
        stem = F.substr(last, F.lit(1), F.length(last) - F.length(s))
        unsure = s.isin(*ambiguous) & (letter_count(last, letters) == ambiguous_size) if ambiguous else F.lit(False)
        return F.endswith(last, s) & (F.length(last) > F.length(s)) & (letter_count(stem, letters) >= least) & ~unsure

    found = F.get(F.filter(_list(suffixes), fits), F.lit(0))
    return F.when(found.isNull(), text).otherwise(F.substr(text, F.lit(1), F.length(text) - F.length(found)))


def stems(c: Column, suffixes=PARTICLES, least: int = 2) -> Column:
    """A word and what is left of it without each suffix that ends it, distinct, the word first."""
    fits = F.filter(_list(suffixes), lambda s: F.endswith(c, s) & (F.length(c) - F.length(s) >= least))
    return F.array_distinct(F.concat(F.array(c), F.transform(fits, lambda s: F.substr(c, F.lit(1), F.length(c) - F.length(s)))))


def without_marks(c: Column, letters: str = HANGUL_CLASS) -> Column:
    """Words without quotes, and without other marks at their ends; words of marks alone go."""
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, QUOTES, ""), rf"^[^{letters}0-9]+|[^{letters}0-9]+$", "")
    return F.array_join(F.filter(F.transform(_words(c), bare), lambda w: w != ""), " ")


def without_edge_digits(c: Column, least: int = 2, letters: str = HANGUL_CLASS) -> Column:
    """Without numbers as first or last words, and without digits before or after so many letters of a word."""
    text = F.regexp_replace(F.regexp_replace(squeezed(c), r"^([0-9]+( |$))+", ""), r"(( |^)[0-9]+)+$", "")

    def bare(w: Column) -> Column:
        after = F.regexp_extract(w, rf"^[0-9]+([{letters}].*)$", 1)
        before = F.regexp_extract(w, rf"^([{letters}].*?)[0-9]+$", 1)
        return F.when(letter_count(after, letters) >= least, after).when(letter_count(before, letters) >= least, before).otherwise(w)

    return F.array_join(F.transform(_words(text), bare), " ")


def bare_form(c: Column, least: int = 2) -> Column:
    """A Hangul form without marks, end particle and the ending 기, where enough of a noun is left before it."""
    once = stripped(without_marks(c), least=least)
    last = F.substring_index(once, " ", -1)
    size = letter_count(last)
    several = F.instr(once, " ") > 0
    goes = F.endswith(last, F.lit("기")) & F.when(several, size == 3).otherwise(size >= 5)
    return F.when(goes, stripped(F.substr(once, F.lit(1), F.length(once) - 1), least=least)).otherwise(once)


def spacing_key(c: Column, letters: str = HANGUL_CLASS) -> Column:
    return F.regexp_replace(without_marks(c, letters), " ", "")


def is_spaced_form(c: Column, least: int = 2, letters: str = HANGUL_CLASS) -> Column:
    """Whether a form has several words, each of so many letters."""
    words = _words(c)
    return (F.size(words) >= 2) & F.forall(words, lambda w: letter_count(w, letters) >= least)


def has_bare_particle(c: Column, particles=PARTICLES) -> Column:
    return F.arrays_overlap(_words(c), _list(particles))


def is_excluded_form(c: Column, letters: str = HANGUL_CLASS, particles=PARTICLES) -> Column:
    """Whether a found form has marks between letters, a comma inside, a particle as a word, or nothing left."""
    inner = c.rlike(rf"[{letters}]\s*[^{letters}0-9\s]+\s*[{letters}]")
    plain = F.trim(F.regexp_replace(c, rf"[^{letters}0-9\s]+$", ""))
    return inner | plain.contains(",") | (squeezed(plain) == "") | (plain.rlike(r"\s") & has_bare_particle(plain, particles))


def has_tail(word: Column, tails: dict[int, list[str]]) -> Column:
    """Whether a word ends with a tail after so many characters at least."""
    rows = F.array(*[F.struct(F.lit(t).alias("tail"), F.lit(n).alias("least")) for n, ts in tails.items() for t in ts])
    return F.exists(rows, lambda r: F.endswith(word, r["tail"]) & (F.length(word) - F.length(r["tail"]) >= r["least"]))


def is_left_particle_word(c: Column, exceptions=()) -> Column:
    """A word with a particle that marks it as a word of its own, or such a particle alone."""
    h = only_letters(c)
    topic = F.exists(_list(TOPICS), lambda t: F.endswith(h, t)) & F.substr(h, F.lit(1), F.length(h) - 1).isin(*PRONOUNS) & (F.length(h) == 2)
    out = h.isin(*ALONE) | has_tail(h, LEFT_PARTICLES) | topic
    if exceptions:
        known = F.exists(_list(LEFT_ALL), lambda t: F.endswith(h, t) & F.array_contains(_list(exceptions), F.substr(h, F.lit(1), F.length(h) - F.length(t))))
        out = out | known
    return out


def noise_kind(c: Column, exceptions=(), tails: dict[int, list[str]] | None = None) -> Column:
    """Why a word is no part of a compound, or null: the first of the kinds that fits. tails are harvested ones, if any."""
    h = only_letters(c)
    long = F.length(h) >= 2
    kinds = F.when(h == "", None).when(h.isin(*CONJUNCTIONS), "conjunction").when(h.isin(*VERBALS), "verbal")
    if exceptions:
        kinds = kinds.when(h.isin(*exceptions), "listed")
    kinds = kinds.when(is_left_particle_word(c, exceptions), "particle")
    kinds = kinds.when(~h.isin(*NO_ADNOMINAL) & has_tail(h, ADNOMINAL), "adnominal").when(has_tail(h, CONNECTIVE), "connective")
    kinds = kinds.when(long & F.endswith(h, F.lit("히")), "adverb").when(long & F.endswith(h, F.lit("게")) & ~h.isin(*NO_ADVERB), "adverb")
    kinds = kinds.when((F.length(h) >= 3) & F.endswith(h, F.lit("짜리")), "suffix")
    return kinds.when(has_tail(h, tails), "tail") if tails else kinds


def has_noise_word(form: Column, exceptions=(), tails: dict[int, list[str]] | None = None) -> Column:
    """Whether any word of a spaced form is noise."""
    words = _words(form)
    return (F.size(words) >= 2) & F.exists(words, lambda w: noise_kind(w, exceptions, tails).isNotNull())


def affixes(word: Column, least: int = 2, end: bool = False) -> Column:
    """A word and its beginnings (or ends), longest first, down to so many characters; none of a number."""
    sizes = F.when((F.length(word) >= least) & ~word.rlike("^[0-9]+$"), F.sequence(F.length(word), F.lit(least), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(sizes, lambda n: F.substr(word, F.length(word) - n + 1 if end else F.lit(1), n))
