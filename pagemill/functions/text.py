"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First code points of the Hangul syllable block and of its three jamo rows.
HANGUL, ONSET, VOWEL, CODA = 0xAC00, 0x1100, 0x1161, 0x11A7


# Leaders, page digits (full-width ones too) and bars of a table of contents.
FULLWIDTH = "０１２３４５６７８９"
LEADERS, PAGE_DIGITS, BARS = "[.…·\u2024-\u2027]", "[0-9０-９]{1,4}", "[│｜┃|]"
# Upper bounds of reporting buckets.
FINDINGS, RULES, PAGES, MEGABYTES = (0, 20, 100, 500), (0, 10, 30, 100), (50, 150, 300), (10, 30, 50)


def space_free(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\n\r\f 　]+", "")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f ]+", " "))


def toc_title(c: Column) -> Column:
    """A table-of-contents line without bars, its leaders and the page number after leaders or a blank."""
    plain = F.trim(F.regexp_replace(c, BARS, " "))
    for end in (rf"{LEADERS}+\s*{PAGE_DIGITS}\s*$", rf"{LEADERS}+\s*$", rf"\s+{PAGE_DIGITS}\s*$"):
        plain = F.regexp_replace(plain, end, "")
    return squeezed(plain)


def toc_page(c: Column) -> Column:
    """Page number at the end of a table-of-contents line, after leaders or a blank; null if there is none from 1 on."""
    digits = F.regexp_extract(c, rf"(?:{LEADERS}\s*|\s)({PAGE_DIGITS})\s*$", 1)
    n = F.nullif(F.translate(digits, FULLWIDTH, "0123456789"), F.lit("")).cast("int")
    return F.when(n >= 1, n)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length of the space-free lower-case forms; 0 if either is empty."""
    x, y = F.lower(space_free(a)), F.lower(space_free(b))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def jamo(c: Column) -> Column:
    """Hangul syllables as their jamo; other characters as they are."""

    def parts(ch: Column) -> Column:
        k = F.ascii(ch) - HANGUL
        letter = lambda base, n: F.decode(F.unhex(F.lpad(F.hex((F.lit(base) + n).cast("long")), 4, "0")), "UTF-16BE")
        onset, vowel = letter(ONSET, F.floor(k / 588)), letter(VOWEL, F.floor(k % 588 / 28))
        coda = F.when(k % 28 == 0, "").otherwise(letter(CODA, k % 28))
        return F.when((k >= 0) & (k < 11172), F.concat(onset, vowel, coda)).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), parts), "")


def jamo_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(jamo(a), jamo(b))


def kst_day(ts: Column) -> Column:
    """Day in Korea (UTC+9) of an instant, in a UTC session."""
    return F.date_format(ts + F.expr("interval 9 hours"), "yyyy-MM-dd")


def bucket(n: Column, bounds: tuple[int, ...]) -> Column:
    """Label of the range between two bounds that n falls into; null stays null. A first bound of 0 has a label of its own."""
    out, low = F.when(n.isNull(), F.lit(None).cast("string")), None
    for high in bounds:
        label = "0" if high == 0 else f"{1 if low is None else low + 1}-{high}"
        out, low = out.when(n <= high, label), high
    return out.otherwise(f"{low + 1}+")


def finding_bucket(n: Column) -> Column:
    return bucket(n, FINDINGS)


def rule_bucket(n: Column) -> Column:
    return bucket(n, RULES)


def page_bucket(n: Column) -> Column:
    return bucket(n, PAGES)


def megabyte_bucket(size: Column) -> Column:
    """Bucket of a size in bytes; the ranges share their bounds, as sizes are no whole numbers."""
    mb = size / (1 << 20)
    a, b, c = MEGABYTES
    return F.when(mb <= a, f"0-{a}").when(mb <= b, f"{a}-{b}").when(mb <= c, f"{b}-{c}").when(mb > c, f"{c}+")


def upload_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n >= 4, "4+").otherwise(n.cast("string"))


def file_size(size: Column) -> Column:
    """Bytes as B, KB or MB with one decimal, halves up; null below zero."""
    tenths = lambda unit: F.format_string("%.1f", F.floor(size / unit * 10 + 0.5) / 10)
    return F.when(size < 0, None).when(size < 1 << 10, F.concat(size.cast("string"), F.lit("B"))).when(size < 1 << 20, F.concat(tenths(1 << 10), F.lit("KB"))).otherwise(F.concat(tenths(1 << 20), F.lit("MB")))


def days_left(expires: Column, now: Column) -> Column:
    """Days until an instant, begun ones too; never below zero."""
    return F.greatest(F.lit(0), F.ceil((F.unix_micros(expires) - F.unix_micros(now)) / 86_400_000_000)).cast("long")


def comma_list(c: Column) -> Column:
    """Entries of a list with commas (full-width ones too) or line breaks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "[,，\n]"), lambda x: F.trim(x)), lambda x: x != "")


def enabled(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1", "yes", "y")


def page_range(c: Column) -> Column:
    """(first, last) of an entry such as "P.6-7", "6" or "6P"; null if it names no page from 1 on."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), "^[Pp]\\.", ""), "[Pp]$", "")
    span = r"^(\d{1,9})\s*[-–—]\s*(\d{1,9})$"
    number = lambda pattern, group: F.nullif(F.regexp_extract(plain, pattern, group), F.lit("")).cast("int")
    first, last = number(span, 1), number(span, 2)
    single = number(r"^\s*(\d{1,9})", 1)
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    return F.when(first.isNotNull(), F.when((first > 0) & (last > 0), pair(first, last))).when(single > 0, pair(single, single))


def spread_left(page: Column, first_single: bool = True) -> Column:
    """File page on the left of the spread that a file page belongs to."""
    return F.when(page <= 1, 1).otherwise(page - page % 2 if first_single else page - (page + 1) % 2)


def printed_left(page: Column, first_single: bool = True) -> Column:
    """Printed number of the left page of the spread that a file page shows."""
    return F.when(page <= 1, 1).otherwise((page - 1) * 2) if first_single else page * 2 - 1


def printed_page(page: Column, shift: int, anchor: int = 1) -> Column:
    """Printed number: pages from the anchor on are shifted."""
    return F.when(page >= anchor, page + shift).otherwise(page)
