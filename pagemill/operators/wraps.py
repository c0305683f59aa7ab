"""Lines that a page broke inside of a word, joined again, with a map from the joined line back to the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters that end a word as particles, words of one letter, and letters that close a sentence.
PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "만", "와", "과", "도")
STANDALONE = ("간", "및", "등", "중", "후", "전", "겸", "즉", "곧", "또")
CLOSING = ("다", "요", "까", "네")


def breaks_word(line: Column, following: Column, letters: str = "가-힣", particles=PARTICLES, standalone=STANDALONE, closing=CLOSING) -> Column:
    """Whether a word goes on in the following line: the last word of the line has one letter and ends with it, a letter follows, and nothing tells that a word ends there.

    A word ends with a particle, a word that stands alone, before a particle that stands alone on the next line, and with a closing letter before two letters.
    """
    last, word = F.right(line, F.lit(1)), F.regexp_extract(line, r"(\S*)$", 1)
    first, second = F.left(following, F.lit(1)), F.substr(following, F.lit(2), F.lit(1))
    is_letter = lambda c: c.rlike(f"^[{letters}]$")
    one_of = lambda c, values: c.isin(list(values)) if values else F.lit(False)
    ends = one_of(last, particles) | one_of(word, standalone) | (one_of(first, particles) & ~is_letter(second)) | (one_of(last, closing) & is_letter(second))
    return F.coalesce(is_letter(last) & is_letter(first) & (F.regexp_count(word, F.lit(f"[{letters}]")) == 1) & ~ends, F.lit(False))


def joined_lines(lines: DataFrame, key: str = "doc_id", **kinds) -> DataFrame:
    """(key, line_num, line, pieces) of lines (key, line_num, start, line): blanks at their edges go, empty lines go, and lines that break a word are joined with the next one.

    line_num is that of the first line; pieces (at, start) say at which place of the joined line each line begins, and where in the text. Whether a line joins depends on the line as joined so far: one without blanks that was joined to the
    one before ends with a longer word, so among such lines every other one joins. A text's lines meet in one window.
    """
    edge = r"^[ \t]+|[ \t]+$"
    trimmed = lines.withColumn("__at", F.col("start") + F.length(F.regexp_extract("line", r"^([ \t]*)", 1))).withColumn("line", F.regexp_replace("line", edge, "")).where("line != ''")
    order = Window.partitionBy(key).orderBy("line_num")
    x = trimmed.withColumn("__breaks", breaks_word(F.col("line"), F.lead("line").over(order), **kinds))
    # Runs of lines without blanks that break a word, each run behind a line of another kind.
    alike = F.col("__breaks") & ~F.col("line").rlike(r"\s")
    x = x.withColumn("__run", F.sum(F.when(alike, 0).otherwise(1)).over(order))
    run = Window.partitionBy(key, "__run").orderBy("line_num")
    joins = F.when(F.row_number().over(run) % 2 == 1, F.first("__breaks").over(run)).otherwise(~F.first("__breaks").over(run))
    x = x.withColumn("__joins", joins)
    x = x.withColumn("__whole", F.sum(F.when(F.lag("__joins", 1, False).over(order), 0).otherwise(1)).over(order))
    wholes = x.groupBy(key, "__whole").agg(F.array_sort(F.collect_list(F.struct("line_num", F.col("__at").alias("start"), "line"))).alias("l"))
    sizes = F.transform("l", lambda p: F.length(p["line"]))
    pieces = F.transform("l", lambda p, i: F.struct(F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n).alias("at"), p["start"].alias("start")))
    return wholes.select(key, F.col("l")[0]["line_num"].alias("line_num"), F.array_join(F.transform("l", lambda p: p["line"]), "").alias("line"), pieces.alias("pieces"))


def in_text(pieces: Column, place: Column) -> Column:
    """The place in the text of a place in a joined line."""
    piece = F.element_at(F.filter(pieces, lambda p: p["at"] <= place), -1)
    return piece["start"] + place - piece["at"]
