"""Rule sheets: reading, cleaning, first-wins order, patterns of items, tips and flags looked up by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed
from ..sources.shared import cut, discard

# Names under which a sheet may give each way of matching, and the way of all other names.
MODES = {
    "stem-list": ("stem-list", "stems", "ap-stems", "spaced-stem", "space-stem", "stem", "spaced-compound"),
    "spaced-before": ("ap-space", "spaced-before", "spaced", "space"),
    "attached-before": ("ap-attach", "before-attached", "ap-attached", "attached-before", "attached", "glue", "glued", "붙임"),
    "fixed-phrase": ("fixed-phrase", "fixed", "phrase", "fixedphrase"),
    "any-before": ("ap-any", "any-before", "any"),
}
OTHER_MODE = "any-before"
BLANK = "[ \\x{A0}]+"
#: Most words of a find form that is no bundle of variants.
MOST_WORDS = 8


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, all as text: quoted cells may hold commas, line ends and doubled quotes."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return named(rows)


def named(rows: DataFrame) -> DataFrame:
    """Headers trimmed and lower-cased; rows whose cells are all blank go."""
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    filled = F.concat(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns])
    return rows.where(filled != "")


def cells(line: Column, columns: list[str]) -> Column:
    """One CSV line as a struct of text cells."""
    return F.from_csv(line, ", ".join(f"`{c}` string" for c in columns), {"quote": '"', "escape": '"'})


def finds_of(cell: Column, primary: Column) -> Column:
    """Distinct forms of a comma list, the primary one in front if it is not among them; null if there are fewer than two."""
    parts = F.array_distinct(F.filter(F.transform(F.split(cell, "[,，]"), lambda x: F.trim(x)), lambda x: x != ""))
    main = F.trim(F.coalesce(primary, F.lit("")))
    forms = F.when((main != "") & ~F.array_contains(parts, main), F.concat(F.array(main), parts)).otherwise(parts)
    return F.when((F.trim(cell) != "") & (F.size(forms) >= 2), forms)


def rule_rows(rows: DataFrame) -> DataFrame:
    """Sheet rows (find, replace, finds, ...) as rules: trimmed, with their variants.

    Rows without find or replace, those that change nothing, and single forms of more than eight words go.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    out = rows.withColumn("find", clean("find")).withColumn("replace", clean("replace")).withColumn("finds", finds_of(F.col("finds"), F.col("find")))
    words = F.size(F.split("find", r"\s+"))
    return out.where((F.col("find") != "") & (F.col("replace") != "") & (F.col("find") != F.col("replace")) & (F.col("finds").isNotNull() | (words <= MOST_WORDS)))


def first_wins(rules: DataFrame, by: str, order: str, forms: str = "forms") -> DataFrame:
    """(by, order, kept, clash): a rule is kept unless an earlier kept rule of its sheet has one of its forms.

    clash is the first such form. A rule that is not kept claims nothing, so the choice depends on the order. It is made in rounds: a rule that is the first of all open
    ones for each of its forms is kept, and every open rule with one of its forms is not; rounds are as many as rules wait for one another. Rules of equal order come in the order of
    their forms, the first of equal ones first; null forms are none.
    """
    nth = F.row_number().over(Window.partitionBy(by, order, forms).orderBy(F.lit(1)))
    own = F.array_distinct(F.array_compact(F.coalesce(F.col(forms), F.expr("cast(array() as array<string>)"))))
    # A struct holds a sheet's null name like any other.
    rows = cut(rules.select(F.struct(F.col(by)).alias("sheet"), F.struct(F.col(order).cast("long").alias("o"), F.col(forms).alias("f"), nth.alias("n")).alias("rule"), own.alias("own")))
    open_, kept = rows.select("sheet", "rule", F.explode("own").alias("form")), []
    while True:
        lead = open_.groupBy("sheet", "form").agg(F.min("rule").alias("lead"))
        wins = open_.join(lead, ["sheet", "form"]).groupBy("sheet", "rule").agg(F.bool_and(F.col("rule") == F.col("lead")).alias("wins"))
        marked = cut(open_.join(wins, ["sheet", "rule"]))
        if marked.isEmpty():
            discard(marked)
            break
        new, rest = marked.where("wins").drop("wins"), marked.where("not wins").drop("wins")
        kept.append(new.select("sheet", "form", F.col("rule").alias("keeper")))
        lost = rest.join(new.select("sheet", "form"), ["sheet", "form"], "left_semi").select("sheet", "rule").distinct()
        open_ = rest.join(lost, ["sheet", "rule"], "left_anti")
    each = rows.select("sheet", "rule", F.posexplode("own").alias("pos", "form"))
    claimed = reduce(DataFrame.unionByName, kept) if kept else each.select("sheet", "form", F.col("rule").alias("keeper")).limit(0)
    clash = each.join(claimed, ["sheet", "form"]).where(F.col("keeper") < F.col("rule")).groupBy("sheet", "rule").agg(F.min_by("form", "pos").alias("clash"))
    return rows.join(clash, ["sheet", "rule"], "left").select(F.col(f"sheet.{by}").alias(by), F.col("rule.o").alias(order), F.col("clash").isNull().alias("kept"), "clash")


def match_mode(name: Column) -> Column:
    """A sheet's name of a way of matching as one of the five."""
    n, out = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit(OTHER_MODE)
    for mode, names in MODES.items():
        out = F.when(n.isin(*names), mode).otherwise(out)
    return out


def quoted(c: Column) -> Column:
    """A regular expression that matches just this text."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def item_pattern(label: Column, mode: Column, letters: str = "가-힣") -> Column:
    """The pattern of a caution label: after a blank, at a token's end, as a phrase that goes on in letters, or anywhere in a token."""
    label_re, end = quoted(label), F.lit(r"(?!\S)")
    spaced = F.concat(F.lit(r"(?:^|(?<=\n))"), label_re, F.lit(BLANK + r"|(\S+)" + BLANK), label_re)
    phrase = F.concat(F.array_join(F.transform(F.split(F.trim(label), r"\s+"), quoted), BLANK), F.lit(f"[{letters}]+"), end)
    any_place = F.concat(F.lit(r"(?<!\S)(\S*)\s*"), label_re)
    return F.when(mode == "spaced-before", spaced).when(mode == "attached-before", F.concat(F.lit(r"(\S+"), label_re, F.lit(")"), end)).when(mode == "fixed-phrase", phrase).otherwise(any_place)


def item_rules(items: DataFrame, letters: str = "가-힣") -> DataFrame:
    """Enabled items (item, stems, mode, enabled) with their pattern: one of their stems, each in its own brackets. Items without stems go."""
    stems = F.filter("stems", lambda s: s.isNotNull() & (s != ""))
    pattern = F.array_join(F.transform(stems, lambda s: F.concat(F.lit("(?:"), item_pattern(s, F.col("mode"), letters), F.lit(")"))), "|")
    return items.where(F.col("enabled") & (F.size(stems) > 0)).withColumn("pattern", pattern)


def inventory_items(items: DataFrame) -> DataFrame:
    """items (item, label, stems, display_label) with inventory_only: single items whose label begins with a bundle's stem.

    Bundles have a display label or several stems. Labels meet stems by equality of their beginnings, so nothing is compared pairwise.
    """
    bundle = (F.trim(F.coalesce("display_label", F.lit(""))) != "") | (F.size("stems") > 1)
    marked = items.withColumn("bundle", F.coalesce(bundle, F.lit(False)))
    forms = F.when(F.size("stems") > 0, F.col("stems")).otherwise(F.array("label"))
    covered = marked.where("bundle").select(F.explode(forms).alias("head")).where("head != ''").distinct()
    label = F.trim(F.coalesce("label", F.lit("")))
    heads = marked.where(~F.col("bundle")).select(label.alias("__label")).where("__label != ''").distinct()
    heads = heads.select("__label", F.explode(F.sequence(F.lit(1), F.length("__label"))).alias("n")).select("__label", F.expr("substring(__label, 1, n)").alias("head"))
    under = heads.join(covered, "head", "left_semi").select("__label").distinct().withColumn("__under", F.lit(True))
    out = marked.withColumn("__label", label).join(under, "__label", "left")
    return out.withColumn("inventory_only", ~F.col("bundle") & F.coalesce("__under", F.lit(False))).drop("__label", "__under", "bundle")


def looked_up(matches: DataFrame, book: DataFrame, value: str, by_primary: bool = False) -> DataFrame:
    """matches (rule_id, find, replace, ...) with a value of the book (rule_id, find, replace, value): by rule id, then by find and replace.

    With ``by_primary`` the rule id is tried as a find form in between: bundles of variants carry their first form as id.
    An id found in the book counts even if its value is empty, but not with ``by_primary``, which skips empty values. Of
    several rows of a key the last one by ``ord`` counts.
    """
    rows = book.where(F.trim(F.coalesce(value, F.lit(""))) != "") if by_primary else book
    last = lambda keys: rows.groupBy(*keys).agg(F.max_by(F.coalesce(value, F.lit("")), "ord").alias("__v"))
    ids = last(["rule_id"]).where("rule_id != ''").withColumnRenamed("rule_id", "__id").withColumnRenamed("__v", "__by_id")
    pairs = last(["find", "replace"])
    out = matches.join(ids, F.col("rule_id") == F.col("__id"), "left")
    found = ["__by_id"]
    if by_primary:
        primary = pairs.select(F.col("find").alias("__p"), F.col("replace").alias("__q"), F.col("__v").alias("__by_primary"))
        out = out.join(primary, (F.col("rule_id") == F.col("__p")) & (F.trim("replace") == F.col("__q")), "left")
        found.append("__by_primary")
    out = out.join(pairs, ["find", "replace"], "left")
    return out.withColumn(value, F.coalesce(*found, "__v")).drop("__id", "__by_id", "__p", "__q", "__by_primary", "__v")


def flags(items: DataFrame, saved: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """items (item, enabled) with the saved flags (item, enabled) over their defaults; aliases (alias, item) name items by older names.

    A flag under the item's own name goes before one under an alias, of these the first alias by name.
    """
    named_now = saved.select("item", F.col("enabled").alias("__flag"), F.lit("").alias("__alias"))
    if aliases is not None:
        older = saved.withColumnRenamed("item", "alias").join(aliases, "alias").select("item", F.col("enabled").alias("__flag"), F.col("alias").alias("__alias"))
        named_now = named_now.unionByName(older)
    one = named_now.groupBy("item").agg(F.min_by("__flag", "__alias").alias("__flag"))
    return items.join(one, "item", "left").withColumn("enabled", F.coalesce("__flag", "enabled")).drop("__flag")


def is_slot_pattern(c: Column) -> Column:
    """Whether a phrase has a slot (@) and letters."""
    t = F.trim(c)
    return t.contains("@") & t.rlike("[가-힣A-Za-z]")


def slot_pattern(c: Column) -> Column:
    """The regular expression of a phrase with slots: each @ is what stands between blanks, blanks match any run of them. Null without a slot."""
    parts = F.split(F.trim(c), "@", -1)
    literal = lambda p: F.regexp_replace(quoted(p), "[ \\x{A0}]", "[ \\\\x{A0}]+")
    return F.when(is_slot_pattern(c), F.array_join(F.transform(parts, literal), r"[^\s\x{FFFD}]+"))


def phrase_pattern(c: Column) -> Column:
    """The regular expression of a registered phrase as it stands: any blanks between its words, none added. Null if it is blank."""
    t = squeezed(c)
    return F.when(t != "", F.array_join(F.transform(F.split(t, " "), quoted), BLANK))


def pinned(rules: DataFrame, target: str) -> DataFrame:
    """rules (tail, unify, pinned, overlay) with one unify entry pinned: the others' overlay is its form. A form that is pinned already is released."""
    form = squeezed(F.translate("tail", "˅", " "))
    want = " ".join(target.replace("˅", " ").split())
    now = rules.where(F.col("unify") & F.col("pinned")).where(form == want).select(F.lit(True).alias("__now")).distinct().limit(1)
    each = rules.join(F.broadcast(now), how="left") if want else rules.withColumn("__now", F.lit(False))
    release, entry = F.coalesce("__now", F.lit(False)), F.col("unify") & (form != "") & F.lit(want != "")
    flag = F.when(F.col("unify") & release, F.lit(False)).when(entry, form == want).otherwise(F.col("pinned"))
    overlay = F.when(F.col("unify") & release, F.lit(None)).when(entry & (form == want), F.lit(None)).when(entry, want).otherwise(F.col("overlay"))
    return each.withColumn("overlay", overlay).withColumn("pinned", flag).drop("__now")
