"""Queries over rule sheets, item patterns and loanword dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spelling
from ..operators import loanwords, rulebook
from ..sources.tables import table

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("""SELECT p_partkey, replace(p_name, 'e', '",') AS name, p_size::VARCHAR AS size, p_brand AS brand FROM part""")
def sheet_cells(spark, sf_dir):
    """Cells of CSV lines with quoted commas and doubled quotes."""
    line = F.concat(F.lit('"'), F.replace("p_name", F.lit("e"), F.lit('"",')), F.lit('",'), F.col("p_size").cast("string"), F.lit(',"'), F.col("p_brand"), F.lit('"'))
    return _part(spark, sf_dir).select("p_partkey", rulebook.cells(line, ["name", "size", "brand"]).alias("c")).select("p_partkey", "c.*")


@query("""SELECT p_partkey, p_name AS find, p_type AS replace, CASE WHEN p_size % 2 = 0 THEN concat_ws('|', p_name, p_brand, p_type) END AS finds FROM part WHERE p_size % 5 NOT IN (0, 1)""")
def sheet_rules(spark, sf_dir):
    """Sheet rows as rules; rows without a find form or that change nothing go."""
    kind = F.col("p_size") % 5
    rows = _part(spark, sf_dir).select(
        "p_partkey", F.when(kind == 0, " ").when(kind == 1, F.col("p_type")).otherwise(F.concat(F.lit(" "), "p_name")).alias("find"), F.col("p_type").alias("replace"),
        F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("， "), "p_type", F.lit(",,"), "p_brand")).alias("finds"),
    )
    return rulebook.rule_rows(rows).select("p_partkey", "find", "replace", F.array_join("finds", "|").alias("finds"))


@query("""WITH RECURSIVE r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, [p_name || p_type, p_type || p_size] AS forms FROM part),
f AS (SELECT DISTINCT p_brand, 0::BIGINT AS k, NULL::BIGINT AS p_partkey, []::VARCHAR[] AS seen, NULL::VARCHAR AS clash FROM part
UNION ALL SELECT r.p_brand, r.k, r.p_partkey, CASE WHEN list_has_any(f.seen, r.forms) THEN f.seen ELSE list_concat(f.seen, r.forms) END, list_filter(r.forms, lambda x: list_contains(f.seen, x))[1] FROM f JOIN r ON r.p_brand = f.p_brand AND r.k = f.k + 1)
SELECT p_brand, p_partkey, clash IS NULL AS kept, clash FROM f WHERE k > 0""")
def first_rules_win(spark, sf_dir):
    """Rules of a sheet (a brand's parts) that no earlier kept rule has a form of."""
    rows = _part(spark, sf_dir).select("p_brand", "p_partkey", F.array(F.concat("p_name", "p_type"), F.concat("p_type", F.col("p_size").cast("string"))).alias("forms"))
    return rulebook.first_wins(rows, "p_brand", "p_partkey")


PATTERN = r"""CASE mode WHEN 'spaced-before' THEN '(?:(?:^|(?<=\n))' || x || '[ \x{A0}]+|(\S+)[ \x{A0}]+' || x || ')' WHEN 'attached-before' THEN '(?:(\S+' || x || ')(?!\S))'
WHEN 'fixed-phrase' THEN '(?:' || replace(x, ' ', '[ \x{A0}]+') || '[a-z]+(?!\S))' ELSE '(?:(?<!\S)(\S*)\s*' || x || ')' END"""


@query(f"""WITH i AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'spaced-before' WHEN 1 THEN 'attached-before' WHEN 2 THEN 'fixed-phrase' ELSE 'any-before' END AS mode, unnest([p_name, p_type]) AS x, unnest([1, 2]) AS k FROM part WHERE p_size % 3 <> 0)
SELECT p_partkey, mode, string_agg({PATTERN}, '|' ORDER BY k) AS pattern FROM i GROUP BY ALL""")
def caution_item_rules(spark, sf_dir):
    """Patterns of enabled caution items, over all their stems, by their sheet's name of the way of matching."""
    names = F.element_at(F.array(F.lit(" AP-space"), F.lit("glue"), F.lit("Phrase"), F.lit("else")), F.col("p_size") % 4 + 1)
    items = _part(spark, sf_dir).select("p_partkey", rulebook.match_mode(names).alias("mode"), F.array("p_name", F.lit(""), "p_type").alias("stems"), (F.col("p_size") % 3 != 0).alias("enabled"))
    return rulebook.item_rules(items, "a-z").select("p_partkey", "mode", "pattern")


@query("""WITH i AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name || p_size END AS label, p_size % 7 = 0 AND p_type <> 'ECONOMY' AS bundle FROM part),
c AS (SELECT DISTINCT label AS head FROM i WHERE bundle) SELECT p_partkey, NOT bundle AND EXISTS (SELECT 1 FROM c WHERE starts_with(label, head)) AS inventory_only FROM i""")
def inventory_items(spark, sf_dir):
    p = _part(spark, sf_dir)
    bundled = F.col("p_size") % 7 == 0
    label = F.when(bundled, F.substring_index("p_name", " ", 1)).otherwise(F.concat("p_name", F.col("p_size").cast("string")))
    items = p.select("p_partkey", label.alias("label"), F.expr("cast(array() as array<string>)").alias("stems"), F.when(bundled & (F.col("p_type") != "ECONOMY"), F.col("p_brand")).alias("display_label"))
    return rulebook.inventory_items(items).select("p_partkey", "inventory_only")


BOOK = "b AS (SELECT p_partkey AS ord, CASE WHEN p_size % 8 = 1 THEN p_brand WHEN p_size % 8 = 5 THEN p_name ELSE '' END AS rule_id, p_name AS find, p_type AS replace, CASE WHEN p_size % 3 = 1 THEN '' ELSE p_brand || p_size END AS v FROM part WHERE p_size % 2 = 1)"
HITS = "m AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name ELSE '' END AS rule_id, p_name AS find, p_type AS replace FROM part)"


@query(f"""WITH {BOOK}, {HITS}, i AS (SELECT rule_id, arg_max(v, ord) AS v FROM b WHERE rule_id <> '' GROUP BY 1), p AS (SELECT find, replace, arg_max(v, ord) AS v FROM b GROUP BY ALL),
j AS (SELECT rule_id, arg_max(v, ord) AS v FROM b WHERE rule_id <> '' AND v <> '' GROUP BY 1), q AS (SELECT find, replace, arg_max(v, ord) AS v FROM b WHERE v <> '' GROUP BY ALL)
SELECT m.p_partkey, coalesce(i.v, p.v) AS tip, coalesce(j.v, q1.v, q.v) AS overlay FROM m LEFT JOIN i USING (rule_id) LEFT JOIN p ON m.find = p.find AND m.replace = p.replace
LEFT JOIN j ON m.rule_id = j.rule_id LEFT JOIN q AS q1 ON m.rule_id = q1.find AND m.replace = q1.replace LEFT JOIN q ON m.find = q.find AND m.replace = q.replace""")
def tips_and_overlays(spark, sf_dir):
    """Tips by rule id, then by find and replace; overlays by rule id, by the id as a find form, then by find and replace."""
    p, size = _part(spark, sf_dir), F.col("p_size")
    hits = p.select("p_partkey", F.when(size % 3 == 0, F.col("p_brand")).when(size % 3 == 1, F.col("p_name")).otherwise("").alias("rule_id"), F.col("p_name").alias("find"), F.col("p_type").alias("replace"))
    value = F.when(size % 3 == 1, "").otherwise(F.concat("p_brand", size.cast("string")))
    book = p.where(size % 2 == 1).select(F.col("p_partkey").alias("ord"), F.when(size % 8 == 1, F.col("p_brand")).when(size % 8 == 5, F.col("p_name")).otherwise("").alias("rule_id"), F.col("p_name").alias("find"), F.col("p_type").alias("replace"), value.alias("tip"), value.alias("overlay"))
    return rulebook.looked_up(rulebook.looked_up(hits, book, "tip"), book, "overlay", by_primary=True).select("p_partkey", "tip", "overlay")


@query("""WITH s AS (SELECT s_suppkey AS k, s_acctbal > 4000 AS f FROM supplier), own AS (SELECT k::VARCHAR AS item, f FROM s WHERE k % 2 = 0), older AS (SELECT (k * 2)::VARCHAR AS item, f FROM s WHERE k % 2 = 1)
SELECT p_partkey, coalesce(own.f, older.f, p_size > 25) AS enabled FROM part LEFT JOIN own ON own.item = p_partkey::VARCHAR LEFT JOIN older ON older.item = p_partkey::VARCHAR""")
def item_flags(spark, sf_dir):
    """Saved flags over the defaults, under an item's own name or an older one."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    saved = s.select(F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("item"), (F.col("s_acctbal") > 4000).alias("enabled"))
    aliases = s.select(F.concat(F.lit("s"), k.cast("string")).alias("alias"), (k * 2).cast("string").alias("item"))
    items = _part(spark, sf_dir).select("p_partkey", F.col("p_partkey").cast("string").alias("item"), (F.col("p_size") > 25).alias("enabled"))
    return rulebook.flags(items, saved, aliases).select("p_partkey", "enabled")


@query(r"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '[^\s\x{FFFD}]+[ \x{A0}]+' || replace(p_name, ' ', '[ \x{A0}]+') WHEN 1 THEN replace(p_name, ' ', '[ \x{A0}]+') || '[^\s\x{FFFD}]+' || '\(' END AS slots, replace(p_name, ' ', '[ \x{A0}]+') AS phrase FROM part""")
def phrase_patterns(spark, sf_dir):
    """Patterns of phrases with slots, and of phrases as they stand."""
    kind = F.col("p_size") % 3
    text = F.when(kind == 0, F.concat(F.lit(" @ "), "p_name")).when(kind == 1, F.concat("p_name", F.lit("@("))).otherwise(F.col("p_name"))
    return _part(spark, sf_dir).select("p_partkey", rulebook.slot_pattern(text).alias("slots"), rulebook.phrase_pattern(F.col("p_name")).alias("phrase"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND NOT release THEN p_name = 'small ring' ELSE p_size % 2 = 1 AND p_size > 40 END AS pinned, CASE WHEN p_size % 2 = 0 AND (release OR p_name = 'small ring') THEN NULL WHEN p_size % 2 = 0 THEN 'small ring' ELSE p_type END AS overlay
FROM part, (SELECT bool_or(p_size % 2 = 0 AND p_size > 60 AND p_name = 'small ring') AS release FROM part)""")
def pinned_forms(spark, sf_dir):
    """One unify entry pinned: the other entries point to its form."""
    size = F.col("p_size")
    entry = size % 2 == 0
    rules = _part(spark, sf_dir).select("p_partkey", F.translate("p_name", " ", "˅").alias("tail"), entry.alias("unify"), F.when(entry, size > 60).otherwise(size > 40).alias("pinned"), F.col("p_type").alias("overlay"))
    return rulebook.pinned(rules, " small  ring").select("p_partkey", "pinned", "overlay")


TYPOS = """w AS (SELECT string_split(text, ' ') AS w FROM benchmark), one AS (SELECT unnest(w) AS typo FROM w), two AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS typo FROM w),
t AS (SELECT DISTINCT typo FROM (FROM one UNION ALL FROM two) WHERE regexp_matches(typo, '^[A-Za-z ]{8,}$'))"""
PLACES = """c AS (SELECT doc_id, typo, string_split(text, typo) AS p FROM documents JOIN t ON contains(text, typo)), e AS (SELECT *, unnest(range(1, len(p))) AS k FROM c),
m AS (SELECT doc_id, typo, (list_sum(list_transform(p[:k], lambda x: length(x))) + (k - 1) * length(typo))::BIGINT AS start, CASE WHEN p[k] = '' AND k > 1 THEN right(typo, 1) ELSE right(p[k], 1) END AS before FROM e),
f AS (SELECT doc_id, typo AS matched, start FROM m WHERE NOT regexp_matches(before, '[0-9A-Za-z_]')),
g AS (SELECT doc_id, list({'start': start, 'stop': start + length(matched), 'matched': matched} ORDER BY -length(matched), start) AS l FROM f GROUP BY doc_id),
o AS (SELECT doc_id, unnest(list_reduce(list_prepend([], list_transform(l, lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda c: x[1].start < c.stop AND c.start < x[1].stop)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM g)"""


def _typos(spark, sf_dir):
    """Words and pairs of words of the benchmark, eight letters and blanks or more."""
    w = table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return w.where(F.size("w") > 1).select(F.explode(F.concat("w", pairs)).alias("typo")).where(F.col("typo").rlike("^[A-Za-z ]{8,}$")).distinct()


@query(f"WITH {TYPOS}, {PLACES} SELECT x.matched AS typo, 'short' AS bundle, upper(x.matched) || ' 또는 ' || x.matched AS suggestion, count(*) AS n, min(doc_id) AS first_doc, sum(x.start)::BIGINT AS start_sum FROM o GROUP BY ALL")
def loanword_groups(spark, sf_dir):
    """Misspelt forms of one or two words in the documents with their suggestions: at word beginnings, longest first, none overlaps."""
    found = loanwords.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), _typos(spark, sf_dir))
    g = found.groupBy("typo").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.sum("start").alias("start_sum"))
    return g.select("typo", loanwords.bundle(F.col("typo")).alias("bundle"), loanwords.suggestion(F.array(F.upper("typo"), F.lit(""), "typo")).alias("suggestion"), "n", "first_doc", "start_sum")


ENTRIES = "e AS (SELECT p_partkey AS ord, p_name AS head, p_brand AS alt, reverse(p_name) AS miss FROM part), words AS (SELECT DISTINCT unnest([p_name, replace(p_name, ' ', ''), split_part(p_name, ' ', 1), reverse(p_name), p_brand, p_type]) AS word FROM part)"


def _entries(spark, sf_dir):
    p = _part(spark, sf_dir)
    entries = p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("head"), F.array("p_brand").alias("alternates"), F.array(F.reverse("p_name")).alias("misspellings"))
    words = p.select(F.explode(F.array("p_name", F.replace("p_name", F.lit(" "), F.lit("")), F.substring_index("p_name", " ", 1), F.reverse("p_name"), "p_brand", "p_type")).alias("word")).distinct()
    return words, entries


@query(f"""WITH {ENTRIES}, f AS (SELECT replace(head, ' ', '') AS form, 100 AS score, ord, head FROM e UNION ALL SELECT replace(miss, ' ', ''), 90, ord, head FROM e UNION ALL SELECT alt, 80, ord, head FROM e UNION ALL SELECT unnest(string_split(head, ' ')), 50, ord, head FROM e),
b AS (SELECT form, arg_min(head, (-score, ord)) AS head, max(score)::INTEGER AS score FROM f GROUP BY form) SELECT word, head, score FROM words JOIN b ON replace(word, ' ', '') = form""")
def best_entries(spark, sf_dir):
    """The dictionary entry worth most for each word, parts of heads included."""
    return loanwords.best_entries(*_entries(spark, sf_dir), least=loanwords.PART)


@query(f"""WITH {ENTRIES}, k AS (SELECT word, replace(word, ' ', '') AS form FROM words), h AS (SELECT DISTINCT replace(head, ' ', '') AS form FROM e), a AS (SELECT DISTINCT alt AS form FROM e), m AS (SELECT DISTINCT replace(miss, ' ', '') AS form FROM e),
n AS (SELECT form, count(*) AS n FROM (SELECT replace(head, ' ', '') AS form FROM e UNION ALL SELECT alt FROM e) GROUP BY form)
SELECT word, CASE WHEN form IN (FROM h) THEN 'exact' WHEN form IN (FROM a) THEN 'alt' WHEN form IN (FROM m) THEN 'typo' ELSE 'other' END AS kind, coalesce(n, 0) AS entries FROM k LEFT JOIN n USING (form)""")
def entry_kinds(spark, sf_dir):
    """How the dictionary has a word, and in how many entries as head or alternate."""
    words, entries = _entries(spark, sf_dir)
    n = loanwords.by_form(words, entries).groupBy("word").agg(F.count("*").alias("entries"))
    return loanwords.kinds(words, entries).join(n, "word", "left").select("word", "kind", F.coalesce("entries", F.lit(0).cast("long")).alias("entries"))


@query("""SELECT doc_id, md5(translate(text, chr(65533) || ' ' || chr(160), '˅˅˅')) AS marked, md5(translate(translate(text, chr(65533) || chr(160), '  '), '˅', ' ')) AS plain FROM documents""")
def visible_blanks(spark, sf_dir):
    """Texts with visible blanks, and their way back."""
    marked = spelling.with_marks(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(marked.cast("binary")).alias("marked"), F.md5(spelling.without_space_marks(marked).cast("binary")).alias("plain"))
