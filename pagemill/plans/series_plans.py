"""Queries over series and merged clusters of spacing variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collapse, grams, patterns, series, spacing, wraps
from ..sources.shared import cut
from ..sources.tables import lines, table
from .text_plans import _conflicts, _index, _index_sql

QUERIES: dict = {}
#: Letters of any script.
LETTERS = r"\p{L}"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


WORDS = "w AS (SELECT key, string_split(arg_min(variant, (-n, length(variant) - length(key), variant)), ' ') AS p FROM x WHERE contains(variant, ' ') AND key IN (SELECT key FROM k) GROUP BY key)"


def _weak(affix: str, least: int = 3) -> str:
    return f"(regexp_matches({affix}, '^[0-9]+$') OR len(regexp_extract_all({affix}, '[\\p{{L}}]')) < {least})"


def _rounds(name: str, end: bool, rest: str) -> str:
    """Recursive tables: in each round the affixes of one length, from the longest on, take the keys that are free."""
    word, cut = ("p[-1]", "right") if end else ("p[1]", "left")
    run = "r[-1]" if end else "r[1]"
    slices = lambda w, n: f"list_filter(list_transform(range({n}, 2, -1), lambda i: {cut}({w}, i)), lambda a: NOT {_weak('a')})"
    return f"""{name}_o AS MATERIALIZED (SELECT key, CASE WHEN NOT {_weak(word)} THEN {slices(word, f'length({word})')} WHEN {run} IS NOT NULL THEN {slices(run, f'least(4, length({run}) - 1)')} ELSE [] END AS offers
  FROM (SELECT *, regexp_extract_all(key, '[\\p{{L}}]+') AS r FROM w) {rest}),
{name} AS (
  SELECT key, offers, NULL::VARCHAR AS affix, (SELECT max(len(offers[1])) FROM {name}_o) AS size FROM {name}_o
  UNION ALL
  SELECT key, offers, CASE WHEN affix IS NULL AND a IS NOT NULL AND count(*) FILTER (affix IS NULL) OVER (PARTITION BY a) >= 2 THEN a ELSE affix END, size - 1
  FROM (SELECT *, list_filter(offers, lambda o: length(o) = size)[1] AS a FROM {name} WHERE size >= 3))"""


SERIES_SQL = f"""WITH RECURSIVE {_index_sql(6)}, {WORDS}, {_rounds('heads', False, '')},
pre AS MATERIALIZED (SELECT key, affix FROM heads WHERE size = 2 AND affix IS NOT NULL), {_rounds('tails', True, 'WHERE key NOT IN (SELECT key FROM pre)')}
SELECT 'prefix' AS affix_type, affix, key FROM pre UNION ALL SELECT 'suffix', affix, key FROM tails WHERE size = 2 AND affix IS NOT NULL"""


@query(SERIES_SQL)
def series_groups(spark, sf_dir):
    """Conflicts by the longest beginning that several share, then the rest by the longest end."""
    return series.longest_first(_conflicts(spark, sf_dir), 3, LETTERS).select("affix_type", "affix", "key")


#: No SQL: each affix's turn depends on all before it; tests/test_series.py takes them one by one.
@query(None)
def series_by_size(spark, sf_dir):
    """Conflicts by the first or last word of their spaced form, the words of most conflicts first."""
    return series.largest_first(_conflicts(spark, sf_dir), 2, 2, LETTERS).select("affix_type", "affix", "key")


#: No SQL, like series_by_size.
@query(None)
def series_list(spark, sf_dir):
    """The whole list: normalised conflicts in series or alone, and single forms that belong to a series' word."""
    x = cut(collapse.conflicting(collapse.normalised(_conflicts(spark, sf_dir), 3, LETTERS)))
    return series.listed(x, grams.singles(table(spark, sf_dir, "documents").select("text"), 2), 2, LETTERS)


COLLAPSED = f"""{_index_sql(6)}, c AS (SELECT key, variant, n FROM x WHERE key IN (SELECT key FROM k)),
h AS (SELECT key, coalesce(sum(n) FILTER (NOT contains(variant, ' ')), 0)::BIGINT AS g, arg_min(variant, (-n, length(variant) - length(key), variant)) FILTER (contains(variant, ' ')) AS spaced, max(n) FILTER (contains(variant, ' ')) AS m FROM c GROUP BY key),
"""
ABSORBED = """, gain AS (SELECT into_key AS key, sum(g)::BIGINT AS g, sum(m)::BIGINT AS m FROM moves JOIN h USING (key) GROUP BY into_key),
kept AS (SELECT key, variant, n FROM c WHERE key NOT IN (SELECT key FROM moves)
  UNION ALL SELECT key, key, gain.g FROM gain UNION ALL SELECT key, spaced, gain.m FROM gain JOIN h USING (key))
SELECT key, variant, sum(n)::BIGINT AS n FROM kept GROUP BY ALL"""
NESTED = """p AS (SELECT *, string_split(spaced, ' ') AS w FROM h),
pairs AS (SELECT l.key, u.key AS under FROM p u JOIN p l ON u.w[1] = l.w[1] AND u.w[2] = l.w[2] AND len(l.w) > len(u.w) AND length(l.key) > length(u.key) AND starts_with(l.key, u.key)),
moves AS (SELECT key, arg_min(under, length(under)) AS into_key FROM pairs WHERE under NOT IN (SELECT key FROM pairs) GROUP BY key)"""
UNITS = """u AS (SELECT key FROM h WHERE len(string_split(spaced, ' ')) = 2 AND len(list_filter(string_split(spaced, ' '), lambda w: len(regexp_extract_all(w, '[\\p{L}]')) < 3)) = 0),
b AS (SELECT key, left(key, unnest(range(6, length(key)))::INTEGER) AS into_key FROM h),
moves AS (SELECT b.key, arg_min(into_key, length(into_key)) AS into_key FROM b JOIN u ON u.key = into_key GROUP BY b.key)"""


@query(f"WITH {COLLAPSED}{NESTED}{ABSORBED}")
def nested_absorbed(spark, sf_dir):
    """Conflicts with the findings of those that go on from them."""
    return collapse.without_nested(_conflicts(spark, sf_dir))


@query(f"WITH {COLLAPSED}{UNITS}{ABSORBED}")
def units_absorbed(spark, sf_dir):
    """Conflicts with the findings of all that begin with a unit of two words of three letters or more."""
    return collapse.shorter_units(_conflicts(spark, sf_dir), 3, LETTERS)


#: No SQL: every step changes the keys of the next; tests/test_series.py takes the clusters one by one.
@query(None)
def normalised_clusters(spark, sf_dir):
    return collapse.normalised(_conflicts(spark, sf_dir), 3, LETTERS)


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(s))) AS k, unnest(s) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
t AS (SELECT doc_id, k, regexp_replace(raw, '^[ \t]+|[ \t]+$', '', 'g') AS line FROM l), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS following FROM t WHERE line <> ''),
b AS (SELECT *, coalesce(regexp_matches(right(line, 1), '\p{L}') AND regexp_matches(left(following, 1), '\p{L}') AND len(regexp_extract_all(regexp_extract(line, '(\S*)$', 1), '\p{L}')) = 1, false) AS breaks FROM n),
r AS (SELECT *, sum(CASE WHEN breaks AND NOT regexp_matches(line, '\s') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM b),
j AS (SELECT *, (row_number() OVER w % 2 = 1) = first_value(breaks) OVER w AS joins FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY k))
SELECT doc_id, count(*) AS lines, count(*) FILTER (joins) AS joined FROM j GROUP BY doc_id""")
def joined_lines(spark, sf_dir):
    """Lines of each document, and how many of them break a word of any letters."""
    split = lines(table(spark, sf_dir, "documents"))
    whole = wraps.joined_lines(split, letters=LETTERS, particles=(), standalone=(), closing=())
    return whole.groupBy("doc_id").agg(F.sum(F.size("pieces")).alias("lines"), F.sum(F.size("pieces") - 1).alias("joined"))


RULES_SQL = f"""{_index_sql(2)}, c2 AS (SELECT x.key, sum(n)::BIGINT AS n, arg_min(variant, (-n, length(variant) - length(x.key), variant)) FILTER (contains(variant, ' ')) AS spaced, any_value(recommended) AS chosen FROM x JOIN k USING (key) GROUP BY x.key),
sd AS (SELECT key, n, NOT contains(chosen, ' ') AS glued, unnest([{{'t': 'prefix', 'a': split_part(spaced, ' ', 1)}}, {{'t': 'suffix', 'a': split_part(spaced, ' ', 2)}}]) AS f FROM c2),
rl AS (SELECT f.t AS affix_type, f.a AS affix, count(*) AS keys, sum(n)::BIGINT AS findings, count(*) FILTER (glued) / count(*) AS share FROM sd WHERE NOT {_weak('f.a')} GROUP BY ALL HAVING count(*) >= 2),
rr AS (SELECT affix_type, affix, CASE WHEN share >= 0.8 THEN 'glued' ELSE 'spaced' END AS direction, keys, findings, findings + 10 * keys AS score FROM rl WHERE share >= 0.8 OR 1 - share >= 0.8)"""


def _pattern_rules(spark, sf_dir):
    x = _conflicts(spark, sf_dir, 2)
    return patterns.candidates(x, spacing.conflicts(x).select("key", F.col("recommended").alias("chosen")), 2, 0.8, 3, LETTERS)


@query(f"WITH {RULES_SQL} SELECT * FROM rr")
def pattern_candidates(spark, sf_dir):
    """Rules that the recommended forms of conflicts suggest."""
    return _pattern_rules(spark, sf_dir)


@query(f"""WITH {RULES_SQL}, vf AS (SELECT variant AS form, key, n, CASE WHEN contains(variant, ' ') THEN split_part(variant, ' ', 1) END AS a, CASE WHEN contains(variant, ' ') THEN split_part(variant, ' ', 2) END AS b FROM x),
pf AS (SELECT rr.affix_type, rr.affix, direction, key, form, n, a IS NOT NULL AS spaced, CASE WHEN rr.affix_type = 'prefix' THEN substr(key, length(affix) + 1) ELSE left(key, length(key) - length(affix)) END AS rest
  FROM vf JOIN rr ON (affix_type = 'prefix' AND (a = affix OR (a IS NULL AND starts_with(form, affix)))) OR (affix_type = 'suffix' AND (b = affix OR (b IS NULL AND ends_with(form, affix)))))
SELECT affix_type, affix, key, form, CASE WHEN spaced THEN key WHEN affix_type = 'prefix' THEN affix || ' ' || rest ELSE rest || ' ' || affix END AS other, n
FROM pf WHERE len(regexp_extract_all(rest, '[\\p{{L}}]')) >= 3 AND spaced <> (direction = 'spaced')""")
def pattern_mismatches(spark, sf_dir):
    """Forms of one or two words that go against these rules, each with the form that follows."""
    return patterns.mismatches(_index(spark, sf_dir, 2).select("variant", "n"), cut(_pattern_rules(spark, sf_dir)), None, 3, LETTERS)
