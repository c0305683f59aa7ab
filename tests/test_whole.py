"""Registered queries against brute force on small fixtures, where their SQL takes less than the whole."""

from collections import Counter, defaultdict

from pagemill.plans import catalogue
from pagemill.streaming import quota

LINES = ["note book note book notebook", "in so far as it goes", "insofarasit goes insofar as", "a b c d e f g", "abcdef abcdef a b c d e f", "notebooks notebookish insofarasitgoes", "note pad notepad notepad notepad notepad notepad notepad notepad"]


def index(lines):
    n = Counter()
    for line in lines:
        w = line.split()
        n.update(" ".join(w[i : i + m]) for i in range(len(w)) for m in range(1, min(6, len(w) - i) + 1))
    forms = defaultdict(dict)
    for v, k in n.items():
        forms[v.replace(" ", "")][v] = k
    return n, forms


def test_six_words(spark, tmp_path):
    spark.createDataFrame([(0, "\n".join(LINES[:4])), (1, "\n".join(LINES[4:]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()]
    n, forms = index(LINES)
    sizes = defaultdict(list)
    for v, k in n.items():
        sizes[v.count(" ") + 1].append(k)
    assert sorted(run("ngram_index")) == sorted((m, len(x), sum(x), max(x)) for m, x in sizes.items()) and set(sizes) == {1, 2, 3, 4, 5, 6}

    both = {k: f for k, f in forms.items() if k in f and len(f) > 1}
    best = lambda f: min(f, key=lambda v: (-f[v], v.count(" "), v))
    conflicts = {(k, len(f), sum(f.values()), best(f)) for k, f in both.items()}
    assert set(run("spacing_conflicts")) == conflicts == set(run("spacing_conflicts_topk")) and {"insofarasit", "abcdef"} <= set(both)

    series = defaultdict(dict)
    for k, f in both.items():
        series[min(v for v in f if v != k).split()[0]][k] = f
    share = {a: round(sum(f[k] for k, f in x.items()) / sum(sum(f.values()) for f in x.values()), 6) for a, x in series.items()}
    assert set(run("series_trend")) == {(a, len(x), sum(sum(f.values()) for f in x.values()), share[a]) for a, x in series.items()}
    picked = set()
    for a, x in series.items():
        if share[a] >= 0.8 or share[a] <= 0.2:
            picked |= {(a, k, k if share[a] >= 0.8 else min((v for v in f if v != k), key=lambda v: (-f[v], v))) for k, f in x.items()}
    assert set(run("series_majority")) == picked
    heads = [a for a in series if len(a) >= 4]
    singles = {k: [a for a in heads if k.startswith(a) and len(a) < len(k)] for k, f in forms.items() if len(f) == 1}
    assert set(run("series_satellites")) == {(k, max(a, key=len)) for k, a in singles.items() if a}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_titles_of_any_letters_and_length(spark, tmp_path):
    items = ["Élan vital à la carte. x", "Plain title here. y", "Über die Straße " + "lang " * 60]
    docs = ["Élan vital a la carte. z", "Élan. z", "Plain title hère. q", "Über die Strasse " + "lang " * 59, "Über alles. q", "Other"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {}
    for i, text in enumerate(items):
        title = text.split(".")[0]
        for other in {d.split(".")[0] for d in docs}:
            x, y = (v.replace(" ", "").lower() for v in (title, other))
            score = round(1 - distance(x, y) / max(len(x), len(y)), 6)
            if title.split(" ")[0] == other.split(" ")[0] and score >= 0.2:
                expected[i] = min(expected.get(i, (0, "")), (-score, other))
    got = {r.item_id: (-r.score, r.other) for r in catalogue.queries()["title_similarity"](spark, str(tmp_path)).collect()}
    assert got == expected and set(got) == {0, 1, 2}


def test_every_line_and_customer(spark, tmp_path):
    spark.createDataFrame([(1, "'one', two.\n(three) four!")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k, "1998-12-20") for k in range(12)] + [(12, 99, "1998-01-01")], "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "cast(d as timestamp_ntz) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    q = catalogue.queries()
    assert sorted((r.line_num, r.form) for r in q["unmarked_forms"](spark, str(tmp_path)).collect()) == [(0, "one two"), (1, "three four")]
    assert sorted(r.o_custkey for r in q["ttl_listing"](spark, str(tmp_path)).collect()) == list(range(12))


def test_stream_of_a_long_history_out_of_order(spark, tmp_path):
    days = ["2024-06-01", "2024-01-01", "2024-09-01", "2024-02-01", "2023-01-01", "2024-06-01"]
    rows = [(k, k % 2, f"{d} 01:00:00") for k, d in enumerate(days)]
    for k, row in enumerate(rows + rows[:2]):
        spark.createDataFrame([row], "event_id long, user_id long, d string").selectExpr("event_id", "user_id", "cast(d as timestamp) as ts").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    for k in range(8):
        (tmp_path / "in" / f"part={k}" / "_SUCCESS").unlink()
    stream = quota.daily_counts(spark, f"{tmp_path}/in/*", "*.parquet", "event_id long, user_id long, ts timestamp", lateness=None, files_per_trigger=1)
    got = quota.run_once(stream, f"{tmp_path}/out")
    assert Counter({(r.user_id, r.day): r.n for r in got.collect()}) == Counter((u, d[:10]) for _, u, d in rows)
    assert got.inputFiles()


def test_registered_stream_drops_no_late_event(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(quota, "run_once", lambda stream, *rest: seen.append(stream._jdf.queryExecution().analyzed().toString()))
    catalogue.queries()["consumed_stream"](spark, "/root/testdata/sf0.001")
    assert "EventTimeWatermark" not in seen[0] and "Deduplicate" in seen[0]
