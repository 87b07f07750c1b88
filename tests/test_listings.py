"""Listings, folds of windows and exports on small tables, with nulls, ties and empty frames."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import folds, listings
from tidemark.sources import exports


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def test_registry_numbers_on(spark):
    items = spark.createDataFrame([(1, 10, 4), (1, 11, 2)], "report int, id int, n int")
    told = spark.createDataFrame([(1, 12, 3), (1, 13, 1), (1, 12, 0), (1, 10, 0), (1, None, 0), (2, 10, 5)], "report int, id int, seq int")
    assert rows(listings.extend_registry(items, told)) == [(1, 10, 4), (1, 11, 2), (1, 12, 5), (1, 13, 6), (2, 10, 1)]
    assert rows(listings.extend_registry(items.limit(0), told.limit(0))) == []


def test_covering_and_cached(spark):
    moments = spark.createDataFrame([(1, day(0)), (2, day(7)), (3, None)], "id int, day date")
    windows = spark.createDataFrame([("w", day(0), day(7)), ("v", day(7), day(7)), ("bad", day(5), day(1))], "window string, first date, last date")
    assert rows(listings.covering(moments, windows).select("id", "window")) == [(1, "w"), (2, "v"), (2, "w")]
    now = dt.datetime(2026, 1, 2)
    store = spark.createDataFrame([("k", now - dt.timedelta(hours=24), 1), ("k", now - dt.timedelta(hours=24), 2), ("old", now - dt.timedelta(hours=25), 3)], "key string, made timestamp, answer int")
    asked = spark.createDataFrame([("k",), ("old",), ("new",), (None,)], "key string")
    hits = lambda hours: {r.key: r.hit for r in listings.cached(asked, store, "key", F.lit(now), hours).collect()}
    assert hits(24) == {"k": 2, "old": None, "new": None, None: None} and set(hits(0).values()) == {None}


def test_companies_counts_and_edges(spark):
    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None)], "id int, names array<string>")
    awards = spark.createDataFrame([(i, 1, day(i), ["c", "c"]) for i in range(7)] + [(9, 8, day(9), ["d"])], "id long, item int, day date, names array<string>")
    edges = spark.createDataFrame([(2, "e", "x"), (8, "d", "x")], "item int, a string, b string")
    companies = spark.createDataFrame([(n, n != "b") for n in "abcdex"], "name string, home boolean")
    told = listings.active_companies(companies, items, awards, edges, F.col("home"), 4)
    assert [tuple(r) for r in told.collect()] == [("a", 2, []), ("b", 1, []), ("c", 0, [6, 5, 4, 3, 2]), ("e", 0, [])]
    lines = spark.createDataFrame([("p",), ("p",), ("q",)], "line string")
    assert rows(listings.counts_by_line({"x": lines, "y": lines.where("line = 'q'"), "z": lines.limit(0)})) == [("p", 2, 0, 0), ("q", 1, 1, 0)]
    told_edges = spark.createDataFrame([(1, "b", "z", "l"), (1, "b", "z", "l"), (1, "y", "z", "l"), (2, "z", "a", "l")], "item int, src string, dst string, label string")
    assert rows(listings.item_edges(items, told_edges)) == [(1, "b", "z", "l"), (2, "z", "a", "l")]
    assert listings.allowed(items, ("names", "none", "id")).columns == ["names", "id"]


def test_matrix_forecasts_and_markets(spark):
    latest = spark.createDataFrame([("a", "mass", 2), ("b", "mass", 5), ("a", "trl", 1), ("b", "trl", None), ("a", "x", 1), ("b", "x", 1)], "p string, k string, v int")
    assert rows(listings.spec_matrix(latest, "p", "k", "v", ["mass", "trl"])) == [("mass", 2, 2, 2, 5)]
    events = spark.createDataFrame([(1, "DE", "a drone and a tank"), (2, "DE", "Drone"), (3, None, "tank"), (4, "FR", None)], "id int, country string, text string")
    groups, members = listings.forecast_candidates(events, {"uav": "(?i)drone", "tank": "tank"}, {"uav": ("tank",)})
    assert {(r.platform, r.country): (r.n, r.first, r.contradicted) for r in groups.collect()} == {("uav", "DE"): (2, 1, True), ("tank", "DE"): (1, 1, False), ("tank", None): (1, 3, False)}
    assert members.count() == 4
    items = spark.createDataFrame([(1, ["a"], None, 5), (2, None, "DE", 5), (3, ["z"], None, 9), (4, [], "DE", None)], "id int, names array<string>, c string, score int")
    local = spark.createDataFrame([("a",), ("a",)], "name string")
    found = listings.market_items(items, local, F.col("c") == "DE", 2, F.col("score").desc_nulls_last(), F.col("id"))
    assert rows(found.select("id", "n")) == [(1, 1), (2, 2)]


def test_titles_and_runs(spark):
    now = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "y")], "id int, t string")
    before = spark.createDataFrame([(9, "x"), (8, "x"), (7, "")], "id int, t string")
    assert {r.id: r.previous for r in listings.same_title(now, before, F.col("t")).collect()} == {1: 8, 2: None, 3: None, 4: None}
    runs = spark.createDataFrame([("k", day(0), day(2), 5, ["s"]), ("k", day(5), day(6), 7, ["t", "s"]), ("k", day(10), day(11), 1, [])], "k string, a date, b date, v int, sources array<string>")
    best = listings.best_of_runs(runs, ["k"], "a", "b", 3, F.col("v").desc_nulls_last())
    assert sorted((r.v, r.sources) for r in best.collect()) == [(1, None), (7, ["s", "t"])]


def plain_windows(given, days):
    clusters = []
    for r in sorted(given, key=lambda r: (r[1], r[2])):
        near = lambda m: None not in (*m[4:], *r[4:]) and abs((m[4] - r[4]).days) <= days and abs((m[5] - r[5]).days) <= days  # noqa: E731, B023
        home = next((c for c in clusters if c[0][0] == r[0] and any(near(m) for m in c)), None)
        if home is None:
            clusters.append(home := [])
        home.append(r)
    out = []
    for c in clusters:
        firsts, lasts = [m[4] for m in c if m[4]], [m[5] for m in c if m[5]]
        best = min(c, key=lambda m: (m[3] or "C", m[1], m[2]))
        out.append((c[0][2], best[2], min(firsts, default=None), max(lasts, default=None), len(c)))
    return sorted(out, key=str)


def test_windows_of_a_pipeline(spark):
    import random

    r = random.Random(4)
    given = [(f"k{i % 2}", i, i, r.choice(["A", "B", "C", None]), r.choice([None, *map(day, range(0, 90, 4))]), r.choice([None, *map(day, range(90, 130, 4))])) for i in range(120)]
    df = spark.createDataFrame([(1, *g) for g in given], "report int, k string, nth int, id long, grade string, first_day date, last_day date")
    told = folds.merge_windows(df, "report", ["k"])
    assert sorted((tuple(x) for x in told.collect()), key=str) == plain_windows(given, 14)
    assert folds.merge_windows(df.limit(0), "report", ["k"]).collect() == []


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ("x", [1, None, 2]), ['a "b"', None], {"k": 1}), (2, None, None, None)], "id int, s struct<n:string,v:array<int>>, a array<string>, m map<string,int>")
    exports.to_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == ["id", "s_n", "s_v", "a", "m"]
    assert rows(back.orderBy("id").limit(1)) == [("1", "x", "1; 2", 'a "b"', '{"k":1}')]
    assert tuple(back.where("id = '2'").first()) == ("2", None, None, None, None)
