"""Gates, amounts, days and the desk's operators on literal values."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import amounts, gates
from tidemark.operators import desk


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def s(value):
    return F.lit(value).cast("string")


def test_sources(spark):
    now, none = F.lit(dt.datetime(2026, 3, 10, 12)), F.lit(None).cast("timestamp")
    ago = lambda **k: F.lit(dt.datetime(2026, 3, 10, 12) - dt.timedelta(**k))
    due = lambda kind, last, poll=False: gates.due(s(kind), last, now, poll)
    assert one(spark, due("weekly", none), due("daily", ago(hours=1)), due("daily", ago(hours=19), True), due("daily", ago(hours=20), True), due("weekly", ago(hours=155)), due("weekly", ago(hours=156)), due(None, ago(hours=1))) == (True, True, False, True, False, True, True)
    days = lambda last, n=3: gates.lookback_days(last, F.lit(n), now)
    assert one(spark, days(none), days(none, 20), days(ago(hours=5)), days(ago(days=6)), days(ago(days=90)), days(ago(days=-2))) == (14, 20, 3, 7, 21, 3)
    to = lambda a, b, blocked=False: gates.trusted_redirect(s(a), s(b), F.lit(blocked))
    assert one(spark, to("http://a.com/x", "https://www.a.com/y"), to("http://a.com/x", "http://b.com/x"), to("http://a.com/x", "http://a.com/login"), to("http://a.com/x", "http://a.com/y", True)) == (True, False, False, False)


def test_kinds_of_sources(spark):
    told = {
        "https://sam.gov/opp": True, "https://www.army.mil/x": True, "https://x.example.com": False, "https://ir.acme.com/press-releases/1": True,
        "https://ir.acme.com/about": False, "https://u@www.prnewswire.com:443/n": True, None: False, "": False, "https://notgov.com": False,
    }
    df = spark.createDataFrame([(u,) for u in told], "u string")
    assert [r[0] for r in df.select(gates.official(F.col("u"))).collect()] == list(told.values())
    kind = lambda u, v=None: gates.web_source(s(u), s(v))["kind"]
    assert one(spark, kind("https://en.wikipedia.org/x"), kind("https://www.janes.com/x"), kind("https://elbitsystems.com/p", "Elbit Systems"), kind("https://old.reddit.com/r"), kind("https://news.example.com"), kind(None), kind("https://ab.com", "ab")) == ("reference", "trade_press", "vendor_official", "forum", "press", "press", "press")
    ints, kinds = F.array().cast("array<int>"), F.lit(None).cast("array<string>")
    sure = lambda cites, kind=None, cited=kinds: gates.row_confidence(cites, s(kind), cited)
    assert one(spark, sure(ints, "official"), sure(F.array(F.lit(1))), sure(F.array(F.lit(1), F.lit(2))), sure(F.array(F.lit(1)), "tender"), sure(F.array(F.lit(1)), None, F.array(s(None), F.lit("datasheet"))), sure(F.lit(None).cast("array<int>"))) == ("low", "medium", "high", "high", "high", "low")


def test_scopes_and_boosts(spark):
    f = F.lit
    score = gates.focus_relevance(f(True), f(None).cast("boolean"), f(True), f(True), f(True))
    assert [tuple(x) for x in one(spark, score, gates.focus_relevance(*[f(False)] * 5))] == [(1.0, ["israeli_company_mentioned", "competitor_to_israeli_company", "export_market_signal", "hebrew_language_source"]), (0.0, [])]
    assert one(spark, gates.exercise_kind(s("test"), s("Operation Atlantic City")), gates.exercise_kind(s("test"), s("a shot was fired")), gates.exercise_kind(s("deal"), s("exercise")), gates.exercise_kind(s("test"), s(None))) == ("deployment", "test", "deal", "test")
    assert one(spark, gates.acquisition_boost(f(3), f(True), f(True)), gates.acquisition_boost(f(9), f(True), f(True)), gates.acquisition_boost(f(3), f(True), f(False))) == (8, 9, 3)
    tags = F.array(f("a"))
    assert one(spark, gates.opportunity_floor(f(2), tags, "a"), gates.opportunity_floor(f(7), tags, "a"), gates.opportunity_floor(f(2), tags, "b"), gates.opportunity_floor(f(2), f(None).cast("array<string>"), "a")) == (4, 7, 2, 2)
    scope = lambda domain, text, named=False, watched=False: gates.scope(s(domain), s(text), f(named), f(watched), ("thermal imaging",), ("ai", "machine learning"))
    found = [tuple(x) for x in one(spark, scope("tech", "New THERMAL imaging"), scope("tech", "an engine"), scope("tech", "an engine", True), scope("tech", "AI layoffs and hiring", True, True), scope("tech", "AI thermal imaging hiring"), scope("out_of_scope", None), scope("tech", "said hiring", True))]
    assert found == [("tech", None), ("out_of_scope", "gate:vocabulary"), ("tech", None), ("out_of_scope", "gate:market"), ("tech", None), ("out_of_scope", None), ("tech", None)]
    assert one(spark, gates.two_signals(s("Camera TENDER"), ("camera", "laser"), ("tender",)), gates.two_signals(s("camera"), ("camera",), ("tender",)), gates.two_signals(s(None), ("camera",), ("",))) == (["camera"], [], [])
    assert one(spark, gates.rubric(s("a b c d e f"), ("a", "A", "b")), gates.rubric(s("abcdef"), tuple("abcdef")), gates.rubric(s(None), ("a",))) == (3, 5, 1)
    ok = lambda status, domain, summary, title, text: gates.retrievable(*map(s, (status, domain, summary, title, text)))
    assert one(spark, ok(None, None, "s", "t", None), ok("clean", "tech", "s", None, "x"), ok("flagged", "tech", "s", "t", "x"), ok("clean", "out_of_scope", "s", "t", "x"), ok("clean", "tech", None, "t", "x"), ok("clean", "tech", "s", "t", "403 Forbidden"), ok("clean", "tech", "s", "t", "x" * 300 + "403 Forbidden")) == (True, True, False, False, False, False, True)


def test_deals_windows_and_turns(spark):
    none = F.lit(None).cast("double")
    key = lambda v, a, c, d: gates.deal_key(v, s(a), s("contract"), s(c), s(d))
    found = [tuple(x) for x in one(spark, key(F.lit(5.0), "x", " Navy ", "2024-01-02"), key(none, " $5M ", None, "2024-01-02"), key(none, None, "", None))]
    assert found == [("5.0", "contract", "navy"), ("$5m", "contract", "2024"), ("", "contract", None)]
    assert one(spark, gates.title_tokens(s("The new F-35 for Navy, the navy")), gates.title_tokens(s(None))) == (["f-35", "navy"], [])
    assert one(spark, *(gates.learned_threshold(F.lit(t), F.lit(n), 10) for t, n in ((0.1, 10), (0.95, 12), (0.5, 10), (0.5, 9)))) == (0.3, 0.8, 0.5, None)
    assert tuple(one(spark, gates.forecast_window(F.lit(dt.date(2024, 1, 31)), F.lit(1), F.lit(6)))[0]) == (dt.date(2024, 2, 29), dt.date(2024, 7, 31))
    assert one(spark, gates.rotating(F.lit(4), 5, 3), gates.rotating(F.lit(12), 5, 2)) == ([4, 0, 1], [2, 3])
    assert one(spark, gates.has_word(s("An AI story"), "ai"), gates.has_word(s("said"), "ai"), gates.has_word(s("בשוק העבודה"), "שוק העבודה"), gates.has_word(s(None), "x"), gates.has_word(s("c++ now"), "C++")) == (True, False, False, False, True)


def test_amounts_and_days(spark):
    told = {(464.8, "a $464.8 million deal"): (464.8e6, "million"), (10.0, "10bn"): (10e9, "bn"), (1595.0, "price $1,595"): (1595.0, None), (1595.0, "1,595 thousand"): (1595e3, "thousand"), (464.8, "464,8 מיליון"): (464.8e6, "מיליון"), (5.0, "15 million"): (5.0, None), (200000.0, "200000 million"): (200000.0, None), (3.0, None): (3.0, None), (None, "x"): (None, None), (2.0, "2 to million"): (2e6, "million")}
    df = spark.createDataFrame(list(told), "a double, t string")
    assert [tuple(r[0]) for r in df.select(amounts.scaled_amount(F.col("a"), F.col("t"))).collect()] == list(told.values())
    days = {"2024-05-06T00:00": "2024-05-06", "2024-13-01": None, "2024-05": "2024-05", "2024-15": None, "6/5/2024": "2024-05-06", "31/2/2024": None, "ב מאי 2024": "2024-05", "Sept. 2023": "2023-09", "early March 2022": None, "March 2022": "2022-03", "soon": None, None: None, "": None}
    days["early March 2022"] = "2022-03"
    df = spark.createDataFrame([(d,) for d in days], "d string")
    assert [r[0] for r in df.select(amounts.deal_date(F.col("d"))).collect()] == list(days.values())


def test_repeats_by_words(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["b", "c"]), (3, ["a", "z"]), (4, None), (5, []), (6, ["a"]), (1, ["x"]), (7, ["a", "a", "q"])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    found = {least: sorted(r["id"] for r in desk.repeats_by_words(df, df, least).collect()) for least in (1, 2, 3)}
    brute = lambda least: sorted({i for i, w in rows for j, v in rows if i != j and w and v and len(set(w) & set(v)) >= least})
    assert found == {least: brute(least) for least in (1, 2, 3)}
    assert desk.repeats_by_words(df.limit(0), df).count() == 0


def test_relations_and_reruns(spark):
    e = spark.createDataFrame([("a", "b", ["b", "a", None, "c"], "k", 1), ("a", None, None, "k", 2), ("a", "", ["d"], None, 3)], "owner string, customer string, parties array<string>, kind string, n int")
    assert sorted((r["src"], r["dst"], r["n"]) for r in desk.event_relations(e).collect()) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 3)]
    runs = spark.createDataFrame([(1, "What  is it", 1, 1), (2, "what is it ", 2, 1), (3, None, 0, 1), (4, None, 0, 2), (5, "x", 2, 9)], "id long, question string, grade int, at int")
    links = spark.createDataFrame([(5, 2)], "a long, b long")
    assert sorted(map(tuple, desk.best_of_reruns(runs, links).collect())) == [(1, 5, 2), (3, 3, 0), (4, 4, 0)]
