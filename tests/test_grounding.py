"""Amounts, events and analyses held against their sources, on literal cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import grounding as g
from tidemark.operators import grounding

ROUND = (
    "US defense-tech giant Anduril has chosen Amikam Norkin as head of the company's operations in Israel. It examined possible collaborations, investments, and acquisitions. "
    'According to information received by "Globes," the size of the round has reached about $10 billion, based on a company valuation of about $100 billion. The round has not closed.'
)
DEAL = 'The ministry today signed an historic agreement with Greece in Tel Aviv for three systems for €3.1 billion ($3.6 billion). It surpasses the $3.5 billion paid by Germany. "Achilles Shield," in Israel.'
BACKLOG = "Elbit Systems reports a new peak in its orders backlog, which reached $32 billion at the end of the second quarter. At the end of 2025 it was $28 billion."
ENTRIES = [
    ("IAI", "IAI", "company", 0), ("Israel Aerospace Industries", "IAI", "company", 0), ("Elbit", "Elbit", "company", 0), ("Estonia", "Estonia", "country", 2), ("אסטוניה", "Estonia", "country", 2),
    ("UK Ministry of Defence", "UK Ministry of Defence", "org", 1), ("MoD UK", "UK Ministry of Defence", "org", 1),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "surface string, name string, kind string, rank int")


def test_amounts(spark):
    cases = [
        (1e10, ROUND, True, False), (1e11, ROUND, True, True), (9.99e8, DEAL, False, False), (3.6e9, DEAL, True, False), (3.1e9, DEAL, True, False), (3.2e10, BACKLOG, True, False),
        (1.5e9, "it is trading at $1.5b valuation", True, True), (1.5e9, "raised $1,5 bn in all", True, False), (1e10, "10 million", False, False), (34500000.0, "paid 34,500,000 dollars", True, False),
        (34500000.0, "paid 134,500,000 dollars", False, False), (34500000.0, "paid 34.500.000 euros", True, False), (2500.0, "2.5k", True, False), (2500.0, "paid 2500.5", False, False),
        (5e6, "5 to 5 million", True, False), (5e6, "15 million", False, False), (3e9, "3 מיליארד שקל", True, False), (3e9, "שווי של 3 מיליארד", True, True), (0.0, "x", True, False), (None, "x", True, False),
        (5.0, "5", False, False), (7e6, None, True, False), (7e6, "", True, False), (7e6, "valuation " + "x" * 60 + " 7 million", True, False), (7e6, "7 million " + "x" * 10 + " valuation", True, False),
    ]
    df = spark.createDataFrame([(i, a, t) for i, (a, t, *_) in enumerate(cases)], "i int, a double, t string").withColumn("g", g.grounded_amount(F.col("a"), F.col("t")))
    got = {r["i"]: (r["g"]["grounded"], r["g"]["valuation"]) for r in df.collect()}
    assert [got[i] for i in range(len(cases))] == [tuple(c[2:]) for c in cases]


def run(spark, entries, text, **event):
    base = dict(event_id=1, item_id=1, kind="other", title="t", summary="", program=None, amount=None, currency=None, parties=[], customer=None, confidence=0.8) | event
    schema = "event_id int, item_id int, kind string, title string, summary string, program string, amount double, currency string, parties array<string>, customer string, confidence double"
    items = spark.createDataFrame([(1, "headline", text, "")], "id int, title string, clean_text string, raw_text string")
    return grounding.ground_events(spark.createDataFrame([tuple(base.values())], schema), items, entries).first()


def test_appointment_has_no_amount_and_no_customer(spark, entries):
    r = run(spark, entries, ROUND, kind="m_and_a", title="מינוי אמיתי נורקין לראש פעילות", amount=1e10, currency="USD", parties=["Anduril", "Amikam Norkin"], customer="Israel Ministry of Defense and IDF", confidence=0.95)
    assert (r["kind"], r["amount"], r["currency"], r["customer"], r["confidence"]) == ("appointment", None, None, None, 0.5)
    assert r["parties"] == ["Anduril", "Amikam Norkin"] and r["dropped"] == ["amount", "customer"]


def test_round_keeps_its_amount(spark, entries):
    r = run(spark, entries, ROUND, kind="m_and_a", title="סבב גיוס הון חדש", amount=1e10, currency="USD", parties=["Anduril"], confidence=0.7)
    assert (r["kind"], r["amount"], r["currency"], r["confidence"], r["dropped"]) == ("investment", 1e10, "USD", 0.7, [])


def test_valuation_backlog_and_names(spark, entries):
    assert run(spark, entries, ROUND, amount=1e11)["dropped"] == ["amount"]
    r = run(spark, entries, BACKLOG, kind="regulation", title="דיווח על שיא במלאי ההזמנות", amount=3.2e10, parties=["Elbit"])
    assert (r["kind"], r["amount"], r["parties"]) == ("financial_results", 3.2e10, ["Elbit"])
    r = run(spark, entries, DEAL, parties=["Israel", "Fictional Corp", "n/a", "", None], customer="Greece", confidence=0.9)
    assert (r["parties"], r["customer"], r["confidence"], r["dropped"]) == (["Israel"], "Greece", 0.5, ["parties:Fictional Corp"])
    for nobody in ("לא צוין", "not specified", "N/A", "unknown"):
        r = run(spark, entries, DEAL, customer=nobody, confidence=0.9)
        assert (r["customer"], r["confidence"], r["dropped"]) == (None, 0.9, [])
    r = run(spark, entries, DEAL + " Israel Aerospace Industries too.", parties=["IAI"], customer="IAI")
    assert (r["parties"], r["customer"]) == (["IAI"], "IAI")


def test_thin_and_missing_sources(spark, entries):
    for item_id in (1, 2, None):
        r = run(spark, entries, "Short.", item_id=item_id, amount=5e8, customer="Short", confidence=None)
        assert (r["amount"], r["customer"], r["confidence"], r["dropped"]) == (None, None, None, ["amount", "customer"])
    r = run(spark, entries, None, kind=None, title=None, summary=None, parties=None)
    assert (r["kind"], r["parties"], r["dropped"]) == ("other", [], [])


def analysis(spark, entries, corpus, summary=None, so_what=None, key_facts=None, entities=None):
    schema = "id int, corpus string, summary string, so_what string, key_facts array<string>, entities array<string>"
    r = grounding.ground_analyses(spark.createDataFrame([(1, corpus, summary, so_what, key_facts, entities)], schema), entries).first()
    return r["summary"], r["so_what"], r["key_facts"], r["entities"]


def test_sentences_with_false_names_and_figures_go(spark, entries):
    text = "The Acme Widget plant opened in 2021. It cost $4,500,000 and has twelve lines. Beta Works supplies it. Gamma Holdings owns Delta Motor Works."
    assert analysis(spark, entries, text, "Acme Widget grew. Ghost Widget Works fell. It opened in 2021. It closed in 1999. It cost $4.5 thousand. It cost $4,500,000. It has 12 USD.")[0] == "Acme Widget grew. It opened in 2021. It cost $4,500,000. It has 12 USD."
    assert analysis(spark, entries, text, None, None, ["Acme Widget opened", "Ghost Inc Works shut", "no name"], ["Beta Works", "Ghost", "acme plant", "", "Estonia", "MoD UK"])[2:] == (["Acme Widget opened", "no name"], ["Beta Works", "acme plant", ""])
    assert analysis(spark, entries, text + " אסטוניה and the Ministry of Defence of UK", entities=["Estonia", "MoD UK", "plant Widget"])[3] == ["Estonia", "MoD UK", "plant Widget"]
    assert analysis(spark, entries, text, so_what="It has competitors such as Beta Works and Ghost Optics. It leads rivals like Nobody Inc.")[1] == "It has competitors such as Beta Works. It leads."
    assert analysis(spark, entries, text, "Delta Motor Works, owned by Gamma Holdings, grew. Beta Works, a part of Acme Widget, too. (MWIR Mid Wave) is a gloss.")[0] == "Delta Motor Works, owned by Gamma Holdings, grew. Beta Works, a, too. (MWIR Mid Wave) is a gloss."
    assert analysis(spark, entries, None, "Any Name Here. plain words.", None, None, ["x"]) == ("plain words.", "", [], [])


def test_figures_behind_others_and_each_pattern_once(spark):
    cases = [
        (5e6, "3 million, then 5 million", True, 11), (3.1e9, "13.1 billion; US$3,1 bn", True, 14), (5e6, "15 million or 5.0 million", False, None), (2e6, "1.2 million", False, None),
        (12300000.0, "12300 k and $12.3MM", True, 1), (4e6, "4 tons, 4 to 4 million", True, 14), (1234567.0, "of 9,1,234,567 parts", True, 6), (7e6, "12,7 million", False, None),
    ]
    df = spark.createDataFrame([(i, a, t) for i, (a, t, *_) in enumerate(cases)], "i int, a double, t string").withColumn("g", g.grounded_amount(F.col("a"), F.col("t")))
    got = {r["i"]: r["g"] for r in df.collect()}
    for i, (_, text, grounded, at) in enumerate(cases):
        assert got[i]["grounded"] == grounded, text
        if grounded:
            assert got[i]["evidence"] == text[max(at - 41, 0):].strip()
    # before, places were written out anew wherever they were used, so that every row compiled each pattern many times
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_instr") <= 10
