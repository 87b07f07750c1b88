"""Dossiers on literal cases, and the assignment beside one pass in order."""

import random

from pyspark.sql import functions as F

from tidemark.operators import dossiers

SPEC = "product string, id int, key string, name string, value string"


def specs(spark, previous, current, cited=True):
    now = spark.createDataFrame([(*r, cited) for r in current], SPEC + ", cited boolean")
    return sorted(tuple(r)[1:3] for r in dossiers.spec_changes(spark.createDataFrame(previous, SPEC), now).collect())


def test_specs_by_key(spark):
    old = [("p", 1, "mass", "Mass", "12 kg"), ("p", 2, "range", "Range", "10 km in clear air"), ("p", 3, "zoom", "Zoom", "x30"), ("p", 4, "mass", "again", "1 kg")]
    new = [("p", 1, "mass", "Weight", "12 KG "), ("p", 2, "range", "Range", "12 km at night only"), ("p", 3, "zoom", "Zoom", ""), ("p", 5, "price", "Price", "5"), ("p", 6, "gone", "x", ""), ("q", 7, "mass", "Mass", "1")]
    assert specs(spark, old, new) == [(2, "changed"), (3, "retracted"), (5, "new")]
    assert specs(spark, old, new, cited=False) == []


def test_specs_by_likeness(spark):
    old = [("p", 1, "", "optical load in a compact case", "three sensors"), ("p", 2, None, "detector pitch", "ten micron of mercury"), ("p", 3, "", "thermal range", "***"), ("p", 4, "", "same same", None)]
    new = [("p", 11, "a", "optical load compact", "four of them"), ("p", 12, "b", "pixel size", "ten micron mercury"), ("p", 13, "c", "unlike", "***"), ("p", 14, "d", "wholly new", "1"), ("p", 15, "e", "optical load in case", "three sensors")]
    assert specs(spark, old, new) == [(11, "new"), (14, "new")]  # the nearer name takes the first row, and no row is taken twice


def test_deals(spark):
    schema = "product string, id int, customer string, amount double, kind string, date string"
    old = [("p", 1, "Greek Army", 5.0, "sale", None), ("p", 2, "—", 7.0, "sale", "2026"), ("p", 3, "Acme", 9.0, "lease", None), ("p", 4, None, None, None, None)]
    new = [("p", 1, "greek-army", 5.001, "sale", "2026"), ("p", 2, "Real Name", 7.0, "sale", "2027"), ("p", 3, "Beta", 9.0, "lease", "2026"), ("p", 4, "n/a", 9.0, "lease", "2026"), ("p", 5, "", None, None, None), ("q", 6, "x", 1.0, "sale", None)]
    now = spark.createDataFrame([(*r, True) for r in new], schema + ", cited boolean")
    assert sorted(tuple(r)[1:] for r in dossiers.deal_changes(spark.createDataFrame(old, schema), now).collect()) == [(1, "dated"), (3, "new"), (4, "dated")]


def test_assignment_is_that_of_one_pass(spark):
    rng = random.Random(3)
    pairs = sorted({(f"p{rng.randrange(3)}", rng.randrange(30), rng.randrange(30)) for _ in range(900)})
    scored = [(*p, rng.choice([0.6, 0.75, 1.5, 2.0])) for p in pairs]
    got = sorted(tuple(r) for r in dossiers.assigned(spark.createDataFrame(scored, "product string, a int, b int, score double")).collect())
    told, a_used, b_used = [], set(), set()
    for p, a, b, _ in sorted(scored, key=lambda x: (-x[3], x[2], x[1])):
        if (p, a) not in a_used and (p, b) not in b_used:
            told.append((p, a, b))
            a_used.add((p, a))
            b_used.add((p, b))
    assert got == sorted(told)


def test_a_word_in_every_row_makes_no_pairs(spark):
    rows = [("p", i, "", f"the parameter of x{i} y{i} z{i} u{i}", f"v{i} w{i}") for i in range(300)]
    df = spark.createDataFrame(rows, SPEC)
    assert sorted((r["a"], r["b"]) for r in dossiers.like_pairs(df, df).collect()) == [(i, i) for i in range(300)]
    assert dossiers.assigned(dossiers.like_pairs(df, df.where("false"))).count() == 0


def test_rows_are_made_once(spark):
    """Before, each of the many uses of a run's rows made them anew from what they come from."""
    rows = spark.createDataFrame([(1, 1, "Range of it", "10 km")], "product int, id int, name string, value string")
    made = rows.withColumn("value", F.concat("value", F.lit(" madeonce")))
    pairs = dossiers.like_pairs(made, made)
    assert "madeonce" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["a"], r["b"], r["score"]) for r in pairs.collect()] == [(1, 1, 2.0)]
