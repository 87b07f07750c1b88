"""A sweep after each of three changes beside records reckoned anew; literal cases of the rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions.keys import COMMON_NAMES
from tidemark.operators import corroboration as c
from tidemark.operators import meetings
from tidemark.plans.corroborated import outlets

ITEM = "id long, host string, domain string, at timestamp, entities array<string>, dedup_of long, official boolean, in_scope boolean"
EVENT = "item_id long, kind string, customer string, program string, amount double"


def day(n):
    return dt.datetime(2026, 3, 1) + dt.timedelta(days=n)


def test_rules(spark):
    both = ["Elbit", "Sigma"]
    items = [
        (1, "a.com", "eo", day(0), both, None, True, True), (2, "b.com", "eo", day(7), both, None, False, True), (3, "a.com", "eo", day(1), both, None, False, True), (4, "d.com", "ew", day(0), both, 1, False, True),
        (5, "e.com", "eo", day(15), both, None, False, True), (6, "f.com", "eo", day(0), ["Elbit", "us army"], None, True, True), (7, None, "eo", day(0), both, None, False, True), (8, None, "eo", day(1), both, None, False, True),
        (9, "g.com", None, day(0), both, None, False, True), (10, "h.com", "eo", None, both, None, False, True), (11, "i.com", "eo", day(0), both, None, False, False), (12, "j.com", "eo", day(0), None, None, False, True),
    ]
    events = [(i, "award", "Greece", None, 0.0) for i in (1, 3, 5, 6, 9, 10, 12)] + [(2, "award", " greece ", "x", 5.0), (7, "award", None, None, 100.0), (8, "award", "", "", 90.0), (11, "award", None, None, 89.0), (2, "", "Greece", None, None)]
    found = {r["id"]: (r["status"], r["others"]) for r in c.records(spark.createDataFrame(items, ITEM), spark.createDataFrame(events, EVENT)).collect()}
    assert found == {
        1: ("corroborated", [2, 4]), 2: ("corroborated", [1, 3]), 3: ("corroborated", [2]), 4: ("corroborated", [1]), 5: ("single_source", []), 6: ("official_primary", []),
        7: ("corroborated", [8]), 8: ("corroborated", [7, 11]), 9: ("unknown", []), 10: ("unknown", []), 12: ("single_source", []),
    }


def test_a_sweep_equals_records_anew(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    told = lambda df: sorted((r["id"], r["status"], tuple(r["others"])) for r in df.collect())
    first = events.where("event_id % 10 < 7")
    state = c.records(*outlets(first))
    more = events.where("event_id % 10 < 9")
    gone = more.where("event_id % 23 <> 5")
    moved = gone.withColumns({"ts": F.when(F.col("event_id") % 19 == 2, F.expr("ts + INTERVAL 9 DAYS")).otherwise(F.col("ts")), "value": F.when(F.col("event_id") % 17 == 3, F.col("value") * 3).otherwise(F.col("value"))})
    changes = (more, "event_id % 10 BETWEEN 7 AND 8"), (gone, "event_id % 23 = 5"), (moved, "event_id % 19 = 2 OR event_id % 17 = 3")
    for now, which in changes:
        ids = events.where(which).select(F.col("event_id").alias("id"))
        state = spark.createDataFrame(c.sweep(state, *outlets(now), ids).collect(), state.schema)
        assert told(state) == told(c.records(*outlets(now)))


def test_common_names_count_only_among_three(spark):
    rows = [(1, "a.com", ["NATO", "idf", "Sigma"]), (2, "b.com", ["NATO", "idf", "Sigma"]), (3, "c.com", ["NATO", "Sigma"]), (4, "d.com", ["Sigma", None, "Elbit"]), (5, "e.com", ["Elbit", "Elbit", "Sigma", None])]
    items = spark.createDataFrame([(i, h, "eo", day(0), e, None, False, True) for i, h, e in rows], ITEM)
    events = spark.createDataFrame([(i, "award", "Greece", " G ", 5.0) for i, *_ in rows], EVENT)
    assert sorted(tuple(r) for r in c.pairs(items, events).collect()) == [(1, 2), (2, 1), (4, 5), (5, 4)]


def test_a_sweep_reckons_records_once(spark):
    """What a change touches is written before the steps that read it."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    state = c.records(*outlets(events.where("event_id % 10 < 9")))
    swept = c.sweep(state.sparkSession.createDataFrame(state.collect(), state.schema), *outlets(events), events.where("event_id % 10 = 9").select(F.col("event_id").alias("id")))
    assert len([p for p in swept.inputFiles() if "/touched/" in p]) > 0


def plain(items, events):
    """For each id the others that bear it out, by comparing all with all."""
    names = lambda e: {n for n in e or () if n is not None}
    rare = lambda n: n.strip().lower() not in COMMON_NAMES
    close = lambda a, b: a is not None and b is not None and (a == b if a == 0 or b == 0 else abs(a - b) <= 0.1 * max(abs(a), abs(b)))
    told = {}
    for i, kind, customer, program, amount in events:
        if kind:
            told.setdefault(i, []).append((kind, (customer or "").strip().lower(), (program or "").strip().lower(), amount))
    found = {i[0]: set() for i in items}
    for a in items:
        for b in items:
            if a[0] == b[0] or None in (a[2], a[3], b[2], b[3]) or abs(a[3] - b[3]) > dt.timedelta(days=7) or a[1] == b[1] is not None:
                continue
            shared = names(a[4]) & names(b[4])
            enough = a[2] == b[2] and (len(shared) >= 3 or sum(map(rare, shared)) >= 2)
            same = any(x[0] == y[0] and (x[1] == y[1] != "" or x[2] == y[2] != "" or close(x[3], y[3])) for x in told.get(a[0], ()) for y in told.get(b[0], ()))
            if (a[5] or a[0]) == (b[5] or b[0]) or enough and same:
                found[a[0]].add(b[0])
    return {i: sorted(o) for i, o in found.items()}


@pytest.mark.parametrize("small", [False, True])
def test_cells_in_parts_beside_all_with_all(spark, monkeypatch, small):
    """Few names and amounts, so that nearly every rule meets; small: many cells, whose lists and others are in parts."""
    r = random.Random(3)
    if small:
        monkeypatch.setattr(c, "CELL_MINE", 9)
        monkeypatch.setattr(c, "CELL_OTHERS", 25)
        monkeypatch.setattr(meetings, "AT_ONCE", 20)
    some = ["Elbit", "Sigma", "Orbit", "nato", "IDF ", "DoD", None]
    items = [
        (i, r.choice(["a.com", "b.com", "c.com", None]), r.choice(["eo", "eo", "ew", None]), None if i % 17 == 0 else day(r.choice([0, 6, 7, 8, 13, 14, 22])) + dt.timedelta(microseconds=r.randrange(3)),
         None if i % 19 == 0 else r.choices(some, k=r.randrange(12)), r.randrange(1, 150) if i % 5 == 0 else None, i % 7 == 0, i % 11 != 0)
        for i in range(1, 150)
    ]
    numbers = [0.0, -0.0, 90.0, 100.0, 111.2, -100.0, -95.0, None, 3e-300]
    events = [(r.randrange(1, 160), r.choice(["award", "award", "test", "", None]), r.choice(["Greece", " greece", "", None, "x"]), r.choice([None, "P", "p ", "q", " "]), r.choice(numbers)) for _ in range(400)]
    want = plain(items, events)
    df, told = spark.createDataFrame(items, ITEM), spark.createDataFrame(events, EVENT)
    found = {x["id"]: (x["status"], x["n"], x["others"]) for x in c.records(df, told).collect()}
    status = lambda i: "unknown" if None in (i[2], i[3]) else "corroborated" if want[i[0]] else "official_primary" if i[6] else "single_source"
    assert found == {i[0]: (status(i), len(want[i[0]]), want[i[0]]) for i in items if i[7]}
    asked = spark.createDataFrame([(i,) for i in range(0, 150, 4)], "id long")
    assert sorted(map(tuple, c.pairs(df, told, asked).collect())) == sorted((i, o) for i, others in want.items() if i % 4 == 0 for o in others)
    assert sum(map(len, want.values())) > 150


def test_pairs_are_not_exchanged(spark):
    """What is listed for an item stays in the task that found it: rows are exchanged below it, nothing above it."""
    plan = c.records(*outlets(spark.read.parquet("/root/testdata/sf0.001/events.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_ids_of_any_type(spark):
    both = ["Elbit", "Sigma"]
    items = spark.createDataFrame([("b", "a.com", "eo", day(0), both, None, False, True), ("a", "b.com", "eo", day(1), both, None, False, True), ("c", "c.com", "eo", day(2), [], "b", False, True)], ITEM.replace("long", "string"))
    events = spark.createDataFrame([(i, "award", "Greece", None, None) for i in "ab"], EVENT.replace("long", "string"))
    assert {x["id"]: x["others"] for x in c.records(items, events).collect()} == {"a": ["b"], "b": ["a", "c"], "c": ["b"]}


def test_the_sweeps_query_writes_no_lists(spark):
    """The records before the change are lists of pairs: they are read as they are made."""
    files = plans.QUERIES["corroboration_sweep"](spark, "/root/testdata/sf0.001").inputFiles()
    assert any("/touched/" in f for f in files) and not any("/records/" in f for f in files)
