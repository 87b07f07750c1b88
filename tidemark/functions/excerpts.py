"""Excerpts of long texts around the words that were asked for, under a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters kept of a text's head, on either side of a place found, and between windows that are joined.
HEAD, PAD, NEAR = 1200, 600, 40
GAP = "\n[...]\n"


def places(text: Column, word: Column) -> Column:
    """Where a word begins in a text, from 0, without overlaps; an empty word begins nowhere."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda s, p: F.struct((s["at"] + F.length(p) + F.length(word)).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p))).alias("found"))
    # the last piece has no word behind it
    return F.when(word == "", F.array().cast("array<int>")).otherwise(F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step)["found"])


def excerpt(text: Column, anchors: Column, budget: int) -> Column:
    """At most `budget` characters of a text: its head, and windows around the anchors, an array of words, in any case.

    Every anchor gets a window before any gets a second; of one round the anchor that is rarest in this text comes first, then
    the one that comes first in the array. A window is 600 characters on either side; one that an earlier one covers is
    passed over, the last is cut where the budget ends. Windows are joined where 40 characters or less lie between them. A
    text without any anchor gives its first characters, a null text null; null and empty anchors are none.
    """
    low, size = F.lower(text), F.length(text)
    asked = F.filter(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != ""))
    found = F.transform(F.array_distinct(asked), lambda a, i: F.struct(i.alias("i"), places(low, F.lower(a)).alias("p")))
    every = F.flatten(F.transform(found, lambda f: F.transform(f["p"], lambda p, k: F.struct(k.alias("round"), F.size(f["p"]).alias("n"), f["i"].alias("i"), p.alias("p")))))
    head = F.least(F.lit(min(HEAD, budget // 3)), size)
    window = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))

    def step(state: Column, c: Column) -> Column:
        s, left = F.greatest(c["p"] - PAD, F.lit(0)), F.lit(budget) - state["used"]
        e = F.least(size, c["p"] + PAD, s + left)
        full = F.least(size, c["p"] + PAD)
        covered = F.exists(state["kept"], lambda w: (w["s"] <= s) & (full <= w["e"]))
        taken = F.struct((state["used"] + e - s).cast("int").alias("used"), F.concat(state["kept"], F.array(window(s, e))).alias("kept"))
        return F.when((left <= 0) | covered, state).otherwise(taken)

    kept = F.aggregate(F.array_sort(every), F.struct(head.cast("int").alias("used"), F.array(window(F.lit(0), head)).alias("kept")), step)["kept"]

    def join(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(window(last["s"], F.greatest(last["e"], w["e"]))))
        return F.when((F.size(done) > 0) & (w["s"] <= last["e"] + NEAR), longer).otherwise(F.concat(done, F.array(w)))

    merged = F.aggregate(F.array_sort(kept), F.filter(kept, lambda w: F.lit(False)), join)
    told = F.array_join(F.transform(merged, lambda w: F.substring(text, w["s"] + 1, w["e"] - w["s"])), GAP)
    return F.when(F.size(every) > 0, F.substring(told, 1, budget)).otherwise(F.substring(text, 1, budget))
