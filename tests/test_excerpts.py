"""Excerpts beside a plain search, on long texts, ties, odd anchors and small budgets."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import excerpts


def plain(text, anchors, budget):
    if text is None:
        return None
    found = {}
    for a in anchors or []:
        if a and a not in found:
            found[a] = [m.start() for m in re.finditer(re.escape(a.lower()), text.lower())]
    order = sorted((len(p), i, p) for i, p in enumerate(found.values()) if p)
    if not order:
        return text[:budget]
    kept = [(0, min(1200, budget // 3, len(text)))]
    used = kept[0][1]
    for k in range(max(n for n, _, _ in order)):
        for n, _, p in order:
            if k >= n or used >= budget:
                continue
            s, e = max(0, p[k] - 600), min(len(text), p[k] + 600)
            if any(a <= s and e <= b for a, b in kept):
                continue
            e = min(e, s + budget - used)
            kept.append((s, e))
            used += e - s
    merged = []
    for s, e in sorted(kept):
        if merged and s <= merged[-1][1] + 40:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return "\n[...]\n".join(text[s:e] for s, e in merged)[:budget]


def test_excerpts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)] + ["UAS", "a.b", "\\E", "(x", "Ärger"]
    rows = [(None, ["w1"]), ("", ["w1"]), ("short text", ["nothing"]), ("short text", None), ("short text", ["", None]), ("aaaa" * 900, ["aa", "AAA"]), ("x" * 5000 + "needle" + "y" * 5000, ["NEEDLE"])]
    for _ in range(40):
        rows.append((" ".join(rng.choice(words) for _ in range(rng.choice([10, 300, 2500]))), [rng.choice([*words, "uas", "absent"]) for _ in range(rng.randrange(6))]))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, a array<string>")
    for budget in (100, 1500, 4000):
        got = {r["i"]: r["x"] for r in df.select("i", excerpts.excerpt(F.col("t"), F.col("a"), budget).alias("x")).collect()}
        for i, (t, a) in enumerate(rows):
            assert got[i] == plain(t, a, budget), (i, budget, a)
