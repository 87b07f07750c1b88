"""Clusters of like texts beside a plain pass over dictionaries, with odd rows and whole tables."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import clusters
from tidemark.plans.patents import TOPICS

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\W_][\w-]+")


def weights(lists):
    df = Counter(t for terms in lists for t in set(terms))
    return [{t: n * (math.log((len(lists) + 1) / (df[t] + 1)) + 1) for t, n in Counter(terms).items()} for terms in lists]


def plain(lists, most=5, least=0.15):
    """The cluster of each list of terms, centroids as means, and the terms of most weight."""
    found, members = [], []
    for v in weights(lists):
        norm = lambda x: math.sqrt(sum(w * w for w in x.values()))
        likeness = []
        for m in members:
            mean = defaultdict(float)
            for x in m:
                for t, w in x.items():
                    mean[t] += w / len(m)
            dot = sum(w * mean[t] for t, w in v.items() if t in mean)
            likeness.append(round(dot / (norm(v) * norm(mean)), 12) if dot else 0.0)
        best = max(range(len(members)), key=lambda i: (likeness[i], -i), default=None)
        if best is not None and (likeness[best] >= least or len(members) >= most):
            members[best].append(v)
        else:
            best = len(members)
            members.append([v])
        found.append(best)
    labels = []
    for m in members:
        sums = Counter()
        for x in m:
            sums.update(x)
        labels.append([t for t, _ in sorted(((t, round(w, 9)) for t, w in sums.items()), key=lambda p: (-p[1], p[0]))[:3]])
    return found, labels


def test_leaders_and_labels(spark):
    rows = [("a", 1, ["laser", "beam", "laser"]), ("a", 2, []), ("a", 3, ["laser", "beam"]), ("a", 4, ["gear"]), ("a", 5, ["gear", "oil"]), ("a", 6, ["beam", "gear"]), ("a", 7, ["x1"]), ("a", 8, ["x2"]), ("a", 9, ["x3"])]
    rows += [("a", 10, []), ("b", 1, ["laser"]), ("b", 2, ["laser"]), (None, 1, ["solo"]), (None, 2, [])]
    weighted = clusters.term_weights(spark.createDataFrame(rows, "part string, id int, terms array<string>"))
    found = clusters.leaders(weighted)
    got = {(r["part"], r["id"]): r["cluster"] for r in found.collect()}
    named = {(r["part"], r["cluster"]): r["terms"] for r in clusters.label_terms(weighted, found).collect()}
    for part in ("a", "b", None):
        of, labels = plain([t for p, _, t in rows if p == part])
        assert [got[part, i] for p, i, _ in rows if p == part] == of
        assert {c: t for (p, c), t in named.items() if p == part} == {c: t for c, t in enumerate(labels) if t}


def test_topics(spark):
    df = spark.createDataFrame([(["a1", "b1", "b2"],), (["a1", "a2", "b1", "b2"],), (["a1"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(clusters.topic_of(F.col("w"), {"A": ("a1", "a2"), "B": ("b1", "b2")})).collect()] == ["B", "A", None, None, None]


@pytest.mark.parametrize("name", ["patent_clusters", "text_clusters"])
def test_whole_tables(spark, name):
    docs = sorted((r["doc_id"], r["source"], WORDS.findall((r["text"] or "").lower())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = plans.QUERIES[name](spark, SF).collect()
    if name == "patent_clusters":
        told, rest = {}, []
        for i, _, w in docs:
            best = max(((len(set(w) & set(some)), -k, topic) for k, (topic, some) in enumerate(TOPICS.items())))
            told[i] = f"C{i % 7}" if i % 4 == 0 else best[2] if best[0] >= 2 else rest.append((i, w))
        of, _ = plain([w for _, w in rest])
        told |= {i: f"rest_{c}" for (i, _), c in zip(rest, of, strict=True)}
        assert rest and {r["id"]: r["cluster"] for r in rows} == told
    else:
        told = []
        for source in {s for _, s, _ in docs}:
            of, labels = plain([w for _, s, w in docs if s == source])
            told += [(source, c, n, " ".join(labels[c])) for c, n in Counter(of).items()]
        assert sorted(tuple(r) for r in rows) == sorted(told)


def test_no_patents(spark):
    none = spark.createDataFrame([], "id int, classes array<string>, text string")
    assert clusters.clustered(none, TOPICS).count() == 0


def test_texts_are_exchanged_once(spark):
    df = spark.createDataFrame([(1, i, ["a", "b", "a"]) for i in range(9)] + [(1, 9, None)], "part int, id int, terms array<string>")
    plan = clusters.term_weights(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and plan.count("ENSURE_REQUIREMENTS") == 1  # the latter of the number of texts only


def test_groups_need_no_clusters(spark):
    assert "MapInArrow" not in plans.QUERIES["patent_groups"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_part_is_read_in_runs(spark, monkeypatch):
    """No task reads a whole part; what the runs leave to each other gives the clusters of a plain pass."""
    import random

    r = random.Random(7)
    lists = {p: [r.choices([f"t{i}" for i in range(40)], k=r.randrange(6)) for _ in range(n)] for p, n in (("a", 60), ("b", 9), (None, 30))}
    rows = [(p, i, terms) for p, some in lists.items() for i, terms in enumerate(some)]
    weighted = clusters.term_weights(spark.createDataFrame(rows, "part string, id int, terms array<string>"))
    monkeypatch.setattr(clusters, "RUN_TERMS", 40)
    monkeypatch.setattr(clusters, "SUM_TERMS", 7)
    sizes = [x["n"] for x in clusters._runs(weighted).groupBy("part", "round").agg(F.sum(F.size("weights") + 1).alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 120
    got = {(x["part"], x["id"]): x["cluster"] for x in clusters.leaders(weighted).collect()}
    assert got == {(p, i): c for p, some in lists.items() for i, c in enumerate(plain(some)[0])}


@pytest.mark.parametrize("chars", [None, 90])
def test_summaries_beside_a_plain_pass(spark, monkeypatch, chars):
    """Sums that rounds of texts leave to each other; terms of one text, which may name a cluster; empty texts, null parts and equal weights."""
    import random

    r = random.Random(11)
    if chars:
        monkeypatch.setattr(clusters, "RUN_CHARS", chars)
        monkeypatch.setattr(clusters, "AT_ONCE", 5)
        monkeypatch.setattr(clusters, "MOST_TASKS", 2)
    lists = {p: [r.choices([f"t{i}" for i in range(25)] + ["own" + str(r.random())[2:]] * 3, k=r.randrange(7)) for _ in range(n)] for p, n in (("a", 60), ("b", 9), (None, 30), ("c", 1))}
    rows = [(p, i, " ".join(terms).upper() if i % 2 else None if not terms else " ".join(terms)) for p, some in lists.items() for i, terms in enumerate(some)]
    texts = spark.createDataFrame(rows, "part string, id int, text string")
    if chars:
        bounds = clusters._rounds(texts.select(F.coalesce(F.ascii("part"), F.lit(0)).alias("nth"), "id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars")))
        assert bounds.agg(F.max("round")).first()[0] >= 3
    want = []
    for p, some in lists.items():
        of, labels = plain(some)
        want += [(p, c, n, labels[c]) for c, n in Counter(of).items()]
    key = lambda x: (x[0] or "", x[1])
    assert sorted(map(tuple, clusters.summaries(texts).collect()), key=key) == sorted(want, key=key)
    assert any("own" in t for *_, labels in want for t in labels)


def test_text_clusters_write_no_weights(spark):
    """Of each text neither weights nor terms are written, and none is weighed by an exchange of its terms."""
    df = plans.QUERIES["text_clusters"](spark, SF)
    assert not any("/weights/" in f for f in df.inputFiles()) and any("/leaders/" in f for f in df.inputFiles())
    assert clusters.summaries(spark.createDataFrame([], "part string, id long, text string")).collect() == []
