"""Groups that hold most rows, cells at every size, and ties at a bound."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lines, mixing, queries, vectors


@pytest.fixture(scope="module")
def repeated(spark):
    """Source a: 1,500 rows of one id and text and 1,000 others; sources b and c of their own."""
    rows = [(7, "w " * 10, "a")] * 1500 + [(1000 + i, "w " * (5 + i % 10), "a") for i in range(1000)]
    rows += [(5000 + i, "w " * 30, "b") for i in range(400)] + [(None, "w w", "c")] * 300 + [(9000 + i, "w " * 90, "c") for i in range(500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)


def test_repeated_rows_take_their_share(repeated):
    rows = mixing.mix_report(repeated).collect()
    taken, target, copies = Counter(), {}, {}
    for r in rows:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
        copies.setdefault((r["doc_id"], r["size"]), []).append(r["copies"])
    for s, t in target.items():
        assert abs(taken[s] - t) < 0.05 * t, (taken[s], t)
    rate = next(r["rate"] for r in rows if r["doc_id"] == 7)
    assert abs(sum(copies[7, 10]) - 1500 * rate) <= 1 and set(copies[7, 10]) <= {int(rate), int(rate) + 1}
    again = mixing.mix_report(repeated.repartition(3)).collect()
    told = lambda rs: Counter((r["doc_id"], r["size"], r["copies"]) for r in rs)
    assert told(rows) == told(again)


def test_mix_takes_what_the_report_says(repeated):
    wide = repeated.withColumns({"key": F.lit(1), "nth": F.lit(2), "row": F.lit(3), "again": F.lit(4)})
    out = mixing.mix(wide)
    assert out.columns == wide.columns
    told = Counter()
    for r in mixing.mix_report(repeated).collect():
        told[r["doc_id"], r["size"]] += r["copies"]
    assert Counter((r["doc_id"], len(r["text"].split())) for r in out.collect()) == +told


@pytest.fixture(scope="module")
def site(spark):
    """Nine of ten pages on one host, with lines held by just 5 %, by more, and by few."""
    rows = [(i, f"http://{'hot' if i % 10 else 'x%d' % (i % 50)}.org/{i}", f"menu\nown {i}\n" + ("share\n" if i % 20 == 1 else "") + ("more\n" if i % 15 == 1 else "") + "last") for i in range(2000)]
    rows += [(3000, None, "menu"), (3001, "no address", None), (3002, None, "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


@pytest.mark.parametrize("part_pages", [1, 50, 10**6])
def test_a_hot_host_is_parted(site, part_pages):
    told = sorted((tuple(r) for r in lines.line_report(site).collect()), key=str)
    assert sorted((tuple(r) for r in lines.line_report(site, max_broadcast=0, part_pages=part_pages).collect()), key=str) == told


def test_a_line_on_just_the_share_stays(spark):
    rows = [(i, "http://a.org/", f"own {i}\n" + ("five\n" if i < 5 else "") + ("six" if i < 6 else "")) for i in range(100)]
    text = "\n".join(r["text"] for r in lines.line_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert "five" in text and "six" not in text


def test_cells_at_every_size(spark, monkeypatch):
    called = []
    plain = vectors.spherical_kmeans
    monkeypatch.setattr(vectors, "spherical_kmeans", lambda sample, k, *a, **b: called.append((len(sample), k)) or plain(sample, k, *a, **b))
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/embeddings.parquet").select("label").distinct().count()
    queries.op3_vectors(spark, sf).count()
    assert len(called) == labels and all(k >= 2 for _, k in called)


def test_cells_follow_the_root():
    import pandas as pd

    v = [np.array([np.cos(i), np.sin(i)]) for i in range(1000)]
    sample = pd.DataFrame({"label": ["a"] * 900 + ["b"] * 99 + ["c"], "v": v})
    few, many, most = ({k: len(c) for k, c in vectors.codebooks(sample, n).items()} for n in (1000, 10**6, 10**12))
    assert few == {("a", 2): 2, ("b", 2): 2} and many == {("a", 2): 59, ("b", 2): 19} and most == {("a", 2): 180, ("b", 2): 19}
