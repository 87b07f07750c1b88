"""The graph of customers and suppliers that orders make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, rank
from .registry import query

_EDGES = """SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, o_orderpriority AS label, o_orderkey AS item, o_orderdate AS seen FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
_BOTH = f"e AS ({_EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def edges(t):
    o, li = t("orders"), t("lineitem").select("l_orderkey", "l_suppkey")
    e = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return e.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("seen"))


@query(f"WITH {_BOTH} SELECT src AS node, count(*)::BIGINT AS links FROM u GROUP BY src HAVING count(*) >= 3")
def graph_degrees(t):
    return graph.degrees(edges(t), 3)


@query(f"""WITH {_BOTH}, h1 AS (SELECT DISTINCT dst AS node FROM u WHERE src = 'c1'), h2 AS (SELECT DISTINCT u.dst AS node FROM u JOIN h1 ON u.src = h1.node WHERE u.dst <> 'c1' AND u.dst NOT IN (SELECT node FROM h1))
SELECT 'c1' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def graph_neighbors_depth2(t):
    e = edges(t)
    return graph.reach(e, e.sparkSession.range(1).select(F.lit("c1").alias("node")), 2)


@query(f"""WITH e AS ({_EDGES}), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, label ORDER BY seen DESC, item DESC) AS nth FROM e)
SELECT src, dst, label, count(*)::BIGINT AS weight, min(seen)::TIMESTAMP AS first_seen, max(seen)::TIMESTAMP AS last_seen, string_agg(item::VARCHAR, ',' ORDER BY nth) FILTER (WHERE nth <= 3) AS evidence FROM r GROUP BY 1, 2, 3""")
def edge_aggregate_evidence(t):
    return graph.summarise(edges(t))


@query(f"""WITH e AS ({_EDGES}), a AS (SELECT src, dst FROM e WHERE label LIKE '1%' AND src IN ('c1', 'c2', 'c3', 'c4', 'c5')), b AS (SELECT src, dst FROM e WHERE label LIKE '2%')
SELECT DISTINCT a.src, b.src AS dst FROM a JOIN b ON a.dst = b.dst WHERE a.src <> b.src""")
def two_hop_typed(t):
    e = edges(t)
    first = e.where(F.col("label").startswith("1") & F.col("src").isin("c1", "c2", "c3", "c4", "c5"))
    return graph.two_hops(first, e.where(F.col("label").startswith("2"))).where(F.col("src").isin("c1", "c2", "c3", "c4", "c5"))


@query(f"""WITH RECURSIVE {_BOTH}, p AS (SELECT 'c1' AS node, ['c1'] AS path, 0 AS hops UNION ALL SELECT node, path, hops FROM (SELECT u.dst AS node, list_append(p.path, u.dst) AS path, p.hops + 1 AS hops, row_number() OVER (PARTITION BY u.dst ORDER BY list_append(p.path, u.dst)) AS nth FROM p JOIN u ON u.src = p.node WHERE p.hops < 4 AND NOT list_contains(p.path, u.dst)) WHERE nth = 1)
SELECT hops, array_to_string(path, '>') AS path FROM p WHERE node = 'c40' ORDER BY hops, p.path LIMIT 1""")
def shortest_path(t):
    return graph.shortest_path(edges(t), "c1", "c40").select("hops", F.array_join("path", ">").alias("path"))


@query(f"""WITH e AS ({_EDGES}), top AS (SELECT src FROM e WHERE seen >= TIMESTAMP '1997-01-01' GROUP BY src ORDER BY count(*) DESC, src LIMIT 25)
SELECT e.src, e.dst, count(*)::BIGINT AS n FROM e JOIN top USING (src) GROUP BY 1, 2""")
def graph_overview(t):
    e = edges(t)
    hot = rank.top(e.where(F.col("seen") >= F.lit("1997-01-01").cast("timestamp")).groupBy("src").agg(F.count("*").alias("m")), 25, F.col("m").desc_nulls_last(), F.col("src"))
    return e.join(F.broadcast(hot.select("src")), "src").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"""WITH e AS ({_EDGES}), a AS (SELECT DISTINCT src, dst FROM e) SELECT x.src AS a, y.src AS b, count(*)::BIGINT AS shared FROM a x JOIN a y ON x.dst = y.dst AND x.src < y.src WHERE x.src = 'c1' OR y.src = 'c1' GROUP BY 1, 2""")
def cluster_cross_links(t):
    a = edges(t).select("src", "dst").distinct()
    mine = a.where("src = 'c1'").select("dst")
    other = a.join(mine, "dst", "left_semi").where("src <> 'c1'")
    return other.groupBy(F.least("src", F.lit("c1")).alias("a"), F.greatest("src", F.lit("c1")).alias("b")).agg(F.count("*").alias("shared"))
