"""Orders, parts and customers: facets, matrices, tiers, states, versions, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import match, rank
from .registry import query

AS_OF = "1998-06-01"


@query("""SELECT p_brand AS brand, p_type AS type, count(DISTINCT p_partkey)::BIGINT AS parts, count(*)::BIGINT AS lines FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2""")
def brand_type_matrix(t):
    lines = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("lines"))
    p = t("part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    return p.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(F.count("*").alias("parts"), F.sum("lines").alias("lines"))


@query("""WITH b AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10), y AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 10)
SELECT b.p_brand AS brand, y.p_type AS type, count(p.p_partkey)::BIGINT AS n FROM b CROSS JOIN y LEFT JOIN part p ON p.p_brand = b.p_brand AND p.p_type = y.p_type GROUP BY 1, 2""")
def dense_matrix(t):
    """Ten brands by ten types, zeros included: the grid is built from two lists of ten."""
    p = t("part")
    ten = lambda c: rank.top(p.groupBy(c).agg(F.count("*").alias("n")), 10, F.col("n").desc_nulls_last(), F.col(c)).select(c)
    types = ten("p_type").agg(F.sort_array(F.collect_list("p_type")).alias("types"))
    grid = ten("p_brand").withColumn("p_type", F.explode(types.scalar()))
    counts = p.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return grid.join(counts, ["p_brand", "p_type"], "left").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH b AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10), y AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 10)
SELECT b.p_brand AS brand, y.p_type AS type FROM b CROSS JOIN y WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = b.p_brand AND p.p_type = y.p_type AND p.p_size >= 45 AND p.p_retailprice >= 910)""")
def white_space(t):
    seen = t("part").where("p_size >= 45 AND p_retailprice >= 910").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return dense_matrix(t).select("brand", "type").join(seen, ["brand", "type"], "left_anti")


@query("""SELECT p_brand AS brand, p_type AS type, p_size AS size, grouping(p_brand)::INT + grouping(p_type)::INT + grouping(p_size)::INT AS level, count(*)::BIGINT AS n FROM part GROUP BY ROLLUP (p_brand, p_type, p_size)""")
def tree_rollup(t):
    names = [F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size")]
    r = t("part").select(*names).rollup("brand", "type", "size").agg((F.grouping("brand") + F.grouping("type") + F.grouping("size")).cast("int").alias("level"), F.count("*").alias("n"))
    return r


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT a.s AS a, b.s AS b, count(*)::BIGINT AS n FROM s a JOIN s b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 3""")
def co_occurrence_pairs(t):
    s = t("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    per = s.groupBy("o").agg(F.sort_array(F.collect_list("s")).alias("all"))  # suppliers of one order
    pairs = per.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 3")


@query("""SELECT n_name AS country, count(DISTINCT c_custkey)::BIGINT AS customers, count(o_orderkey)::BIGINT AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS open FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def country_rollup(t):
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open"))
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return c.groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("customers"), n("orders").alias("orders"), F.round(n("total"), 2).alias("total"), n("open").alias("open"))


@query("""SELECT country, c_custkey, c_acctbal, place::INT AS place FROM (SELECT n_name AS country, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey DESC) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE place <= 3""")
def country_top3(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey").desc_nulls_last())
    return c.withColumn("place", F.row_number().over(w)).where("place <= 3").select(F.col("n_name").alias("country"), "c_custkey", "c_acctbal", "place")


@query("""SELECT o_custkey, o_orderkey, o_orderdate::TIMESTAMP AS o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_version(t):
    return rank.latest(t("orders"), ["o_custkey"], F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc_nulls_last()).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("""SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey, count(*)::BIGINT AS n FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority) AS newest FROM orders) WHERE o_orderdate = newest GROUP BY 1, 2""")
def latest_by_two_keys(t):
    newest = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderdate").alias("newest"))
    o = t("orders").join(newest, ["o_custkey", "o_orderpriority"]).where("o_orderdate = newest")
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderkey").alias("o_orderkey"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, CASE WHEN o_orderstatus = 'O' THEN o_orderdate END ASC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 200""")
def business_rank_listing(t):
    s = F.col("o_orderstatus")
    order = (F.when(s == "O", 0).when(s == "P", 1).otherwise(2), F.when(s == "O", F.col("o_orderdate")).asc_nulls_last(), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey"))
    return rank.top(t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"), 200, *order).select("o_orderkey", "o_orderstatus")


@query(f"""WITH s AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 WHEN o_totalprice > 0 THEN 1 ELSE 0 END + CASE WHEN d <= 30 THEN 2 WHEN d <= 90 THEN 1 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS score FROM (SELECT *, abs(date_diff('day', o_orderdate::DATE, DATE '{AS_OF}')) AS d FROM orders))
SELECT o_orderkey, score, CASE WHEN score >= 4 THEN 'A' WHEN score >= 2 THEN 'B' ELSE 'C' END AS tier FROM s""")
def tier_scoring(t):
    days = F.abs(F.datediff(F.lit(AS_OF).cast("date"), F.to_date("o_orderdate")))
    s = scores.tier_score(F.col("o_totalprice"), days, F.col("o_orderpriority").startswith("1"), 300_000, 100_000)
    return t("orders").select("o_orderkey", s.alias("score"), scores.tier_label(s).alias("tier"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND due < DATE '{AS_OF}' THEN CASE WHEN due < DATE '{AS_OF}' - 30 THEN 'archived' ELSE 'closed' END WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'P' AND due >= DATE '{AS_OF}' THEN 'open' WHEN o_orderstatus = 'P' THEN 'closed' ELSE 'awarded' END AS status FROM (SELECT *, o_orderdate::DATE + 90 AS due FROM orders)""")
def status_transitions(t):
    due, today, s = F.date_add(F.to_date("o_orderdate"), 90), F.lit(AS_OF).cast("date"), F.col("o_orderstatus")
    late = F.when(due < F.date_sub(today, 30), "archived").otherwise("closed")
    status = F.when((s == "O") & (due < today), late).when(s == "O", "open").when((s == "P") & (due >= today), "open").when(s == "P", "closed").otherwise("awarded")
    return t("orders").select("o_orderkey", status.alias("status"))


@query("""WITH w AS (SELECT o_custkey, o_orderdate::DATE AS a, o_orderdate::DATE + 20 AS b, o_orderkey FROM orders),
m AS (SELECT *, CASE WHEN max(b) OVER p IS NULL OR date_diff('day', max(b) OVER p, a) > 3 THEN 1 ELSE 0 END AS fresh FROM w WINDOW p AS (PARTITION BY o_custkey ORDER BY a, b, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, island::BIGINT AS island, min(a)::VARCHAR AS first_day, max(b)::VARCHAR AS last_day, count(*)::BIGINT AS n FROM i GROUP BY 1, 2""")
def date_window_islands(t):
    w = t("orders").select("o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 20).alias("b"))
    return match.islands(w, ["o_custkey"], "a", "b", 3).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderkey < b.o_orderkey AND (abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) <= 14 OR abs(a.o_totalprice - b.o_totalprice) <= 0.12 * greatest(a.o_totalprice, b.o_totalprice))""")
def cross_source_mergeable(t):
    side = lambda n: t("orders").select(F.col("o_orderkey").alias(n), "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias(f"day_{n}"), F.col("o_totalprice").alias(f"sum_{n}"))
    close = (F.abs(F.datediff("day_a", "day_b")) <= 14) | scores.amounts_close(F.col("sum_a"), F.col("sum_b"), 0.12)
    return side("a").join(side("b"), ["o_custkey", "o_orderstatus"]).where((F.col("a") < F.col("b")) & close).select("a", "b")


@query("""SELECT c_custkey, c_name, n_name AS country, coalesce(n, 0)::BIGINT AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_name ILIKE '%00012%' ORDER BY coalesce(n, 0) DESC, c_name LIMIT 20""")
def entity_search(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = t("customer").where(F.col("c_name").ilike("%00012%")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(n, "c_custkey", "left")
    return rank.top(c.select("c_custkey", "c_name", F.col("n_name").alias("country"), F.coalesce("n", F.lit(0)).alias("orders")), 20, F.col("orders").desc_nulls_last(), F.col("c_name"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)""")
def semi_and_anti_join(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    urgent, large = o.where(F.col("o_orderpriority").startswith("1")), o.where("o_totalprice > 100000")
    return t("customer").select("c_custkey").join(urgent, "c_custkey", "left_anti").join(large, "c_custkey", "left_semi")


@query("""SELECT n_name, year, make_date(year, 3, 1 + n_nationkey)::VARCHAR AS day FROM nation, (SELECT unnest(generate_series(2024, 2028)) AS year) WHERE (year - n_nationkey) % (1 + n_nationkey % 3) = 0""")
def recurrence_horizon(t):
    y = t("nation").withColumn("year", F.explode(F.sequence(F.lit(2024), F.lit(2028)))).where((F.col("year") - F.col("n_nationkey")) % (1 + F.col("n_nationkey") % 3) == 0)
    return y.select("n_name", "year", F.make_date("year", F.lit(3), 1 + F.col("n_nationkey")).cast("string").alias("day"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    li = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
