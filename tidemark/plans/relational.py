"""Predicates over arrays, joins of every kind, set operations, and listings over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank
from .registry import query

_TYPES = "SELECT user_id, list_sort(list_distinct(list(event_type))) AS types FROM events GROUP BY user_id"


def _types(t):
    return t("events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types"))


@query(f"""WITH u AS ({_TYPES}) SELECT user_id, list_contains(types, 'purchase') AS bought, list_has_any(types, ['error', 'signup']) AS touched, list_has_all(types, ['click', 'view']) AS browsed,
NOT list_contains(types, 'error') AS clean, len(types)::INT AS n, array_to_string(types, ',') AS types FROM u""")
def array_predicates(t):
    """Membership, overlap, containment, size and joining of an array."""
    lit = lambda *x: F.array(*map(F.lit, x))
    return _types(t).select(
        "user_id", F.array_contains("types", "purchase").alias("bought"), F.coalesce(F.arrays_overlap("types", lit("error", "signup")), F.lit(False)).alias("touched"),
        (F.size(F.array_except(lit("click", "view"), "types")) == 0).alias("browsed"), (~F.array_contains("types", "error")).alias("clean"), F.size("types").alias("n"), F.array_join("types", ",").alias("types"),
    )


@query("""WITH r AS (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders)
SELECT c_custkey, a.p AS latest, b.p AS before FROM customer LEFT JOIN r a ON a.o_custkey = c_custkey AND a.nth = 1 LEFT JOIN r b ON b.o_custkey = c_custkey AND b.nth = 2 WHERE a.p IS DISTINCT FROM b.p""")
def null_safe_changes(t):
    """Customers whose two latest orders differ in priority, a missing order being a value of its own."""
    two = rank.first_per(t("orders"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc_nulls_last()], 2, "nth")
    per = two.groupBy("o_custkey").agg(F.max(F.when(F.col("nth") == 1, F.col("o_orderpriority"))).alias("latest"), F.max(F.when(F.col("nth") == 2, F.col("o_orderpriority"))).alias("before"))
    joined = t("customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(~F.col("latest").eqNullSafe(F.col("before"))).select("c_custkey", "latest", "before")


@query(r"""SELECT p_partkey, p_name ILIKE '%red%' AS part_of, p_name ILIKE '%100\%%' ESCAPE '\' AS escaped, regexp_matches(p_name, '(?i)\bring\b') AS word FROM part WHERE p_name ILIKE '%red%' OR regexp_matches(p_name, '(?i)\bring\b')""")
def token_or_substring(t):
    """Short tokens match whole words, longer ones anywhere; a user's wildcards are taken literally."""
    part_of, word = F.col("p_name").ilike("%red%"), F.col("p_name").rlike(r"(?i)\bring\b")
    return t("part").where(part_of | word).select("p_partkey", part_of.alias("part_of"), F.col("p_name").ilike(r"%100\%%").alias("escaped"), word.alias("word"))


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type IS DISTINCT FROM b.event_type
AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 3600000000""")
def epoch_window_pairs(t):
    """Pairs of one user's events of different types within an hour: each row meets its own and the neighbouring hours only."""
    e = t("events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    a = e.select(F.col("event_id").alias("a"), "user_id", F.col("event_type").alias("ka"), F.col("us").alias("ua"), F.explode(F.array(F.col("hour") - 1, F.col("hour"), F.col("hour") + 1)).alias("hour"))
    b = e.select(F.col("event_id").alias("b"), "user_id", F.col("event_type").alias("kb"), F.col("us").alias("ub"), "hour")
    near = (F.col("a") < F.col("b")) & ~F.col("ka").eqNullSafe(F.col("kb")) & (F.abs(F.col("ub") - F.col("ua")) <= 3_600_000_000)
    return a.join(b, ["user_id", "hour"]).where(near).select("a", "b")


@query("""WITH b AS (SELECT l_orderkey, list_distinct(list(p_brand)) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
x AS (SELECT l_orderkey, unnest(brands) AS brand FROM b)
SELECT p.p_brand AS brand, count(x.l_orderkey)::BIGINT AS n, max(o_orderdate)::TIMESTAMP AS last_seen FROM (SELECT DISTINCT p_brand FROM part) p LEFT JOIN x ON x.brand = p.p_brand LEFT JOIN orders ON o_orderkey = x.l_orderkey GROUP BY 1""")
def array_membership_join(t):
    """Every brand with the orders whose array of brands holds it: the array is exploded, so the join is on equality."""
    brands = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    held = brands.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("brands")).select("l_orderkey", F.explode("brands").alias("brand"))
    seen = held.join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    per = seen.groupBy("brand").agg(F.count("*").alias("n"), F.max("o_orderdate").cast("timestamp_ntz").alias("last_seen"))
    return t("part").select(F.col("p_brand").alias("brand")).distinct().join(per, "brand", "left").select("brand", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "last_seen")


@query("""WITH u AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS ps FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey, p.x AS priority FROM (SELECT c_custkey, ps FROM customer LEFT JOIN u ON o_custkey = c_custkey) c LEFT JOIN LATERAL (SELECT unnest(c.ps) AS x) p ON true""")
def outer_explode(t):
    """A customer without any closed order stays, with a null."""
    per = t("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("ps"))
    return t("customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.explode_outer("ps").alias("priority"))


@query("""SELECT o_orderkey, o_orderdate::TIMESTAMP AS o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#7' AND l_quantity > 30) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def in_subquery_recent(t):
    """The 20 latest orders that hold much of a brand."""
    brand = t("part").where("p_brand = 'Brand#7'").select("p_partkey")
    keys = t("lineitem").where("l_quantity > 30").join(brand, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    found = t("orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return rank.top(found, 20, F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc_nulls_last())


@query("""SELECT user_id, count(*)::BIGINT AS n, max(ts)::TIMESTAMP AS last_seen, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24')::BIGINT AS n7, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01')::BIGINT AS n30 FROM events GROUP BY user_id""")
def mention_counts(t):
    """All counts of an entity in one pass, in place of a subquery for each."""
    since = lambda day: F.count(F.when(F.col("ts") >= F.lit(day).cast("timestamp"), 1))
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").cast("timestamp_ntz").alias("last_seen"), since("2024-01-24").alias("n7"), since("2024-01-01").alias("n30"))


@query("""WITH k AS (SELECT DISTINCT md5(text) AS k FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) SELECT doc_id, md5(text) AS k FROM documents WHERE md5(text) IN (SELECT k FROM k)""")
def group_key_expansion(t):
    """All rows that share a group with any of some rows: distinct keys first, so no pair is made twice."""
    keyed = t("documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    keys = keyed.join(t("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("k").distinct()
    return keyed.join(keys, "k", "left_semi").select("doc_id", "k")


@query("""WITH m AS (SELECT n_nationkey AS old, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS new FROM nation WHERE n_regionkey <> 2) SELECT c_custkey, coalesce(m.new, c_nationkey) AS root, m.new IS NOT NULL AND m.new <> c_nationkey AS moved FROM customer LEFT JOIN m ON m.old = c_nationkey""")
def root_remap(t):
    """Rows of an old root move to its new one; other roots stay."""
    w = Window.partitionBy("n_regionkey")
    m = t("nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("old"), F.min("n_nationkey").over(w).alias("new"))
    joined = t("customer").join(m, F.col("c_nationkey") == F.col("old"), "left")
    return joined.select("c_custkey", F.coalesce("new", "c_nationkey").alias("root"), F.coalesce(F.col("new") != F.col("c_nationkey"), F.lit(False)).alias("moved"))


@query("""SELECT c_custkey, coalesce(d.canonical, lower(c_mktsegment)) AS segment, d.canonical IS NOT NULL AS known FROM customer
LEFT JOIN (VALUES ('automobile', 'vehicles'), ('machinery', 'industry'), ('building', 'construction')) d(alias, canonical) ON d.alias = lower(regexp_replace(trim(c_mktsegment), '\\s+', ' ', 'g'))""")
def alias_dictionary_join(t):
    c = t("customer")
    names = c.sparkSession.createDataFrame([("automobile", "vehicles"), ("machinery", "industry"), ("building", "construction")], "alias string, canonical string")
    key = F.lower(F.regexp_replace(F.trim("c_mktsegment"), r"\s+", " "))
    joined = c.join(F.broadcast(names), key == F.col("alias"), "left")
    return joined.select("c_custkey", F.coalesce("canonical", F.lower("c_mktsegment")).alias("segment"), F.col("canonical").isNotNull().alias("known"))


@query("""WITH cur AS (SELECT user_id, max(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1), old AS (SELECT user_id, max(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24' GROUP BY 1)
SELECT coalesce(cur.user_id, old.user_id) AS user_id, CASE WHEN old.user_id IS NULL THEN 'appeared' WHEN cur.user_id IS NULL THEN 'vanished' WHEN cur.v > old.v THEN 'strengthened' ELSE 'weakened' END AS change FROM cur FULL JOIN old ON cur.user_id = old.user_id WHERE cur.v IS DISTINCT FROM old.v""")
def set_difference_by_key(t):
    """What appeared, vanished, strengthened or weakened between two periods."""
    e = t("events")
    ts = lambda d: F.lit(d).cast("timestamp")
    # one pass: both periods are conditional sums of one aggregate
    per = e.where(F.col("ts") >= ts("2024-01-17")).groupBy("user_id").agg(F.max(F.when(F.col("ts") >= ts("2024-01-24"), F.col("value"))).alias("cur"), F.max(F.when(F.col("ts") < ts("2024-01-24"), F.col("value"))).alias("old"))
    change = F.when(F.col("old").isNull(), "appeared").when(F.col("cur").isNull(), "vanished").when(F.col("cur") > F.col("old"), "strengthened").otherwise("weakened")
    return per.where(~F.col("cur").eqNullSafe(F.col("old"))).select("user_id", change.alias("change"))


@query("""SELECT user_id, array_to_string(list(event_type ORDER BY first, event_type), '>') AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY user_id""")
def first_seen_union(t):
    """Union of arrays in order of first sight."""
    first = t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    per = first.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("first", "event_type"))).alias("x"))
    return per.select("user_id", F.array_join(F.transform("x", lambda s: s["event_type"]), ">").alias("kinds"))


@query("""SELECT count(*)::BIGINT AS total, count(DISTINCT o_orderpriority)::BIGINT AS priorities, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS facet, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '|') AS states FROM orders WHERE o_totalprice > 100000""")
def facets(t):
    """Distinct values and total under one predicate."""
    o = t("orders").where("o_totalprice > 100000")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "|")
    return o.agg(F.count("*").alias("total"), F.count_distinct("o_orderpriority").alias("priorities"), joined("o_orderpriority").alias("facet"), joined("o_orderstatus").alias("states"))


@query("""SELECT p_brand, year(l_shipdate)::INT AS year, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def filing_waves(t):
    """Key, year, count: counts are made per part before brands are looked up."""
    per = t("lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    return per.join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "year").agg(F.sum("n").alias("n"))


@query("""SELECT md5(text) AS family, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) >= 2""")
def family_groups(t):
    return t("documents").groupBy(F.md5(F.col("text").cast("binary")).alias("family")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n >= 2")


@query("""SELECT source, count(*)::BIGINT AS n, max(n_chars) AS longest, CASE WHEN count(*) = 0 THEN 'silent' WHEN count(*) < 10 THEN 'thin' ELSE 'good' END AS state, count(DISTINCT lang)::BIGINT AS langs FROM documents GROUP BY source""")
def source_coverage(t):
    n = F.count("*")
    return t("documents").groupBy("source").agg(n.alias("n"), F.max("n_chars").alias("longest"), F.when(n < 10, "thin").otherwise("good").alias("state"), F.count_distinct("lang").alias("langs"))


@query("""WITH ids AS (SELECT user_id, event_id AS id, event_type = 'purchase' AS inside FROM events WHERE event_type IN ('purchase', 'signup') UNION SELECT user_id, event_id, false FROM events WHERE value > 90)
SELECT user_id, count(DISTINCT id)::BIGINT AS evidence, count(DISTINCT id) FILTER (WHERE inside)::BIGINT AS in_scope FROM ids GROUP BY user_id""")
def evidence_union(t):
    """Distinct evidence from several sources, and the part of it in scope."""
    e = t("events")
    a = e.where(F.col("event_type").isin("purchase", "signup")).select("user_id", F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("inside"))
    b = e.where("value > 90").select("user_id", F.col("event_id").alias("id"), F.lit(False).alias("inside"))
    per = a.unionByName(b).groupBy("user_id", "id").agg(F.max("inside").alias("inside"))
    return per.groupBy("user_id").agg(F.count("*").alias("evidence"), F.count(F.when(F.col("inside"), 1)).alias("in_scope"))


@query("""SELECT user_id, round(avg(value), 6) AS mean, count(*)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5 GROUP BY user_id""")
def mean_of_last(t):
    """The mean of an entity's five latest values."""
    last = rank.first_per(t("events"), ["user_id"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc_nulls_last()], 5, "nth")
    return last.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("""SELECT round(sum(w * s) / nullif(sum(w) FILTER (WHERE s IS NOT NULL), 0), 6) AS total FROM (SELECT n::DOUBLE AS w, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce((a + b) / 2, a, b) END AS s
FROM (SELECT event_type, count(*) AS n, avg(value) FILTER (WHERE value > 50) AS a, avg(value) FILTER (WHERE value < 5) AS b FROM events GROUP BY event_type))""")
def weighted_total(t):
    """A weighted mean of halves; a part without either half is left out."""
    per = t("events").groupBy("event_type").agg(F.count("*").cast("double").alias("w"), F.avg(F.when(F.col("value") > 50, F.col("value"))).alias("a"), F.avg(F.when(F.col("value") < 5, F.col("value"))).alias("b"))
    s = F.coalesce((F.col("a") + F.col("b")) / 2, "a", "b")
    per = per.withColumn("s", s)
    return per.agg(F.round(F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.when(F.col("s").isNotNull(), F.col("w"))), F.lit(0.0)), 6).alias("total"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC) AS nth, count(*) OVER (PARTITION BY o_custkey) - 1 AS reruns FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus, reruns::BIGINT AS reruns FROM r WHERE nth = 1""")
def rerun_reconciliation(t):
    """Of an entity's runs the best outcome stays, of equal ones the newest, with the number of the others."""
    quality = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    best = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct(quality, "o_orderdate", "o_orderkey")).alias("b")
    return t("orders").groupBy("o_custkey").agg(best, (F.count("*") - 1).alias("reruns")).select("o_custkey", "b.o_orderkey", "b.o_orderstatus", "reruns")


@query("""SELECT o_orderkey, (SELECT max(o2.o_orderdate) FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_orderpriority = o.o_orderpriority AND o2.o_orderdate < o.o_orderdate)::TIMESTAMP AS previous FROM orders o""")
def previous_issue(t):
    """The latest earlier issue of the same kind, by a window that looks back over smaller dates only."""
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    return t("orders").select("o_orderkey", F.max("o_orderdate").over(w).cast("timestamp_ntz").alias("previous"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value > 50 DESC, ts DESC, event_id) AS nth FROM events), b AS (SELECT * FROM a WHERE nth <= 3)
SELECT event_id, event_type FROM b ORDER BY ts, event_id LIMIT 8""")
def cap_per_key_then_overall(t):
    some = rank.first_per(t("events").withColumn("evident", F.col("value") > 50), ["event_type"], [F.col("evident").desc_nulls_last(), F.col("ts").desc_nulls_last(), F.col("event_id")], 3, "nth")
    return rank.top(some, 8, F.col("ts"), F.col("event_id")).select("event_id", "event_type")


@query(r"""WITH w AS (SELECT doc_id, text, lang FROM documents), q AS (SELECT 'the' AS token UNION ALL SELECT 'password' UNION ALL SELECT 'license'),
df AS (SELECT token, count(*) AS n FROM q JOIN w ON contains(lower(text), token) GROUP BY token),
hits AS (SELECT token, doc_id, row_number() OVER (PARTITION BY token ORDER BY doc_id DESC) AS nth, CASE WHEN contains(lower(substr(text, 1, 120)), token) THEN 2.0 ELSE 0.5 END AS s FROM q JOIN w ON contains(lower(text), token))
SELECT doc_id, sum(s)::DOUBLE AS score, count(*)::BIGINT AS tokens FROM hits WHERE nth <= 5 GROUP BY doc_id ORDER BY score DESC, doc_id DESC LIMIT 8""")
def hybrid_retrieval(t):
    """Of each rare token the five newest rows, weighted by where it stands; then the best eight rows."""
    tokens = ("the", "password", "license")
    low = t("documents").select("doc_id", F.lower("text").alias("low"))
    hit = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(k)), F.struct(F.lit(k).alias("token"), F.when(F.contains(F.substring("low", 1, 120), F.lit(k)), 2.0).otherwise(0.5).alias("s"))) for k in tokens)))
    hits = low.select("doc_id", F.explode(hit).alias("h")).select("doc_id", "h.token", "h.s")
    first = rank.first_per(hits, ["token"], [F.col("doc_id").desc_nulls_last()], 5, "nth")
    return rank.top(first.groupBy("doc_id").agg(F.sum("s").alias("score"), F.count("*").alias("tokens")), 8, F.col("score").desc_nulls_last(), F.col("doc_id").desc_nulls_last())


@query("""SELECT s.s_suppkey, rank_of, coalesce(p.n, 0)::BIGINT AS pos FROM (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS rank_of FROM supplier) s LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) p ON p.l_suppkey = s.s_suppkey""")
def learned_priority(t):
    returned = t("lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = t("supplier").join(returned, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select("s_suppkey", F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("rank_of"), F.coalesce("n", F.lit(0)).cast("long").alias("pos"))
