"""Rules over records: status machines, gates, windows, versions, calendars and page metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import gates, pages, scores
from ..operators import rank, status
from .planting import planted, planted_sql
from .registry import query

TODAY = "1998-06-15"


def _orders(t):
    """Orders as notices: a deadline 60 days after publication, unknown for the lowest priority."""
    o = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("published"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    return o.withColumn("deadline", F.when(F.col("o_orderpriority") != "5-LOW", F.date_add("published", 60)))


_NOTICES = "SELECT o_orderkey, o_custkey, o_orderdate::DATE AS published, o_orderstatus, o_orderpriority, o_totalprice, CASE WHEN o_orderpriority <> '5-LOW' THEN (o_orderdate::DATE + 60) END AS deadline FROM orders"


@query(f"""WITH n AS ({_NOTICES}) SELECT o_orderkey, CASE WHEN published > DATE '{TODAY}' THEN 'unknown' WHEN deadline < DATE '{TODAY}' OR (deadline IS NULL AND published < DATE '{TODAY}' - 365)
THEN CASE WHEN coalesce(deadline, published) < DATE '{TODAY}' - 395 THEN 'archived' ELSE 'closed' END ELSE 'open' END AS status FROM n""")
def notice_lifecycle(t):
    """Open notices close by deadline or by age, and are archived 30 days later at the least."""
    return _orders(t).select("o_orderkey", status.lifecycle(F.col("published"), F.col("deadline"), F.lit(TODAY).cast("date"), archive_days=395).alias("status"))


@query(f"""WITH n AS ({_NOTICES}), k AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'matured' WHEN published < DATE '{TODAY}' - 30 THEN 'dropped' WHEN published < DATE '{TODAY}' - 14 THEN 'expired' ELSE 'open' END AS state FROM n WHERE published <= DATE '{TODAY}')
SELECT o_orderpriority, state, count(*)::BIGINT AS n FROM k GROUP BY 1, 2""")
def indicator_states(t):
    """A match matures an indicator; without one it is dropped with age."""
    today = F.lit(TODAY).cast("date")
    state = status.maturation(F.col("o_orderstatus") == "F", F.datediff(today, F.col("published")))
    return _orders(t).where(F.col("published") <= today).groupBy("o_orderpriority", state.alias("state")).agg(F.count("*").alias("n"))


@query(f"""WITH n AS ({_NOTICES}), j AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN published >= DATE '{TODAY}' THEN 'queued' WHEN o_totalprice > 400000 THEN 'failed' WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'deferred' END AS state FROM n)
SELECT state, count(*)::BIGINT AS n, min(o_orderkey) AS first FROM j GROUP BY state""")
def lease_reaping(t):
    """Expired leases: stopped jobs and those tried too often fail, others are deferred."""
    o = _orders(t)
    state = status.reap(done=F.col("o_orderstatus") == "F", expired=F.col("published") < F.lit(TODAY).cast("date"), stopped=F.col("o_orderpriority") == "1-URGENT", attempts=F.when(F.col("o_totalprice") > 400000, 5).otherwise(1))
    return o.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query(f"""WITH n AS ({_NOTICES}) SELECT o_orderkey FROM n WHERE (deadline >= DATE '{TODAY}') AND published <= DATE '{TODAY}' AND (published IS NULL OR date_diff('day', published, DATE '{TODAY}') <= 45)""")
def window_filter(t):
    today = F.lit(TODAY).cast("date")
    near = (F.col("deadline") >= today) & (F.col("published") <= today) & (F.col("published").isNull() | (F.datediff(today, "published") <= 45))
    return _orders(t).where(near).select("o_orderkey")


@query(f"""WITH n AS ({_NOTICES}), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, deadline ORDER BY o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey, o_orderpriority, deadline) AS copies FROM n)
SELECT o_orderkey, copies::BIGINT AS copies FROM r WHERE nth = 1 AND copies > 1""")
def notice_collapse(t):
    """Notices of one key collapse into the first, with how many they were."""
    return _orders(t).groupBy("o_custkey", "o_orderpriority", "deadline").agg(F.min("o_orderkey").alias("o_orderkey"), F.count("*").alias("copies")).where("copies > 1").select("o_orderkey", "copies")


@query("""SELECT p_brand, p_type, count(*)::BIGINT AS variants, max(p_size)::INT AS largest, string_agg(p_name, '|' ORDER BY p_partkey) FILTER (WHERE nth <= 3) AS names FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS nth FROM part) GROUP BY 1, 2""")
def family_variants(t):
    """A family's number of variants and its first names."""
    ranked = t("part").withColumn("nth", F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")))
    first = F.sort_array(F.collect_list(F.when(F.col("nth") <= 3, F.struct("p_partkey", "p_name"))))
    return ranked.groupBy("p_brand", "p_type").agg(F.count("*").alias("variants"), F.max("p_size").alias("largest"), F.array_join(F.transform(first, lambda s: s["p_name"]), "|").alias("names"))


@query(f"""WITH n AS ({_NOTICES}) SELECT o_orderkey, CASE WHEN published < DATE '1995-09-01' THEN 'pending' WHEN published + 1000 <= DATE '{TODAY}' THEN 'expired' WHEN published + 1000 <= DATE '{TODAY}' + 1096 THEN 'soon' ELSE '' END AS flag FROM n""")
def expiry_flags(t):
    flag = status.expiry(pending=F.col("published") < F.lit("1995-09-01").cast("date"), ends=F.date_add("published", 1000), today=F.lit(TODAY).cast("date"), soon_days=1096)
    return _orders(t).select("o_orderkey", flag.alias("flag"))


@query("""SELECT s_nationkey, n FROM (SELECT s_nationkey, count(*)::BIGINT AS n FROM supplier GROUP BY 1) a WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = a.s_nationkey AND c.c_acctbal > 9900)""")
def dormant_watchlist(t):
    """Configured keys without any activity."""
    active = t("customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    return t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).join(active, "s_nationkey", "left_anti")


@query("""WITH e AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS nth FROM conversations)
SELECT conv_id, max(turn) FILTER (WHERE nth = 1) AS last_turn, max(role) FILTER (WHERE nth = 1) AS last_role, count(*)::BIGINT AS turns, sum(n)::BIGINT AS chars FROM e GROUP BY conv_id""")
def stage_timeline(t):
    """The last event of each run, with totals."""
    c = t("conversations")
    last = F.max(F.struct("turn", (-F.ascii("role")).alias("o"), "role"))  # of equal turns the role that comes first
    per = c.groupBy("conv_id").agg(last.alias("l"), F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))
    return per.select("conv_id", F.col("l.turn").alias("last_turn"), F.col("l.role").alias("last_role"), "turns", "chars")


@query(f"""WITH n AS ({_NOTICES}), d AS (SELECT o_orderkey, o_totalprice, date_diff('day', DATE '{TODAY}', deadline) AS days, o_orderpriority = '1-URGENT' AS fit FROM n WHERE deadline >= DATE '{TODAY}'),
s AS (SELECT *, CASE WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 WHEN o_totalprice > 0 THEN 1 ELSE 0 END + CASE WHEN days <= 30 THEN 2 WHEN days <= 90 THEN 1 ELSE 0 END + CASE WHEN fit THEN 1 ELSE 0 END AS score FROM d)
SELECT CASE WHEN score >= 4 THEN 'A' WHEN score >= 2 THEN 'B' ELSE 'C' END AS tier, count(*)::BIGINT AS n, sum(score)::BIGINT AS total FROM s GROUP BY 1""")
def tiered_pipeline(t):
    today = F.lit(TODAY).cast("date")
    d = _orders(t).where(F.col("deadline") >= today)
    s = scores.tier_score(F.col("o_totalprice"), F.datediff("deadline", today), F.col("o_orderpriority") == "1-URGENT", 300000, 100000)
    return d.withColumn("score", s).groupBy(scores.tier_label(F.col("score")).alias("tier")).agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("""SELECT o_orderkey, round(least(1, greatest(0, 0.25 * least(1, l.n / 5.0) + 0.25 * least(1, o_totalprice / 400000) + 0.2 * CASE WHEN l.r > 0 THEN 1 ELSE 0 END + 0.15 * l.late + 0.15 * CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END)), 4) AS value
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) AS late FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def weighted_components(t):
    """A value of five weighted parts, each held between 0 and 1."""
    per = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"), F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)).alias("late"))
    j = t("orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    one = F.lit(1.0)
    parts = ((0.25, F.least(one, F.col("n") / 5.0)), (0.25, F.least(one, F.col("o_totalprice") / 400000)), (0.2, F.when(F.col("r") > 0, 1).otherwise(0)), (0.15, F.col("late")), (0.15, F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)))
    return j.select("o_orderkey", F.round(scores.weighted(parts), 4).alias("value"))


@query("""SELECT page_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS title FROM (SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS t FROM pages)""")
def title_ladder(t):
    """The title tag, else the first heading."""
    return t("pages").select("page_id", pages.title(F.col("html")).alias("title"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '/(?:tag|category|page|index|search)(?:/|$|\.)') OR regexp_matches(url, '[?&](?:page|offset)=[0-9]+') OR regexp_matches(url, '^[a-z]+://[^/]+/?$') THEN false ELSE true END AS article FROM pages""")
def article_urls(t):
    return t("pages").select("page_id", pages.is_article(F.col("url")).alias("article"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[.!?](?:\s|$)'))::BIGINT AS sentences, len(regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)?\b'))::BIGINT AS numbers FROM documents""")
def sentence_counts(t):
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), 0)).cast("long")
    return t("documents").select("doc_id", count(r"[.!?](?:\s|$)").alias("sentences"), count(r"\b[0-9]+(?:\.[0-9]+)?\b").alias("numbers"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents), k AS (SELECT doc_id, nth, lower(regexp_replace(line, '[^a-zA-Z0-9]+', '', 'g')) AS key FROM s)
SELECT doc_id, count(*)::BIGINT AS lines, count(*) FILTER (WHERE key <> '' AND later)::BIGINT AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY nth) > 1 AS later FROM k) GROUP BY doc_id""")
def exact_sentence_dedupe(t):
    """Later lines that equal an earlier one once case and signs are gone: within the row, without any exchange of texts."""
    keys = F.transform(F.split("text", "\n"), lambda x: F.lower(F.regexp_replace(x, "[^a-zA-Z0-9]+", "")))
    d = t("documents").select("doc_id", keys.alias("keys")).withColumn("worded", F.filter("keys", lambda k: k != ""))
    return d.select("doc_id", F.size("keys").cast("long").alias("lines"), (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("repeated"))


@query("""SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth, n_chars FROM documents) WHERE nth <= 4 OR n_chars > 20000""")
def capped_with_exceptions(t):
    """The first of each group, and all that are too large to be left out."""
    return rank.cap_per_group(t("documents").select("doc_id", "source", "n_chars"), ["source"], 4, F.col("n_chars").desc_nulls_last(), F.col("doc_id"), always=F.col("n_chars") > 20000).select("doc_id")


@query("""WITH RECURSIVE c AS (SELECT p_partkey, p_partkey // 2 AS parent FROM part), up AS (SELECT 100::BIGINT AS node, 0 AS hops UNION ALL SELECT c.parent, hops + 1 FROM up JOIN c ON c.p_partkey = up.node WHERE up.node > 1) SELECT node, hops FROM up""")
def lineage_chain(t):
    """The ancestors of a row by its parents' ids, nearest first."""
    c = t("part").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"))
    return status.ancestors(c, 100, 12)


@query("""SELECT user_id, event_type, count(*)::BIGINT AS claims, min(event_id) AS first FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2 HAVING count(*) <= 5""")
def notification_claims(t):
    """One claim for each kind and key, given up after five attempts."""
    return t("events").where(F.col("event_type").isin("error", "signup")).groupBy("user_id", "event_type").agg(F.count("*").alias("claims"), F.min("event_id").alias("first")).where("claims <= 5")


@query("""SELECT l_suppkey, year, n FROM (SELECT l_suppkey, year(l_shipdate)::INT AS year, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2) WHERE year >= 1998""")
def retention(t):
    """What is older than the period kept is pruned before anything is summed."""
    return t("lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))


#: What a notice says, by part: terms of another trade, beside such of defence or not.
NOTICES = ("", "medical cameras", "medical cameras for the army", "night sights", "Veterinary optics", "premedical kits")


@query(f"""WITH n AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size % 11 END AS relevance, lower({planted_sql("p_name", "p_partkey", tuple(" " + x for x in NOTICES))}) AS text FROM part),
m AS (SELECT *, regexp_matches(text, '(?:^|[^a-z0-9_])(?:medical|veterinary)(?:[^a-z0-9_]|$)') AND NOT regexp_matches(text, '(?:^|[^a-z0-9_])(?:army|navy)(?:[^a-z0-9_]|$)') AS penalty FROM n)
SELECT p_partkey, penalty, CASE WHEN penalty THEN least(coalesce(relevance / 10.0, 0.5), 0.2) ELSE coalesce(relevance / 10.0, 0.5) END::DOUBLE AS score FROM m""")
def penalised_relevance(t):
    """A notice's relevance, capped where it speaks of another trade and not of defence."""
    text = planted("p_name", "p_partkey", tuple(" " + x for x in NOTICES))
    rows = t("part").select("p_partkey", text.alias("text"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 11).alias("relevance"))
    penalty = gates.off_trade(F.col("text"), ("medical", "veterinary"), ("army", "navy"))
    return rows.select("p_partkey", penalty.alias("penalty"), gates.notice_relevance(F.col("relevance"), penalty).alias("score"))
