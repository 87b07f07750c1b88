"""Sources that are due, gates, deals, relations, repeats and reruns over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import gates
from ..operators import desk, rank
from .registry import query

_NOW = dt.datetime(2024, 1, 20, 12)


@query(f"""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'weekly' ELSE 'daily' END AS schedule, epoch_us(TIMESTAMP '{_NOW}') - epoch_us(max(ts)) AS gone
  FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type <> 'error' GROUP BY 1)
SELECT c_custkey, gone IS NULL OR schedule = 'daily' OR gone >= 156 * 3600000000 AS due_at_night,
  gone IS NULL OR gone >= (CASE schedule WHEN 'weekly' THEN 156 ELSE 20 END) * 3600000000 AS due_by_day,
  least(21, greatest(2, CASE WHEN gone IS NULL THEN 14 ELSE greatest(0, gone) // 86400000000 + 1 END))::INT AS days FROM s""")
def source_schedule(t):
    """Customers as sources, their last event without an error as the last success."""
    last = t("events").where("event_type <> 'error'").groupBy("user_id").agg(F.max("ts").alias("last"))
    s = t("customer").join(last, F.col("c_custkey") == F.col("user_id"), "left")
    schedule, now = F.when(F.col("c_custkey") % 3 == 0, "weekly").otherwise("daily"), F.lit(_NOW).cast("timestamp")
    last_ok = F.col("last").cast("timestamp")
    at = [gates.due(schedule, last_ok, now, poll).alias(name) for poll, name in ((False, "due_at_night"), (True, "due_by_day"))]
    return s.select("c_custkey", *at, gates.lookback_days(last_ok, F.lit(2), now).alias("days"))


_TERMS, _SIGNALS = ("the", "and", "that", "der", "que"), ("ing", "sch", "ción")
_HELD = ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in _TERMS)
_SIGNAL = " OR ".join(f"contains(lower(text), '{w}')" for w in _SIGNALS)


@query(f"""WITH h AS (SELECT doc_id, list_filter([{_HELD}], lambda x: x IS NOT NULL) AS held, coalesce({_SIGNAL}, false) AS signal FROM documents)
SELECT doc_id, CASE WHEN signal THEN array_to_string(held, ',') ELSE '' END AS terms, least(5, 1 + len(held))::INT AS rubric FROM h""")
def two_signal_gate(t):
    """Terms of documents that hold a signal as well, and how many terms they hold."""
    terms = F.array_join(gates.two_signals(F.col("text"), _TERMS, _SIGNALS), ",")
    return t("documents").select("doc_id", terms.alias("terms"), gates.rubric(F.col("text"), _TERMS).alias("rubric"))


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice / 50000) END AS v, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'C' || o_custkey % 40 END AS c, o_orderdate FROM orders)
SELECT o_orderstatus AS kind, coalesce(v::INT::VARCHAR || '.0', lower(trim(o_orderpriority))) AS amount, coalesce(lower(c), year(o_orderdate)::VARCHAR) AS who, min(o_orderkey) AS first, count(*) AS n FROM r GROUP BY ALL""")
def deal_groups(t):
    """Orders as deals, three in four with a value and one in three with a customer."""
    k = F.col("o_orderkey")
    value = F.when(k % 4 != 0, F.round(F.col("o_totalprice") / 50000))
    customer = F.when(k % 3 == 0, F.concat(F.lit("C"), (F.col("o_custkey") % 40).cast("string")))
    key = gates.deal_key(value, F.col("o_orderpriority"), F.col("o_orderstatus"), customer, F.date_format("o_orderdate", "yyyy-MM-dd"))
    keyed = t("orders").select(k, key.alias("key")).groupBy("key").agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n"))
    return keyed.select("key.kind", "key.amount", "key.who", "first", "n")


@query("""WITH e AS (SELECT l_orderkey AS n, l_returnflag AS kind, 's' || l_suppkey AS owner, CASE WHEN l_orderkey % 5 <> 0 THEN 'c' || o_custkey END AS customer, ['s' || l_suppkey, 's' || (l_suppkey + 1), 'c' || o_custkey] AS parties
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT n, kind, owner, unnest(list_distinct(list_filter(list_append(parties, customer), lambda p: p IS NOT NULL AND p <> owner))) AS dst FROM e)
SELECT owner AS src, dst, kind, count(*) AS n, max(n) AS latest FROM d GROUP BY ALL""")
def event_relations(t):
    """Line items as events of their suppliers; the relations that they tell, counted."""
    e = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    s, c = (lambda x: F.concat(F.lit("s"), x.cast("string"))), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    own = F.col("l_suppkey")
    e = e.select(s(own).alias("owner"), F.when(F.col("l_orderkey") % 5 != 0, c).alias("customer"), F.array(s(own), s(own + 1), c).alias("parties"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("n"))
    return desk.event_relations(e).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"), F.max("n").alias("latest"))


_TITLE_WORDS = r"""list_distinct(list_transform(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '[A-Za-z][A-Za-z0-9-]+'), lambda x: lower(x)))"""
_COMMON = "[" + ", ".join(f"'{w}'" for w in gates.TITLE_WORDS) + "]"


@query(f"""WITH p AS (SELECT page_id, list_filter({_TITLE_WORDS}, lambda x: NOT list_contains({_COMMON}, x)) AS w FROM pages)
SELECT a.page_id AS page_id FROM p a WHERE a.page_id % 10 = 0 AND EXISTS (SELECT 1 FROM p b WHERE b.page_id % 10 <> 0 AND len(list_intersect(a.w, b.w)) >= 2)""")
def undated_repeats(t):
    """Pages without a date (every tenth stands for one) whose titles share two words or more with a dated page."""
    title = gates.title_tokens(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    p = t("pages").select(F.col("page_id").alias("id"), title.alias("words"))
    found = desk.repeats_by_words(p.where("id % 10 = 0"), p.where("id % 10 <> 0"))
    return found.select(F.col("id").alias("page_id"))


@query("""WITH RECURSIVE e AS (SELECT conv_id AS id, min_by(text, turn) AS q, length(min_by(text, turn)) % 4 AS grade, count(*) AS "at" FROM conversations GROUP BY 1),
links AS (SELECT id AS a, min(id) OVER (PARTITION BY lower(trim(q))) AS b FROM e WHERE q <> '' UNION SELECT id, id - 2 FROM e WHERE id % 7 = 3 AND id - 2 IN (SELECT id FROM e)),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
r(node, root) AS (SELECT id, id FROM e UNION SELECT b.b, r.root FROM r JOIN both_ways b ON b.a = r.node WHERE r.root < b.b),
g AS (SELECT node AS id, min(root) AS "group" FROM r GROUP BY 1)
SELECT "group", arg_max(id, {'g': grade, 't': "at", 'i': id}) AS best, count(*) - 1 AS reruns FROM e JOIN g USING (id) GROUP BY 1""")
def rerun_groups(t):
    """Conversations as runs of their first turn's question; some go on from an earlier one."""
    e = t("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("question"), F.count("*").alias("at"))
    e = e.withColumn("grade", F.length("question") % 4)
    lineage = e.where("id % 7 = 3").select(F.col("id").alias("a"), (F.col("id") - 2).alias("b")).join(e.select(F.col("id").alias("b")), "b", "left_semi")
    return desk.best_of_reruns(e, lineage.select("a", "b"))


@query("""SELECT p_brand AS name, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def brand_overlap(t):
    """Orders as sets of parts: how many hold a part of each brand."""
    sets = t("lineitem").groupBy(F.col("l_orderkey").alias("owner")).agg(F.collect_set("l_partkey").alias("items"))
    return desk.overlapping_owners(sets, t("part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("item")))


@query("""SELECT s_suppkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_mktsegment = 'MACHINERY') AS has_history FROM supplier""")
def prior_history(t):
    s, past = t("supplier").select("s_suppkey", "s_nationkey"), t("customer").where("c_mktsegment = 'MACHINERY'")
    return desk.flag_known(s, past, {"s_nationkey": "c_nationkey"}, "has_history").select("s_suppkey", "has_history")


@query("""SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS nth, count(*) OVER (PARTITION BY event_type) AS total FROM events QUALIFY nth <= 5""")
def feedback_lines(t):
    """The five newest lines of each kind, and how many the kind has."""
    e = t("events").select("event_id", "event_type", "ts")
    return desk.newest_lines(e, "event_type", 5, F.col("ts").desc_nulls_last(), F.col("event_id").desc_nulls_last()).drop("ts")


@query("""SELECT p_partkey, p_name, l_extendedprice / l_quantity AS price, l_orderkey FROM part JOIN lineitem ON l_partkey = p_partkey
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def latest_prices(t):
    """Each part's latest price; parts are joined after the lines of a part have become one."""
    order = [F.col(c).desc_nulls_last() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    last = rank.latest(t("lineitem"), ["l_partkey"], *order).select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_orderkey")
    return t("part").join(last, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "price", "l_orderkey")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'confirmed' ELSE 'single' END AS status, CASE WHEN doc_id % 4 = 0 THEN n_chars ELSE 1 END AS n FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 0""")
def corroboration_upsert(t):
    """Stored states of two documents in three, of which one in four, and some new ones, come anew."""
    d = t("documents")
    stored = d.where("doc_id % 3 <> 0").select("doc_id", F.lit("single").alias("status"), F.lit(1).cast("long").alias("n"))
    return desk.replace_by_key(stored, d.where("doc_id % 4 = 0").select("doc_id", F.lit("confirmed").alias("status"), F.col("n_chars").alias("n")), "doc_id")
