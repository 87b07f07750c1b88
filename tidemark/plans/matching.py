"""Keys, small rules and counts: what is the same record, what is new, who competes, which rows are stuck."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, scores
from ..operators import rank
from .links import _EDGES, edges
from .planting import planted, planted_sql
from .registry import query

_SITE = "|".join(keys.SITE_PAGES)


#: What is put behind an address, by page.
PATHS = ("", "/privacy", "/About-Us?a=1", "/story?next=/login", "/de/terms/", "/subscribers-only")


@query(f"SELECT page_id, regexp_matches(regexp_replace(lower({planted_sql('url', 'page_id', PATHS)}), '\\?.*$', ''), '{_SITE}') AS site_page FROM pages")
def boilerplate_pages(t):
    """Addresses of a site's own pages, by path and not by what a parameter holds."""
    return t("pages").select("page_id", keys.is_site_page(planted("url", "page_id", PATHS)).alias("site_page"))


@query(r"""WITH k AS (SELECT page_id, regexp_replace(trim(url), '[?#].*$', '') AS u FROM pages),
p AS (SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(u, '^[^/]*//([^/]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(u, '^[^/]*//[^/]*(/.*)?$', 1), '/+$', '') AS key FROM k)
SELECT key, min(page_id) AS page_id, count(*)::BIGINT AS n FROM p GROUP BY key""")
def web_url_key(t):
    """One page for each address key, and how many pages have it."""
    return t("pages").groupBy(keys.web_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query(r"""WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) AS found FROM documents),
f AS (SELECT doc_id, list_filter(found, lambda x: NOT regexp_full_match(replace(x, ',', ''), '20[0-9]{2}') AND (contains(x, '.') OR replace(x, ',', '')::DOUBLE >= 10)) AS kept FROM n)
SELECT doc_id, len(kept)::INT AS n, array_to_string(list_sort(kept), ' ') AS numbers FROM f""")
def distinctive_numbers(t):
    d = t("documents").select("doc_id", keys.distinctive_numbers(F.col("text")).alias("kept"))
    return d.select("doc_id", F.size("kept").alias("n"), F.array_join(F.array_sort("kept"), " ").alias("numbers"))


@query(r"""SELECT regexp_replace(lower(c_name), '[^a-z0-9_]+', ' ', 'g') AS key, min(c_custkey) AS first FROM customer GROUP BY 1""")
def entity_name_key(t):
    return t("customer").groupBy(keys.name_key(F.col("c_name")).alias("key")).agg(F.min("c_custkey").alias("first"))


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey
WHERE a.o_orderstatus = b.o_orderstatus OR abs(a.o_totalprice - b.o_totalprice) <= 0.1 * greatest(a.o_totalprice, b.o_totalprice)""")
def events_match(t):
    """Orders of one customer that tell of the same: of one priority, and of one status or of close amounts."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    a, b = o.alias("a"), o.alias("b")
    two = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    nobody = (F.lit(None).cast("string"), F.lit(None).cast("string"))
    pairs = a.join(b, ["o_custkey", "o_orderpriority"]).where("a.o_orderkey < b.o_orderkey")
    return pairs.where(keys.same_event((F.col("o_orderpriority"), F.col("o_orderpriority")), nobody, two("o_orderstatus"), two("o_totalprice"))).select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"))


@query("""SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS kept, count(*)::BIGINT - 1 AS dropped FROM orders GROUP BY 1, 2""")
def stable_key_latest(t):
    """Of each key the row updated last stays, of equally late ones that with the largest id."""
    last = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return t("orders").groupBy("o_custkey", "o_orderpriority").agg(last.alias("kept"), (F.count("*") - 1).alias("dropped"))


@query("""SELECT regexp_replace(upper(p_brand || '-' || p_size), '[^A-Z0-9]', '', 'g') AS number, min(p_partkey) AS first, count(*)::BIGINT AS n FROM part GROUP BY 1""")
def publication_number_dedupe(t):
    """Rows of one number, whatever its case and punctuation, collapse into the first."""
    number = F.regexp_replace(F.upper(F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))), "[^A-Z0-9]", "")
    return t("part").groupBy(number.alias("number")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))


@query("""SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) = 1998 AND (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE year(o_orderdate) = 1997)""")
def gap_diff(t):
    """Gaps that the year before did not have."""
    of = lambda y: t("orders").where(F.year("o_orderdate") == y).select("o_custkey", "o_orderpriority")
    return of(1998).distinct().join(of(1997), ["o_custkey", "o_orderpriority"], "left_anti")


@query("""WITH a AS (SELECT json_extract_string(props, '$.k') AS subject, count(DISTINCT coalesce(CASE WHEN value > 50 THEN user_id END, event_id % 10))::BIGINT AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1)
SELECT subject, n, least(5, greatest(3, n + 1))::BIGINT AS strength FROM a WHERE n >= 2""")
def tech_race(t):
    """Subjects that two or more actors launch or test; the actor is the party, or else the customer."""
    actor = F.coalesce(F.when(F.col("value") > 50, F.col("user_id")), F.col("event_id") % 10)
    n = t("events").where(F.col("event_type").isin("purchase", "signup")).groupBy(F.get_json_object("props", "$.k").alias("subject")).agg(F.count_distinct(actor).alias("n"))
    return n.where("n >= 2").withColumn("strength", F.least(F.lit(5), F.greatest(F.lit(3), F.col("n") + 1)).cast("long"))


@query("""SELECT assignee, count(*)::BIGINT AS n FROM (SELECT unnest(names) AS assignee FROM (SELECT string_split(p_name, ' ') AS names FROM part) WHERE list_has_any(names, ['small', 'widget'])) GROUP BY assignee""")
def assignee_counts(t):
    """How often each name stands in lists that hold one of the names sought."""
    lists = t("part").select(F.split("p_name", " ").alias("names")).where(F.arrays_overlap("names", F.array(F.lit("small"), F.lit("widget"))))
    return lists.select(F.explode("names").alias("assignee")).groupBy("assignee").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(DISTINCT user_id)::BIGINT AS competitors FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY event_type""")
def active_competitors(t):
    """How many of the configured names are mentioned since a day."""
    known = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return t("events").where("ts >= TIMESTAMP '2024-01-10'").join(known, "user_id", "left_semi").groupBy("event_type").agg(F.count_distinct("user_id").alias("competitors"))


@query("""SELECT event_type, count(*) FILTER (WHERE s >= 4 AND s < 6)::BIGINT AS yellow FROM (SELECT event_type, floor(value)::BIGINT % 10 AS s FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15') GROUP BY event_type""")
def yellow_summary(t):
    """Yellow items of a period by domain."""
    score = F.floor("value").cast("long") % 10
    e = t("events").where("ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
    return e.groupBy("event_type").agg(F.count_if(scores.level_of(score) == "yellow").alias("yellow"))


@query("""SELECT l_orderkey, round(100.0 * sum(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN l_quantity WHEN l_linestatus = 'O' THEN 0 END) / sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS score FROM lineitem GROUP BY l_orderkey""")
def weighted_checks(t):
    """The weight of passed checks in percent of all checks' weight; null without checks."""
    check, passed = F.col("l_linestatus") == "O", F.col("l_returnflag") == "N"
    weight = F.when(check, F.col("l_quantity"))
    return t("lineitem").groupBy("l_orderkey").agg(F.round(100.0 * F.sum(F.when(passed, weight).when(check, 0.0)) / F.sum(weight), 6).alias("score"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND nullif(o_orderpriority, '5-LOW') IS NULL ORDER BY o_orderkey DESC LIMIT 50""")
def stuck_rows(t):
    """The newest rows whose stage is done though its result is missing; a report of 50."""
    stuck = t("orders").where((F.col("o_orderstatus") == "F") & F.nullif("o_orderpriority", F.lit("5-LOW")).isNull())
    return rank.top(stuck.select("o_orderkey"), 50, F.desc("o_orderkey"))


@query("""SELECT p_partkey, array_to_string(CASE WHEN list_contains(s, 'widget') THEN s ELSE list_append(s, 'widget') END, '|') AS stages FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)""")
def stage_markers(t):
    """A stage is marked once, however often it runs."""
    s = F.split("p_name", " ")
    return t("part").select("p_partkey", F.array_join(F.when(F.array_contains(s, "widget"), s).otherwise(F.array_append(s, "widget")), "|").alias("stages"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN '{"k":' || json_extract_string(props, '$.k') || ',"stop":true}' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS payload FROM events""")
def json_set(t):
    """Sets a flag in a payload; others keep theirs."""
    told = F.from_json("props", "k long")
    stop = F.when(F.col("event_type") == "error", F.lit(True))
    return t("events").select("event_id", F.to_json(F.struct(told["k"].alias("k"), stop.alias("stop"))).alias("payload"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, event_type || '/' || user_id AS label, greatest(coalesce(CASE WHEN value < 50 THEN value END, 0), 10.0) AS most, nullif(event_type, 'error') AS kind,
len(list_filter([nullif(event_type, 'error'), nullif(event_type, 'click')], lambda x: x IS NOT NULL))::INT AS named FROM events""")
def scalar_forms(t):
    """Casts that may fail, joined strings, the larger of values that may be missing, blanks as nulls, arrays without nulls."""
    kind = F.nullif("event_type", F.lit("error"))
    most = F.greatest(F.coalesce(F.when(F.col("value") < 50, F.col("value")), F.lit(0.0)), F.lit(10.0))
    named = F.size(F.array_compact(F.array(kind, F.nullif("event_type", F.lit("click")))))
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("label"), most.alias("most"), kind.alias("kind"), named.alias("named"))


@query(f"""WITH e AS ({_EDGES}), m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT user_id, event_type AS domain, n::BIGINT AS mentions, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS nth FROM m),
g AS (SELECT src, count(DISTINCT dst) FILTER (WHERE label LIKE '1%')::BIGINT AS urgent, count(DISTINCT dst) FILTER (WHERE label LIKE '2%')::BIGINT AS high, count(DISTINCT dst) FILTER (WHERE label LIKE '3%')::BIGINT AS medium FROM e GROUP BY src)
SELECT user_id, domain, mentions, coalesce(urgent, 0) AS urgent, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium FROM d LEFT JOIN g ON src = 'c' || user_id WHERE nth = 1""")
def players_map(t):
    """Each entity's main domain by mentions, and its number of different neighbours by three kinds of edge."""
    m = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("mentions"))
    best = m.groupBy("user_id").agg(F.min_by(F.struct("event_type", "mentions"), F.struct(-F.col("mentions"), "event_type")).alias("b"))
    kinds = {"urgent": "1", "high": "2", "medium": "3"}
    e = edges(t).select("src", "dst", F.substring("label", 1, 1).alias("kind")).where(F.col("kind").isin(*kinds.values())).distinct()
    near = e.groupBy("src").agg(*(F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()))
    joined = best.join(near, F.col("src") == F.concat(F.lit("c"), "user_id"), "left")
    return joined.select("user_id", F.col("b.event_type").alias("domain"), F.col("b.mentions").alias("mentions"), *(F.coalesce(c, F.lit(0)).alias(c) for c in kinds))


@query(f"""WITH e AS ({_EDGES}), one AS (SELECT src, dst FROM e WHERE label LIKE '1%'), u AS (SELECT src AS a, dst AS b FROM one UNION SELECT dst, src FROM one)
SELECT DISTINCT a AS program, b AS bidder, e.src AS supplier FROM u JOIN e ON e.dst = b AND e.label LIKE '2%' WHERE a IN ('c1', 'c2', 'c3') AND e.src <> a""")
def directed_two_hop(t):
    """Who bids for a program, in either direction of the edge, and who supplies the bidder, in its direction only."""
    e = edges(t)
    one = e.where("label LIKE '1%'").select(F.col("src").alias("program"), F.col("dst").alias("bidder"))
    either = one.unionByName(one.select(F.col("bidder").alias("program"), F.col("program").alias("bidder"))).where(F.col("program").isin("c1", "c2", "c3")).distinct()
    supplies = e.where("label LIKE '2%'").select(F.col("src").alias("supplier"), F.col("dst").alias("bidder")).distinct()
    return either.join(supplies, "bidder").where("supplier <> program").select("program", "bidder", "supplier")
