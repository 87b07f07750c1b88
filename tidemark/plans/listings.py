"""What reports list, over the driver's tables: markets, competitors, registries, matrices, counts, forecasts, searches, gates anew."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import names, prose, rules, scores
from ..functions.gates import host, within_domains
from ..functions.times import local_day
from ..operators import folds, listings, rank
from .registry import query

_DAY = "timezone('Asia/Jerusalem', timezone('UTC', ts::TIMESTAMP))::DATE"
_WINDOWS = f"""e AS (SELECT event_id, {_DAY} AS day FROM events),
w AS (SELECT DISTINCT 'week ' || date_trunc('week', day)::DATE AS "window", date_trunc('week', day)::DATE AS first, date_trunc('week', day)::DATE + 6 AS last FROM e
  UNION SELECT DISTINCT 'month ' || date_trunc('month', day)::DATE, date_trunc('month', day)::DATE, last_day(day) FROM e)"""
_AS_OF = dt.date(2000, 1, 1)
_NOW = dt.datetime(2024, 1, 20, 12)


def _reports(t):
    """Events by local day, and the weeks and months that they fall into as reports."""
    e = t("events").select("event_id", local_day(F.col("ts").cast("timestamp")).alias("day"))
    week, month = F.to_date(F.date_trunc("week", "day")), F.to_date(F.date_trunc("month", "day"))
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string")).alias("window")
    weeks = e.select(name("week ", week), week.alias("first"), F.date_add(week, 6).alias("last")).distinct()
    return e, weeks.unionByName(e.select(name("month ", month), month.alias("first"), F.last_day("day").alias("last")).distinct())


@query(f"""WITH {_WINDOWS} SELECT event_id, "window" FROM e JOIN w ON day BETWEEN first AND last""")
def reports_covering(t):
    return listings.covering(*_reports(t)).select("event_id", "window")


@query(f"""WITH {_WINDOWS}, r AS (SELECT event_id, count(*) AS reports, min("window") AS report FROM e JOIN w ON day BETWEEN first AND last GROUP BY 1)
SELECT event_id, source, p.ts AS parent_ts, reports, report FROM events LEFT JOIN documents ON doc_id = event_id LEFT JOIN (SELECT event_id AS pid, ts FROM events) p ON event_id % 7 = 3 AND pid = event_id - 2
LEFT JOIN r USING (event_id)""")
def job_provenance(t):
    """Events as jobs: the document of their id as item, an earlier event as what they go on from, the reports that cover them."""
    covered = listings.covering(*_reports(t)).groupBy("event_id").agg(F.count("*").alias("reports"), F.min("window").alias("report"))
    e = t("events").select("event_id", F.when(F.col("event_id") % 7 == 3, F.col("event_id") - 2).alias("pid"))
    parent, item = t("events").select(F.col("event_id").alias("pid"), F.col("ts").alias("parent_ts")), t("documents").select(F.col("doc_id").alias("event_id"), "source")
    return e.join(item, "event_id", "left").join(parent, "pid", "left").join(covered, "event_id", "left").select("event_id", "source", "parent_ts", "reports", "report")


@query("""WITH i AS (SELECT o_custkey AS report, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'),
f AS (SELECT o_custkey AS report, l_orderkey AS id, min(l_linenumber) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY ALL),
l AS (SELECT report, max(n) AS last FROM i GROUP BY 1)
SELECT * FROM i UNION ALL SELECT report, id, coalesce(last, 0) + row_number() OVER (PARTITION BY report ORDER BY seq, id) FROM f LEFT JOIN l USING (report)""")
def citation_registry(t):
    """Customers as reports: filled orders are numbered already, the orders of line items are told."""
    o = t("orders").select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    numbered = rank.first_per(o.where("o_orderstatus = 'F'"), ["report"], [F.col("id")], 2**31 - 1, "n")
    told = t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq")).join(o, "id")
    return listings.extend_registry(numbered, told).withColumn("n", F.col("n").cast("long"))


_MARKET = """x AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS name FROM lineitem),
m AS (SELECT o_orderkey AS id, o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) = 1997
  AND (c_nationkey = 7 OR o_orderkey IN (SELECT id FROM x JOIN supplier ON s_suppkey = name WHERE s_nationkey = 7)))"""


def _market(t):
    """Orders of 1997 with the suppliers that they name; the market is nation 7."""
    o = t("orders").where(F.year("o_orderdate") == 1997).join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    names = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("names"))
    return o.withColumnRenamed("o_orderkey", "id").join(names, "id", "left").select("id", "names", "c_nationkey", "o_totalprice")


@query(f"""WITH {_MARKET} SELECT id, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, id)::INT AS n FROM m QUALIFY n <= 250""")
def territory_items(t):
    local = t("supplier").where("s_nationkey = 7").select(F.col("s_suppkey").alias("name"))
    found = listings.market_items(_market(t), local, F.col("c_nationkey") == 7, 250, F.col("o_totalprice").desc_nulls_last(), F.col("id"))
    return found.select("id", "n")


@query("""WITH i AS (SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) = 1997 AND c_nationkey = 7),
a AS (SELECT l.* FROM lineitem l JOIN i ON id = l_orderkey), n AS (SELECT l_suppkey AS name, count(DISTINCT l_orderkey) AS mentions FROM a GROUP BY 1),
w AS (SELECT l_suppkey AS name, list(l_orderkey * 10 + l_linenumber ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC)[:5] AS wins FROM a WHERE l_returnflag = 'A' GROUP BY 1),
e AS (SELECT unnest([l_suppkey, l_suppkey + 1]) AS name FROM a WHERE l_linenumber = 1)
SELECT s_suppkey AS name, coalesce(mentions, 0) AS mentions, coalesce(wins, []) AS wins FROM supplier LEFT JOIN n ON n.name = s_suppkey LEFT JOIN w ON w.name = s_suppkey
WHERE s_acctbal >= 400 AND (s_nationkey = 7 OR mentions IS NOT NULL) AND (mentions IS NOT NULL OR wins IS NOT NULL OR s_suppkey IN (SELECT name FROM e)) ORDER BY 2 DESC, 1 LIMIT 15""")
def territory_competitors(t):
    """Suppliers with a balance of 400 or more as companies, line items returned as awards, the first line of an order as an edge."""
    items, key = _market(t).where("c_nationkey = 7"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    awards = t("lineitem").where("l_returnflag = 'A'").select(key.alias("id"), F.col("l_orderkey").alias("item"), F.col("l_shipdate").alias("day"), F.array("l_suppkey").alias("names"))
    edges = t("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1).alias("b"))
    companies = t("supplier").where("s_acctbal >= 400").select(F.col("s_suppkey").alias("name"), "s_nationkey")
    return listings.active_companies(companies, items, awards, edges, F.col("s_nationkey") == 7, 15)


@query("""WITH l AS (SELECT p_brand, p_type, arg_max(p_size, p_partkey) AS v FROM part GROUP BY ALL)
SELECT p_type, count(DISTINCT p_brand) AS carriers, count(DISTINCT v) AS "values", min(v) AS low, max(v) AS high FROM l WHERE p_type IN ('PROMO', 'LARGE', 'SMALL', 'NONE') GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2""")
def spec_comparison(t):
    """Brands as products: the size of each type's latest part as its value."""
    last = rank.latest(t("part").select("p_brand", "p_type", "p_size", "p_partkey"), ["p_brand", "p_type"], F.col("p_partkey").desc_nulls_last())
    return listings.spec_matrix(last, "p_brand", "p_type", "p_size", ["PROMO", "LARGE", "SMALL", "NONE"])


@query(f"""WITH l AS (SELECT p_brand AS line, l_shipdate, l_returnflag, l_linestatus FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT line, max(parts) AS parts, sum(week) AS week, sum(month) AS month, sum(returned) AS returned FROM (
  SELECT line, 0 AS parts, count(*) FILTER (l_shipdate::DATE >= DATE '{_AS_OF}' - 7) AS week, count(*) FILTER (l_shipdate::DATE >= DATE '{_AS_OF}' - 30) AS month,
    count(*) FILTER (l_returnflag = 'R' AND l_shipdate::DATE >= DATE '{_AS_OF}' - 90) AS returned FROM l GROUP BY 1
  UNION ALL SELECT p_brand, count(*), 0, 0, 0 FROM part GROUP BY 1) GROUP BY 1""")
def line_stats(t):
    """Brands as product lines: parts, lines shipped in a week and in a month, lines returned in ninety days."""
    lines = t("part").select("p_partkey", F.col("p_brand").alias("line"))
    shipped = t("lineitem").join(lines, F.col("l_partkey") == F.col("p_partkey"))
    since = lambda days: F.to_date("l_shipdate") >= F.date_sub(F.lit(_AS_OF), days)
    sources = {"parts": lines, "week": shipped.where(since(7)), "month": shipped.where(since(30)), "returned": shipped.where(since(90) & (F.col("l_returnflag") == "R"))}
    return listings.counts_by_line(sources)


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS name FROM lineitem WHERE l_linenumber <= 2)
SELECT DISTINCT l_orderkey AS id, l_suppkey AS src, l_partkey AS dst, l_returnflag AS label FROM lineitem JOIN i ON id = l_orderkey AND name IN (l_suppkey, l_partkey)""")
def item_edges(t):
    """Orders as items that mention the suppliers of their first two lines; each line as an edge from its supplier to its part."""
    names = t("lineitem").where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("names"))
    edges = t("lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("label"))
    return listings.item_edges(names, edges)


_PLATFORMS = {"licensed": "(?i)license", "secret": "password|token", "english": "tion ", "german": "sch"}
_HELD = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in _PLATFORMS.items())


@query(f"""WITH h AS (SELECT doc_id, lang, list_filter([{_HELD}], lambda x: x IS NOT NULL) AS held FROM documents), e AS (SELECT *, unnest(held) AS platform FROM h)
SELECT platform, lang AS country, count(*) AS n, min(doc_id) AS first, bool_or(platform = 'english' AND list_contains(held, 'german') OR platform = 'german' AND list_contains(held, 'english')) AS contradicted FROM e GROUP BY ALL""")
def forecast_candidates(t):
    """Documents as events of the country of their language; two of the platforms speak against each other."""
    events = t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), "text")
    return listings.forecast_candidates(events, _PLATFORMS, {"english": ("german",), "german": ("english",)})[0]


@query(f"""WITH q AS (SELECT conv_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, TIMESTAMP '{_NOW}' - to_hours(conv_id % 48) AS made FROM conversations WHERE turn = 0),
s AS (SELECT k, arg_max(conv_id, {{'m': made, 'c': conv_id}}) AS hit FROM q WHERE conv_id % 2 = 0 AND made >= TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR GROUP BY 1)
SELECT conv_id, hit FROM q LEFT JOIN s USING (k)""")
def cached_searches(t):
    """First turns as searches; those of even conversations were answered up to 47 hours ago, and hold for 24."""
    none, now = F.lit(None).cast("string"), F.lit(_NOW).cast("timestamp")
    key = prose.search_key(F.lit("web"), F.coalesce("text", F.lit("")), F.lit("en"), none, none, F.lit(None).cast("array<string>"))
    asked = t("conversations").where("turn = 0").select("conv_id", key.alias("key"))
    made = F.timestamp_micros(F.unix_micros(now) - (F.col("conv_id") % 48) * 3_600_000_000)
    store = asked.where("conv_id % 2 = 0").select("key", made.alias("made"), F.col("conv_id").alias("answer"))
    return listings.cached(asked, store, "key", now, 24).select("conv_id", "hit")


@query("""SELECT page_id FROM pages WHERE NOT regexp_matches(regexp_extract(lower(url), '^[^/]*//([^/:?#]*)', 1), '(^|\\.)(example\\.org|example\\.net)$') AND url <> ''""")
def allowed_hits(t):
    """Pages as hits of a search, without those of denied domains and what lies under them."""
    site = F.regexp_replace(host(F.col("url")), r"^www\.", "")
    return t("pages").where((F.col("url") != "") & ~within_domains(site, ("example.org", "example.net"))).select("page_id")


@query("""WITH f AS (SELECT l_suppkey, min(l_shipdate)::DATE AS day, bool_or(l_linestatus = 'O') AS told FROM lineitem GROUP BY 1)
SELECT s_suppkey, s_name, day::VARCHAR AS day FROM supplier JOIN f ON l_suppkey = s_suppkey WHERE told AND day BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' AND NOT regexp_matches(s_name, '0{8}1$')""")
def watchlist_changes(t):
    """Suppliers as entities seen first in half a year by an item in scope; one name stands for labels of exercises."""
    seen = t("lineitem").groupBy("l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("day"), F.max(F.col("l_linestatus") == "O").alias("told"))
    seen = seen.where(F.col("told") & F.col("day").between(F.lit(dt.date(1995, 1, 1)), F.lit(dt.date(1995, 6, 30))))
    named = t("supplier").where(~F.col("s_name").rlike("0{8}1$")).join(seen, F.col("s_suppkey") == F.col("l_suppkey"))
    return named.select("s_suppkey", "s_name", F.col("day").cast("string").alias("day"))


@query(f"""SELECT event_id, CASE WHEN regexp_matches(coalesce(json_extract_string(props, '$.k'), ''), '^[0-9]*$') THEN event_type ELSE json_extract_string(props, '$.k') END AS message,
  CASE WHEN value > 100 THEN 'heavy' ELSE 'light' END AS cause FROM events WHERE event_type ILIKE '%error%' AND ts BETWEEN TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{_NOW}' ORDER BY event_id DESC LIMIT 20""")
def recent_errors(t):
    """The twenty newest errors of a day; a message that is empty or a bare number says nothing, so the event's name stands for it."""
    told, now = F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.lit(_NOW).cast("timestamp")
    at = F.col("ts").cast("timestamp").between(now - F.expr("INTERVAL 24 HOURS"), now)
    e = rank.top(t("events").where(F.col("event_type").ilike("%error%") & at), 20, F.col("event_id").desc_nulls_last())
    message, cause = F.when(told.rlike("^[0-9]*$"), F.col("event_type")).otherwise(told), F.when(F.col("value") > 100, "heavy").otherwise("light")
    return e.select("event_id", message.alias("message"), cause.alias("cause"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01' AND o_orderpriority IS DISTINCT FROM '5-LOW'
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40""")
def notable_items(t):
    """The forty largest orders of a month, its end left out, that are no low ones and have no line returned."""
    start, end = F.lit(dt.datetime(1998, 1, 1)).cast("timestamp"), F.lit(dt.datetime(1998, 2, 1)).cast("timestamp")
    at = F.col("o_orderdate").cast("timestamp")
    o = t("orders").where((at >= start) & (at < end) & ~F.col("o_orderpriority").eqNullSafe(F.lit("5-LOW")))
    o = o.join(t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return rank.top(o.select("o_orderkey", "o_totalprice"), 40, F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey"))


@query("""SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS parties FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'P') AND o_orderdate::DATE BETWEEN DATE '1997-03-01' AND DATE '1997-05-31'
GROUP BY 1 HAVING list_has_any(list(l_suppkey), [1, 3, 5])""")
def watch_events(t):
    """Orders of two states and three months with one of three watched suppliers among their parties."""
    o = t("orders").where(F.col("o_orderstatus").isin("F", "P") & F.to_date("o_orderdate").between(F.lit(dt.date(1997, 3, 1)), F.lit(dt.date(1997, 5, 31))))
    lines = t("lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    parties = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("parties"))
    return parties.where(F.arrays_overlap("parties", F.array(*(F.lit(x).cast("long") for x in (1, 3, 5)))))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice, o_orderstatus, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' AND list_contains(string_split(o_orderpriority, '-'), 'HIGH'))
SELECT o_orderkey, total FROM s ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50""")
def tagged_page(t):
    """The second fifty of the open orders tagged high, and how many there are: counted apart, since only the page is carried."""
    s = t("orders").where((F.col("o_orderstatus") == "O") & F.array_contains(F.split("o_orderpriority", "-"), "HIGH"))
    page = rank.page(s.select("o_orderkey", "o_totalprice"), 2, 50, F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey"))
    return page.crossJoin(F.broadcast(s.agg(F.count("*").alias("total")))).select("o_orderkey", "total")


@query("""SELECT p_partkey, CASE WHEN starts_with(p_type, 'ECONOMY') THEN 'ECONOMY' ELSE 'STANDARD' END AS prefix FROM part WHERE starts_with(p_type, 'ECONOMY') OR starts_with(p_type, 'STANDARD')""")
def gate_violations(t):
    """Stored parts that the gate of codes would reject today, and the prefix for which it would."""
    prefix = rules.code_gate(F.array("p_type"), ("PROMO", "LARGE", "SMALL"), ("ECONOMY", "STANDARD"))
    return t("part").select("p_partkey", prefix.alias("prefix")).where("prefix IS NOT NULL")


@query(f"""WITH s AS (SELECT o_orderkey, o_shippriority_was AS was, CASE WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 WHEN o_totalprice > 0 THEN 1 ELSE 0 END
  + CASE WHEN d <= 30 THEN 2 WHEN d <= 90 THEN 1 ELSE 0 END AS now FROM (SELECT *, o_orderkey % 4 AS o_shippriority_was, abs(date_diff('day', o_orderdate::DATE, DATE '{_AS_OF}')) AS d FROM orders))
SELECT o_orderkey, was, now FROM s WHERE now < was""")
def score_demotions(t):
    """Orders whose score of today is below the stored one (here by id)."""
    days = F.abs(F.datediff(F.lit(_AS_OF), F.to_date("o_orderdate")))
    now = scores.tier_score(F.col("o_totalprice"), days, F.lit(False), 300_000, 100_000)
    return t("orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("was"), now.alias("now")).where("now < was")


@query("""SELECT doc_id FROM documents d WHERE n_chars >= 300 AND (contains(lower(text), 'license') OR contains(lower(text), 'password') OR contains(lower(text), 'token'))
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def vocabulary_candidates(t):
    """Documents of 300 characters with a word of the vocabulary that no label has processed."""
    words = F.lower("text").rlike("license|password|token")
    return t("documents").where((F.col("n_chars") >= 300) & words).join(t("labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("""WITH b AS (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS k, min(p_partkey) AS previous FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT p_partkey AS id, previous FROM part LEFT JOIN b ON k = lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) WHERE p_partkey % 2 = 0""")
def previous_trend(t):
    """Even parts as trends of now, odd ones as those before."""
    p = t("part").select(F.col("p_partkey").alias("id"), F.lower(F.trim(F.regexp_replace("p_name", r"\s+", " "))).alias("name"))
    return listings.same_title(p.where("id % 2 = 0"), p.where("id % 2 = 1"), F.col("name")).select("id", "previous")


@query("""WITH w AS (SELECT o_custkey, o_orderdate::DATE AS a, o_orderdate::DATE + 20 AS b, o_orderkey, o_totalprice, o_orderpriority FROM orders),
m AS (SELECT *, CASE WHEN max(b) OVER p IS NULL OR date_diff('day', max(b) OVER p, a) > 3 THEN 1 ELSE 0 END AS fresh FROM w WINDOW p AS (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, arg_max(o_orderkey, {'p': o_totalprice, 'k': -o_orderkey}) AS best, list_sort(list(DISTINCT o_orderpriority)) AS sources FROM i GROUP BY o_custkey, island""")
def forecast_topics(t):
    """Customers as topics, orders as forecasts with a window of twenty days: the dearest of each run, with all that backs it."""
    day = F.to_date("o_orderdate")
    f = t("orders").select("o_custkey", day.alias("a"), F.date_add(day, 20).alias("b"), "o_orderkey", "o_totalprice", F.array("o_orderpriority").alias("sources"))
    best = listings.best_of_runs(f, ["o_custkey"], "a", "b", 3, F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey"))
    return best.select("o_custkey", F.col("o_orderkey").alias("best"), "sources")


@query()
def pipeline_rows(t):
    """Orders as rows of their customer's pipeline: windows that begin and end within two weeks of each other become one."""
    day, price = F.to_date("o_orderdate"), F.col("o_totalprice")
    grade = F.when(price >= 300_000, "A").when(price >= 100_000, "B").otherwise("C")
    ends = F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, 20))
    rows = t("orders").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("nth"), F.col("o_orderkey").alias("id"), grade.alias("grade"), day.alias("first_day"), ends.alias("last_day"))
    return folds.merge_windows(rows, "o_custkey", ["o_orderstatus"])


_COMPANIES, _STRICT = {"License": ("licence", "licensed under the"), "Password": ("token", "secret"), "The": ("und",), "None": ()}, ("token", "und")
_WORD = lambda s: f"regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]){s}($|[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}])')"


def _mentions_sql() -> str:
    """A line for each company: its longest surface found, if one that isn't strict is found."""
    lines = []
    for name, aliases in _COMPANIES.items():
        surfaces = sorted((name, *aliases), key=lambda s: (-len(s), s))
        plain = " OR ".join(_WORD(s) for s in surfaces if s not in _STRICT)
        cases = " ".join(f"WHEN {_WORD(s)} THEN {-len(s)}" for s in surfaces)
        lines.append(f"SELECT doc_id, '{name}' AS name, CASE {cases} END AS size FROM documents WHERE {plain}")
    return f"WITH m AS ({' UNION ALL '.join(lines)}) SELECT doc_id, list(name ORDER BY size, name) AS named FROM m GROUP BY 1"


@query(_mentions_sql())
def company_mentions(t):
    """Documents that name one of some companies, two of whose aliases are strict, with all that they name."""
    named = names.mentioned(F.col("text"), _COMPANIES, _STRICT)
    return t("documents").select("doc_id", named.alias("named")).where(F.size("named") > 0)
