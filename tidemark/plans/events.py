"""The event stream: trends, momentum, corroboration, usage, links in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.times import local_day, within
from ..operators import match, rank, trends
from .registry import query

# The report's week, and the four weeks before it.
START, END, BASE = "2024-01-24", "2024-01-31", "2023-12-27"
_WEEK = f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"

_SRC = "json_extract_string(props, '$.k')"

_DAY = "timezone('Asia/Jerusalem', timezone('UTC', ts::TIMESTAMP))::DATE"
_NOW = f"day >= DATE '{START}' AND day < DATE '{END}'"
#: Domains that rise: a third, half and a tenth of three kinds happened before the week, one kind only within it.
_ITEMS = f"""SELECT *, CASE WHEN event_id % 13 = 0 THEN 'flagged' ELSE 'clean' END AS status, CASE WHEN event_id % 17 = 0 THEN event_id - 1 END AS dedup_of,
  CASE WHEN user_id % 19 = 0 THEN 'out_of_scope' WHEN {_NOW} AND user_id % 10 = 1 THEN 'alert' WHEN NOT ({_NOW}) AND event_id % (CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 1 END) <> 0 THEN 'rest' ELSE event_type END AS domain
  FROM (SELECT *, {_DAY} AS day FROM events)"""
_SURGE = f"""SELECT CASE WHEN baseline = 0 THEN 'domain_active' ELSE 'domain_surge' END AS kind, subject, n, baseline, CASE WHEN baseline > 0 THEN n / baseline END AS ratio,
  CASE WHEN baseline = 0 THEN 3 WHEN n / baseline >= 4 THEN 5 WHEN n / baseline >= 3 THEN 4 ELSE 3 END AS strength FROM (
  SELECT domain AS subject, count(*) FILTER (WHERE {_NOW})::BIGINT AS n, count(*) FILTER (WHERE day < DATE '{START}') / 4.0::DOUBLE AS baseline FROM ({_ITEMS})
  WHERE day >= DATE '{BASE}' AND day < DATE '{END}' AND status = 'clean' AND dedup_of IS NULL AND domain <> 'out_of_scope' GROUP BY domain)
WHERE (baseline = 0 AND n >= 3) OR (baseline >= 2 AND n >= 2 * baseline AND n >= 5)"""
_CLUSTER = f"""SELECT entity, domain, n, n_sources, least(5, n)::INT AS strength FROM (SELECT user_id::VARCHAR AS entity, event_type AS domain, count(*)::BIGINT AS n, count(DISTINCT {_SRC})::BIGINT AS n_sources FROM (SELECT *, {_DAY} AS day FROM events) WHERE {_NOW} GROUP BY 1, 2) WHERE n >= 3 AND n_sources >= 2"""
_CONVERGING = f"""SELECT user_id::VARCHAR AS entity, max(domains)::BIGINT AS domains, least(5, max(domains))::INT AS strength FROM (SELECT user_id, day, count(DISTINCT event_type) AS domains FROM (SELECT *, {_DAY} AS day FROM events) WHERE {_NOW} GROUP BY user_id, day) GROUP BY user_id HAVING max(domains) >= 3"""


def source():
    return F.get_json_object("props", "$.k")


@query(_SURGE)
def domain_surge(t):
    """Domains that are new or rise, over the clean items of the report's week by local days."""
    day, shares = local_day(F.col("ts")), F.when(F.col("event_type") == "click", 10).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 3).otherwise(1)
    now = (day >= F.lit(START).cast("date")) & (day < F.lit(END).cast("date"))
    domain = F.when(F.col("user_id") % 19 == 0, "out_of_scope").when(now & (F.col("user_id") % 10 == 1), "alert").when(~now & (F.col("event_id") % shares != 0), "rest").otherwise(F.col("event_type"))
    items = t("events").withColumns({"domain": domain, "status": F.when(F.col("event_id") % 13 == 0, "flagged").otherwise("clean"), "dedup_of": F.when(F.col("event_id") % 17 == 0, F.col("event_id") - 1)})
    return trends.surges(trends.counted(items), "domain", "ts", START, END)


@query(_CLUSTER)
def entity_cluster_trend(t):
    return trends.entity_clusters(t("events"), "user_id", "event_type", source(), "ts", START, END)


@query(f"""SELECT kind, subject, n::BIGINT AS n, strength FROM (SELECT kind, subject, n, strength FROM ({_SURGE}) UNION ALL SELECT 'entity_cluster', entity || '/' || domain, n, strength FROM ({_CLUSTER}) UNION ALL SELECT 'convergence', entity, domains, strength FROM ({_CONVERGING}))""")
def detect_trends(t):
    """All detectors: domains that are new or rise, entities with many events of a domain, entities with many domains on a day."""
    a = domain_surge(t).select("kind", "subject", "n", "strength")
    b = entity_cluster_trend(t).select(F.lit("entity_cluster").alias("kind"), F.concat_ws("/", "entity", "domain").alias("subject"), "n", "strength")
    c = trends.converging(t("events"), "user_id", "event_type", "ts", START, END).select(F.lit("convergence").alias("kind"), F.col("entity").alias("subject"), F.col("domains").alias("n"), "strength")
    return a.union(b).union(c)


@query("""WITH d AS (SELECT ts::DATE AS day, list_sort(list_distinct(list(event_type))) AS kinds, user_id FROM events GROUP BY ts::DATE, user_id)
SELECT day::VARCHAR AS day, count(*)::BIGINT AS users, count(DISTINCT array_to_string(kinds, ','))::BIGINT AS sets FROM d GROUP BY day HAVING count(DISTINCT array_to_string(kinds, ',')) >= 2""")
def convergence(t):
    per = t("events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))
    return per.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("users"), F.count_distinct("kinds").alias("sets")).where("sets >= 2")


@query(f"""WITH a AS (SELECT user_id, count(*) FILTER (WHERE {_WEEK}) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '{START}') AS prev FROM events GROUP BY user_id)
SELECT user_id, n::BIGINT AS n, (n - prev)::BIGINT AS delta FROM a WHERE n > 0 ORDER BY n DESC, user_id LIMIT 10""")
def top_entities_delta(t):
    e, ts = t("events"), F.col("ts")
    now = F.count(F.when(within(ts, START, END), 1))
    before = F.count(F.when(within(ts, "2024-01-17", START), 1))
    return rank.top(e.groupBy("user_id").agg(now.alias("n"), (now - before).alias("delta")).where("n > 0"), 10, F.col("n").desc_nulls_last(), F.col("user_id"))


@query("""WITH c AS (SELECT event_type, count(*) FILTER (WHERE age <= 7)::BIGINT AS n, count(*) FILTER (WHERE age > 7) / 4.0::DOUBLE AS mean FROM (SELECT event_type, date_diff('day', timezone('Asia/Jerusalem', timezone('UTC', ts::TIMESTAMP))::DATE, DATE '2024-01-31') AS age FROM events) WHERE age BETWEEN 1 AND 35 GROUP BY event_type),
d AS (SELECT *, CASE WHEN mean > 0 THEN 100 * (n - mean) / mean END AS x FROM c) SELECT event_type, n, mean, round(x, 3) AS change, CASE WHEN x > 15 THEN 'up' WHEN x < -15 THEN 'down' ELSE 'flat' END AS direction FROM d""")
def momentum(t):
    return trends.momentum(t("events"), "event_type", "ts", "2024-01-31")


@query("""SELECT date_trunc('week', ts)::DATE::VARCHAR AS week, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2""")
def weekly_matrix(t):
    return t("events").groupBy(F.date_trunc("week", "ts").cast("date").cast("string").alias("week"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("""SELECT timezone('Asia/Jerusalem', timezone('UTC', ts::TIMESTAMP))::DATE::VARCHAR AS day, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def jerusalem_day_counts(t):
    return t("events").groupBy(local_day(F.col("ts")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(f"""SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (WHERE value > 50)::BIGINT AS large, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, count(DISTINCT {_SRC})::BIGINT AS sources FROM events GROUP BY event_type""")
def usage_summary_filter(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("large"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct(source()).alias("sources"))


@query(f"""SELECT event_type, {_SRC}::BIGINT AS k, count(*)::BIGINT AS n, count(*) FILTER (WHERE value > 50)::BIGINT AS large, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def usage_by_two_keys(t):
    return t("events").groupBy("event_type", source().cast("long").alias("k")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("large"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""SELECT event_id, {_SRC}::BIGINT AS k FROM events WHERE {_SRC} IS NOT NULL""")
def json_field_extract(t):
    return t("events").select("event_id", source().try_cast("long").alias("k")).where("k IS NOT NULL")


@query("""SELECT user_id, arg_max(event_type, event_id) AS outcome, count(*)::BIGINT AS rounds, max(event_id) AS last_id FROM events GROUP BY user_id""")
def latest_outcome(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("outcome"), F.count("*").alias("rounds"), F.max("event_id").alias("last_id"))


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' OR event_type <> 'error' QUALIFY event_type = 'error' OR row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3""")
def per_group_cap(t):
    return rank.cap_per_group(t("events"), ["user_id"], 3, F.col("value").desc_nulls_last(), F.col("event_id"), always=F.col("event_type") == "error").select("event_id", "user_id", "event_type")


@query(f"""WITH e AS (SELECT user_id, ts::DATE AS day, {_SRC} AS host, value FROM events), c AS (SELECT user_id, day, count(DISTINCT host)::BIGINT AS hosts, max(value) > 90 AS official FROM e GROUP BY user_id, day)
SELECT user_id, day::VARCHAR AS day, hosts, CASE WHEN hosts >= 2 THEN 'corroborated' WHEN official THEN 'official_primary' ELSE 'single_source' END AS status FROM c""")
def corroboration_status(t):
    c = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_distinct(source()).alias("hosts"), (F.max("value") > 90).alias("official"))
    return c.select("user_id", F.col("day").cast("string").alias("day"), "hosts", F.when(F.col("hosts") >= 2, "corroborated").when(F.col("official"), "official_primary").otherwise("single_source").alias("status"))


@query("""SELECT user_id, count(*)::BIGINT AS triggers, round(least(1.0, greatest(0.05, 0.30 + least(0.10 * (count(*) - 1), 0.30) + CASE WHEN max(value) > 90 THEN 0.20 ELSE 0 END + CASE WHEN min(ts) < TIMESTAMP '2024-01-03' THEN 0.15 ELSE 0 END)), 3)::DOUBLE AS likelihood FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def likelihood_score(t):
    p = t("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("triggers"), F.max("value").alias("most"), F.min("ts").alias("first"))
    return p.select("user_id", "triggers", scores.likelihood(F.col("triggers"), F.col("most") > 90, F.col("first") < F.lit("2024-01-03").cast("timestamp")).alias("likelihood"))


@query("""WITH g AS (SELECT min(event_id) AS id, user_id, list_distinct(list(event_type)) AS kinds, min(ts) AS t FROM events WHERE user_id <= 40 OR user_id > 40 GROUP BY user_id, ts::DATE),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.kinds, b.kinds)) AS shared FROM g a JOIN g b ON b.id > a.id AND a.user_id <> b.user_id AND abs(epoch_us(a.t) - epoch_us(b.t)) <= 600000000 AND len(list_intersect(a.kinds, b.kinds)) >= 2)
SELECT min(a) AS a, b, arg_min(shared, a)::BIGINT AS shared FROM p GROUP BY b""")
def interval_pair_link(t):
    g = t("events").groupBy("user_id", F.to_date("ts")).agg(F.min("event_id").alias("id"), F.collect_set("event_type").alias("kinds"), F.min("ts").alias("t"))
    return match.shared_within(g, "id", "kinds", "t", "user_id", 2, 600)


@query("""SELECT user_id, count(*)::BIGINT AS n, min(ts)::TIMESTAMP AS first_ts, max(ts)::TIMESTAMP AS last_ts, list_sort(list_distinct(list(event_type)))::VARCHAR[] IS NOT NULL AS has_kinds, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id""")
def entity_card(t):
    kinds = F.array_join(F.sort_array(F.collect_set("event_type")), ",")
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.lit(True).alias("has_kinds"), kinds.alias("kinds"))


@query("""SELECT event_id, user_id, least(10, s + CASE WHEN value / 100 >= 0.6 THEN 1 ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END) AS score FROM (SELECT *, [1,1,2,2,3,4,5,6,7,8,9,10,10][(least(15, greatest(3, floor(value / 7)::INT)) - 2)] AS s FROM events)""")
def score_of_components(t):
    s = scores.score_of_sum(F.floor(F.col("value") / 7))
    return t("events").select("event_id", "user_id", scores.focus_boost(s, F.col("value") / 100, F.col("event_type") == "purchase").alias("score"))


@query("""WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT x.user_id, y.event_type AS first_kind, x.event_type AS last_kind FROM f x JOIN f y USING (user_id) WHERE x.a = 1 AND y.b = 1 AND x.event_type <> y.event_type""")
def net_changes(t):
    key = F.struct("ts", "event_id")
    per = t("events").groupBy("user_id").agg(F.min_by("event_type", key).alias("first_kind"), F.max_by("event_type", key).alias("last_kind"))
    return per.where("first_kind <> last_kind")


_STAGES = ("click", "view", "signup", "purchase")


@query("""SELECT stage, n FROM (SELECT event_type AS stage, count(*)::BIGINT AS n FROM events WHERE event_type IN ('click', 'view', 'signup', 'purchase') GROUP BY 1 UNION ALL SELECT 'never', 0)""")
def zero_filled_levels(t):
    names = t("events").sparkSession.createDataFrame([(s,) for s in (*_STAGES, "never")], "stage string")
    counts = t("events").where(F.col("event_type").isin(*_STAGES)).groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    return names.join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT user_id, event_type, count(*)::BIGINT AS n, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS total, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id)::DOUBLE, 6) AS share FROM events GROUP BY user_id, event_type""")
def share_of_total(t):
    per = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return per.withColumn("total", total).withColumn("share", F.round(F.col("n") / F.col("total"), 6))


@query("""SELECT count(*)::BIGINT AS events, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30')::BIGINT AS last_day, count(DISTINCT user_id)::BIGINT AS users, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors, round(max(value), 4) AS most FROM events""")
def kpi_counts(t):
    one = lambda c: F.count(F.when(c, 1))
    return t("events").agg(F.count("*").alias("events"), one(F.col("ts") >= F.lit("2024-01-30").cast("timestamp")).alias("last_day"), F.count_distinct("user_id").alias("users"), one(F.col("event_type") == "error").alias("errors"), F.round(F.max("value"), 4).alias("most"))


def any_of(*conditions):
    return reduce(lambda a, b: a | b, conditions)


@query("""SELECT event_id, event_type FROM events WHERE (event_type ILIKE '%Sign%' OR value > 95) AND NOT (event_type = 'error') AND value IS NOT NULL ORDER BY value DESC NULLS LAST, event_id LIMIT 100 OFFSET 100""")
def filtered_listing(t):
    df = t("events").where(any_of(F.col("event_type").ilike("%Sign%"), F.col("value") > 95) & (F.col("event_type") != "error") & F.col("value").isNotNull())
    return rank.page(df, 2, 100, F.col("value").desc_nulls_last(), F.col("event_id")).select("event_id", "event_type")
