"""Events of the stream as items of outlets that bear each other out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corroboration
from .registry import query

_SQL = """WITH i AS (SELECT event_id AS id, CASE WHEN event_id % 31 <> 0 THEN json_extract_string(props, '$.k') END AS host, CASE WHEN event_id % 37 <> 0 THEN event_type END AS domain,
  CASE WHEN event_id % 41 <> 0 THEN epoch_us(ts::TIMESTAMP) END AS t, ['u' || user_id, 'z' || user_id % 5, 'e' || event_id % 4] AS entities, CASE WHEN event_id % 29 = 0 THEN event_id - 1 END AS dedup_of,
  event_id % 7 = 0 AS official, event_id % 11 <> 0 AS in_scope, event_type AS kind, 'C' || event_id % 997 AS customer, CASE WHEN event_id % 3 = 0 THEN 'p' || user_id % 60 END AS program, value * pow(10, event_id % 7) AS amount FROM events),
able AS (SELECT *, coalesce(dedup_of, id) AS root FROM i WHERE t IS NOT NULL AND domain IS NOT NULL),
pairs AS (SELECT a.id, b.id AS other FROM able a JOIN able b ON a.root = b.root AND a.id <> b.id WHERE abs(a.t - b.t) <= 604800000000 AND coalesce(a.host <> b.host, true)
  UNION SELECT a.id, b.id FROM able a JOIN able b ON a.domain = b.domain AND a.id <> b.id AND abs(a.t - b.t) <= 604800000000 AND coalesce(a.host <> b.host, true) AND len(list_intersect(a.entities, b.entities)) >= 2
    AND (a.customer = b.customer OR a.program = b.program OR abs(a.amount - b.amount) <= 0.1 * greatest(a.amount, b.amount))),
g AS (SELECT id, count(*)::INT AS n, string_agg(other, ',' ORDER BY other) AS others FROM pairs GROUP BY id)
SELECT i.id, CASE WHEN t IS NULL OR domain IS NULL THEN 'unknown' WHEN n > 0 THEN 'corroborated' WHEN official THEN 'official_primary' ELSE 'single_source' END AS status, coalesce(n, 0)::INT AS n, coalesce(others, '') AS others
FROM i LEFT JOIN g ON i.id = g.id WHERE in_scope"""


def outlets(events):
    """(items, their events) of the stream."""
    key = F.col("event_id")
    items = events.select(
        key.alias("id"), F.when(key % 31 != 0, F.get_json_object("props", "$.k")).alias("host"), F.when(key % 37 != 0, F.col("event_type")).alias("domain"), F.when(key % 41 != 0, F.col("ts")).alias("at"),
        F.array(F.concat(F.lit("u"), F.col("user_id")), F.concat(F.lit("z"), F.col("user_id") % 5), F.concat(F.lit("e"), key % 4)).alias("entities"),
        F.when(key % 29 == 0, key - 1).alias("dedup_of"), (key % 7 == 0).alias("official"), (key % 11 != 0).alias("in_scope"),
    )
    told = events.select(
        key.alias("item_id"), F.col("event_type").alias("kind"), F.concat(F.lit("C"), key % 997).alias("customer"), F.when(key % 3 == 0, F.concat(F.lit("p"), F.col("user_id") % 60)).alias("program"),
        (F.col("value") * F.pow(F.lit(10), key % 7)).alias("amount"),
    )
    return items, told


def _told(found):
    return found.select("id", "status", "n", F.array_join("others", ",").alias("others"))


@query(_SQL)
def corroboration_records(t):
    """Who bears whom out, within a week on either side, by duplicates or by the same event."""
    return _told(corroboration.records(*outlets(t("events"))))


@query(_SQL)
def corroboration_sweep(t):
    """The same from the records of the days before the last, and what came on it."""
    events = t("events")
    late = F.col("ts") >= F.lit("2024-01-30").cast("timestamp")
    state = corroboration.records(*outlets(events.where(~late)))  # not written: lists of pairs are far larger than events
    items, told = outlets(events)
    return _told(corroboration.sweep(state, items, told, events.where(late).select(F.col("event_id").alias("id")), came=True))
