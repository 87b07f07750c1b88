"""What rises: counts of a period against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import local_day

ZONE = "Asia/Jerusalem"


def counted(items: DataFrame, left_out: tuple[str, ...] = ("out_of_scope",)) -> DataFrame:
    """Items that trends are taken from: clean, duplicates of nothing, of a domain that isn't left out. items: domain, status, dedup_of."""
    return items.where((F.col("status") == "clean") & F.col("dedup_of").isNull() & ~F.col("domain").isin(*left_out))


def surges(items: DataFrame, domain: str, ts: str, start: str, end: str, zone: str = ZONE, days: int = 28) -> DataFrame:
    """kind, subject, n, baseline (a week's mean over the 28 days before), ratio and strength of each domain that stands out.

    Days are calendar days of the zone, the last one left out. Without a baseline three items make a domain active; else a mean of 2,
    twice as many and 5 items make a surge.
    """
    age = F.datediff(F.lit(start).cast("date"), local_day(F.col(ts), zone))
    now = (age <= 0) & (F.datediff(F.lit(end).cast("date"), local_day(F.col(ts), zone)) > 0)
    before = age.between(1, days)
    counts = items.where(now | before).groupBy(F.col(domain).alias("subject")).agg(F.count(F.when(now, 1)).alias("n"), (F.count(F.when(before, 1)) / (days / 7)).alias("baseline"))
    ratio = F.when(F.col("baseline") > 0, F.col("n") / F.col("baseline"))
    strength = F.when(F.col("baseline") == 0, 3).when(ratio >= 4, 5).when(ratio >= 3, 4).otherwise(3)
    found = counts.where(((F.col("baseline") == 0) & (F.col("n") >= 3)) | ((F.col("baseline") >= 2) & (F.col("n") >= 2 * F.col("baseline")) & (F.col("n") >= 5)))
    return found.select(F.when(F.col("baseline") == 0, "domain_active").otherwise("domain_surge").alias("kind"), "subject", "n", "baseline", ratio.alias("ratio"), strength.alias("strength"))


def entity_clusters(events: DataFrame, entity: str, domain: str, source: Column, ts: str, start: str, end: str, zone: str = ZONE) -> DataFrame:
    """Entities with three or more events of one domain from two or more sources in the days from start, before end; strength is the number, 5 at most."""
    day = local_day(F.col(ts), zone)
    per = events.where((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date"))).groupBy(F.col(entity).cast("string").alias("entity"), F.col(domain).alias("domain"))
    found = per.agg(F.count("*").alias("n"), F.count_distinct(source).alias("n_sources")).where("n >= 3 AND n_sources >= 2")
    return found.withColumn("strength", F.least(F.lit(5), F.col("n")).cast("int"))


def converging(events: DataFrame, entity: str, domain: str, ts: str, start: str, end: str, zone: str = ZONE, least: int = 3) -> DataFrame:
    """Entities whose events of one local day, from start, before end, are of `least` domains or more: entity, domains (the most of a day), strength."""
    day = local_day(F.col(ts), zone)
    per = events.where((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date"))).groupBy(F.col(entity).cast("string").alias("entity"), day.alias("day"))
    most = per.agg(F.count_distinct(domain).alias("domains")).groupBy("entity").agg(F.max("domains").alias("domains"))
    return most.where(F.col("domains") >= least).withColumn("strength", F.least(F.lit(5), F.col("domains")).cast("int"))


def momentum(events: DataFrame, key: str, ts: str, end: str, zone: str = ZONE) -> DataFrame:
    """By days of the zone, this week's count against the mean of the four weeks before: percent of change, and up, down or flat at 15 percent."""
    age = F.datediff(F.lit(end).cast("date"), local_day(F.col(ts), zone))
    counts = events.where(age.between(1, 35)).groupBy(key).agg(F.count(F.when(age <= 7, 1)).alias("n"), (F.count(F.when(age > 7, 1)) / 4).alias("mean"))
    change = F.when(F.col("mean") > 0, 100 * (F.col("n") - F.col("mean")) / F.col("mean"))
    return counts.select(key, "n", "mean", F.round(change, 3).alias("change"), F.when(change > 15, "up").when(change < -15, "down").otherwise("flat").alias("direction"))
