"""Status machines as columns, and walks along parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lifecycle(published: Column, deadline: Column, today: Column, undated_days: int = 365, archive_days: int = 30) -> Column:
    """unknown before publication; closed past the deadline, or undated and old; archived when long closed; else open."""
    over = F.coalesce(deadline < today, published < F.date_sub(today, undated_days))
    stale = F.coalesce(deadline, published) < F.date_sub(today, archive_days)
    return F.when(published > today, "unknown").when(over, F.when(stale, "archived").otherwise("closed")).otherwise("open")


def maturation(matched: Column, age_days: Column, expire: int = 14, drop: int = 30) -> Column:
    return F.when(matched, "matured").when(age_days > drop, "dropped").when(age_days > expire, "expired").otherwise("open")


def reap(done: Column, expired: Column, stopped: Column, attempts: Column, most: int = 5) -> Column:
    """What becomes of a job: an expired lease fails if it was stopped or tried too often, else it is deferred."""
    return F.when(done, "done").when(~expired, "queued").when(stopped | (attempts >= most), "failed").otherwise("deferred")


def expiry(pending: Column, ends: Column, today: Column, soon_days: int) -> Column:
    return F.when(pending, "pending").when(ends.isNull(), "").when(ends <= today, "expired").when(ends <= F.date_add(today, soon_days), "soon").otherwise("")


def ancestors(children: DataFrame, start: int, depth: int) -> DataFrame:
    """(node, hops) from `start` up along (child, parent) rows, at most `depth` steps; a cycle ends with the bound."""
    level = children.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("hops"))
    found = level
    for hop in range(1, depth + 1):
        level = children.join(level, (F.col("child") == F.col("node")) & (F.col("node") > 1)).select(F.col("parent").alias("node"), F.lit(hop).alias("hops"))
        found = found.unionByName(level)
    return found
