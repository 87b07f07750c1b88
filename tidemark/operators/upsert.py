"""Upserts as joins: a table and its changes give the next table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_by_quality(old: DataFrame, new: DataFrame, key: str, digest: str, rank: str) -> DataFrame:
    """A row's content is replaced only if its digest changed and its rank is strictly higher; new keys are added."""
    a, b = old.select(key, *(F.col(c).alias(f"_a_{c}") for c in old.columns if c != key), F.lit(1).alias("_a")), new.select(key, *(F.col(c).alias(f"_b_{c}") for c in old.columns if c != key), F.lit(1).alias("_b"))
    better = F.col("_a").isNull() | (F.col("_b").isNotNull() & ~F.col(f"_a_{digest}").eqNullSafe(F.col(f"_b_{digest}")) & (F.col(f"_b_{rank}") > F.col(f"_a_{rank}")))
    return a.join(b, key, "full").select(key, *(F.when(better, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in old.columns if c != key))


def fill_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Only nulls are filled; new keys are added."""
    b = new.select(key, *(F.col(c).alias(f"_b_{c}") for c in old.columns if c != key))
    return old.join(b, key, "full").select(key, *(F.coalesce(c, f"_b_{c}").alias(c) for c in old.columns if c != key))


def append_versions(latest: DataFrame, new: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """New versions only: where a key is new or a field differs, numbered after the latest."""
    a = latest.select(key, F.col(version).alias("_v"), *(F.col(c).alias(f"_a_{c}") for c in fields))
    joined = new.select(key, *fields).join(a, key, "left")
    differs = F.col("_v").isNull()
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_a_{c}"))
    return joined.where(differs).select(key, (F.coalesce("_v", F.lit(0)) + 1).cast("long").alias(version), *fields)


def snapshot_delta(before: DataFrame, now: DataFrame, key: str, rank: str) -> DataFrame:
    """state of each key: new, gone, risen, fallen or same, by its rank in two snapshots."""
    a, b = before.select(key, F.col(rank).alias("was")), now.select(key, F.col(rank).alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") > F.col("was"), "risen").when(F.col("now") < F.col("was"), "fallen").otherwise("same")
    return a.join(b, key, "full").select(key, "was", "now", state.alias("state"))


def merge_entities(rows: DataFrame) -> DataFrame:
    """name (lower-cased), kind, aliases (united, sorted) and n of entities whose names differ in case only; rows: name, kind, aliases, seq.

    The first row's kind stays. Aliases are exploded before they are gathered, so that repeated ones shrink in the reading tasks.
    """
    keyed = rows.select(F.lower("name").alias("name"), "kind", "aliases", "seq")
    first = keyed.groupBy("name").agg(F.min_by("kind", "seq").alias("kind"), F.count("*").alias("n"))
    united = keyed.select("name", F.explode("aliases").alias("alias")).groupBy("name").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return first.join(united, "name", "left").select("name", "kind", "aliases", "n")


def replace_edges(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """src, dst, label, props, created of allowed labels: the latest item replaces earlier ones, the first time stays."""
    latest = F.max_by("item", F.struct("seen", "item"))
    return rows.where(F.col("label").isin(*labels)).groupBy("src", "dst", "label").agg(latest.alias("props"), F.min("seen").alias("created"))


def deactivate(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """stored with active false for keys that current doesn't name; without any current key nothing changes."""
    named = current.select(F.col(key).alias("_k")).distinct()
    some = named.agg(F.count("*") > 0).scalar()
    active = F.when(some, F.col("_k").isNotNull() & F.col("active")).otherwise(F.col("active"))
    return stored.join(named, F.col(key) == F.col("_k"), "left").select(*(active.alias(c) if c == "active" else F.col(c) for c in stored.columns))


def sync_actions(stored: DataFrame, derived: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and action: create, deactivate, update where a field differs (null is a value), else keep."""
    a = stored.select(key, *(F.col(c).alias(f"_a_{c}") for c in fields), F.lit(1).alias("_a"))
    b = derived.select(key, *(F.col(c).alias(f"_b_{c}") for c in fields), F.lit(1).alias("_b"))
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    action = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "deactivate").when(differs, "update").otherwise("keep")
    return a.join(b, key, "full").select(key, action.alias("action"))
