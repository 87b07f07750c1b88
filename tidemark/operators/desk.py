"""What an editor's desk asks of tables: repeats by words, relations told by events, reruns of one question, rows replaced by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, rank


def repeats_by_words(candidates: DataFrame, pool: DataFrame, least: int = 2) -> DataFrame:
    """id of each candidate (id, words) that shares at least `least` different words with another row of the pool (id, words).

    Each side is looked up only by its rarest words: of rows that share `least` words, one shared word is among all but the last
    least - 1 of either in the order of frequency. So the commonest words of a row, which would join everything with everything,
    are met only where rows have little else, and no pair is lost. Null arrays share nothing.
    """
    both = candidates.select("id", F.array_distinct("words").alias("words"), F.lit(True).alias("asks"))
    both = both.unionByName(pool.select("id", F.array_distinct("words").alias("words"), F.lit(False).alias("asks"))).where(F.size("words") >= least)
    often = both.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    spread = both.select("id", "asks", "words", F.explode("words").alias("word")).join(often, "word")
    ranked = spread.groupBy("id", "asks", "words").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("order"))
    keys = ranked.select("id", "asks", "words", F.explode(F.slice("order", 1, F.size("order") - (least - 1))).alias("key"))
    keys = keys.select("id", "asks", "words", F.col("key.word").alias("word"))
    a = keys.where("asks").select("id", "words", "word")
    b = keys.where("NOT asks").select(F.col("id").alias("other"), F.col("words").alias("held"), "word")
    near = (F.col("id") != F.col("other")) & (F.size(F.array_intersect("words", "held")) >= least)
    return a.join(b, "word").where(near).select("id").distinct()


def event_relations(events: DataFrame) -> DataFrame:
    """(src, dst, kind, n) from events (owner, customer, parties, kind, n): the owner to its customer and to each party but itself, once an event."""
    known = F.filter(F.array_append(F.coalesce("parties", F.array().cast("array<string>")), F.col("customer")), lambda p: F.coalesce(p, F.lit("")) != "")
    others = F.array_except(known, F.array("owner"))
    return events.select(F.col("owner").alias("src"), F.explode(others).alias("dst"), "kind", "n")


def best_of_reruns(entries: DataFrame, *links: DataFrame) -> DataFrame:
    """One row a group of entries (id, question, grade, at): group, best, reruns.

    A group is what equal questions (case and white space apart) and the links (a, b) of lineage join, known by its smallest id.
    The best has the highest grade, then the latest time, then the largest id. Null questions join nothing. Links to ids that
    aren't entries join what names them but are no one's best.
    """
    asked = entries.select("id", F.trim(F.regexp_replace(F.lower("question"), r"\s+", " ")).alias("q")).where("q <> ''")
    first = asked.groupBy("q").agg(F.min("id").alias("b"))
    edges = asked.join(first, "q").where("id <> b").select(F.col("id").alias("a"), "b")
    for more in links:
        edges = edges.unionByName(more.select("a", "b"))
    rooted = entries.join(graph.components(edges), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    best = F.max_by("id", F.struct("grade", "at", "id"))
    return rooted.groupBy("root").agg(F.min("id").alias("group"), best.alias("best"), (F.count("*") - 1).alias("reruns")).drop("root")


def replace_by_key(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with the rows of new in place of those of the same key, and new keys added; both have the columns of stored."""
    gone = new.select(F.col(key).alias("_k")).distinct()
    return stored.join(gone, F.col(key) == F.col("_k"), "left_anti").unionByName(new.select(*stored.columns))


def overlapping_owners(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, n) of the sets (owner, items) that hold at least one item of each name (name, item): exploded, met by item, counted once an owner."""
    held = sets.select("owner", F.explode(F.array_distinct("items")).alias("item"))
    return held.join(asked.select("name", "item").distinct(), "item").select("name", "owner").distinct().groupBy("name").agg(F.count("*").alias("n"))


def flag_known(df: DataFrame, history: DataFrame, keys: dict[str, str], flag: str) -> DataFrame:
    """df with a boolean column: whether history holds a row of equal keys ({column of df: column of history}); nulls equal nothing."""
    seen = history.select(*(F.col(h).alias(f"_h_{h}") for h in keys.values())).distinct().withColumn("_seen", F.lit(True))
    met = [F.col(c) == F.col(f"_h_{h}") for c, h in keys.items()]
    return df.join(seen, met, "left").select(*df.columns, F.coalesce("_seen", F.lit(False)).alias(flag))


def newest_lines(notes: DataFrame, kind: str, n: int, *order: Column) -> DataFrame:
    """The first n notes of each kind with their place (nth) and the number of all notes of the kind (total)."""
    total = notes.groupBy(F.col(kind).alias("_kind")).agg(F.count("*").alias("total"))
    first = rank.first_per(notes, [kind], list(order), n, "nth")
    return first.join(total, F.col(kind).eqNullSafe(F.col("_kind"))).drop("_kind")
