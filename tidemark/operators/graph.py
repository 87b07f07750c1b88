"""Graphs as edge tables (src, dst): every step is one equi-join; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .rank import first_per


def both_ways(edges: DataFrame) -> DataFrame:
    """Different links in both directions: an OR over the two ends becomes a union and an equi-join."""
    e = edges.select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops) of all nodes within depth of the start nodes (column node), start included; hops is the least.

    Each hop joins only the nodes that the hop before has found. depth joins, whatever the graph.
    """
    e, seen = both_ways(edges), start.select("node", F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, depth + 1):
        found = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        front = found.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.union(front)
    return seen


def degrees(edges: DataFrame, least: int = 1) -> DataFrame:
    """Different neighbours of each node, in either direction."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("links")).where(F.col("links") >= least)


def two_hops(first: DataFrame, second: DataFrame, directed: bool = False) -> DataFrame:
    """Pairs (src, dst) joined by a link of the first kind, then one of the second; src itself is left out."""
    a, b = both_ways(first), second.select("src", "dst").distinct() if directed else both_ways(second)
    a = a.select(F.col("src").alias("start"), F.col("dst").alias("mid"))
    pairs = a.join(b, a["mid"] == b["src"]).where(F.col("start") != F.col("dst"))
    return pairs.select(F.col("start").alias("src"), "dst").distinct()


def shortest_path(edges: DataFrame, a, b, longest: int = 4) -> DataFrame:
    """One row (hops, path) for the shortest path of at most `longest` hops; of equal ones the least array. Empty if none."""
    e, front, found = both_ways(edges), None, None
    front = edges.sparkSession.range(1).select(F.lit(a).alias("node"), F.array(F.lit(a)).alias("path"))
    for hop in range(1, longest + 1):
        step = front.join(e, front["node"] == e["src"]).where(~F.array_contains("path", F.col("dst")))
        # of the ways to a node only the least is carried on: every shortest path is kept, and the front stays one row a node
        front = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.array_append("path", F.col("dst"))).alias("path"))
        at = front.where(F.col("node") == b).select(F.lit(hop).alias("hops"), "path")
        found = at if found is None else found.union(at)
    return found.orderBy("hops", "path").limit(1)


def summarise(edges: DataFrame) -> DataFrame:
    """Per (src, dst, label): weight (rows), first and last seen, and up to three newest items as text. Only three items of an edge are ever gathered."""
    keys = ["src", "dst", "label"]
    newest = first_per(edges, keys, [F.col("seen").desc_nulls_last(), F.col("item").desc_nulls_last()], 3, "nth").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nth", "item"))).alias("newest"))
    sums = edges.groupBy(*keys).agg(F.count("*").alias("weight"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    evidence = F.array_join(F.transform("newest", lambda x: x["item"].cast("string")), ",")
    return sums.join(newest, keys).select(*keys, "weight", "first_seen", "last_seen", evidence.alias("evidence"))


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): (node, root) of every node that has a link to another, root being the smallest node it reaches.

    Every round takes the smallest root among a node's neighbours, then that root's own root, so long paths shrink fast. The
    roots of each round are written to the shared folder; only a count comes to the driver. Null ends are left out.
    """
    spark = links.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = new_path(spark, "components")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    both = kept(both_ways(links.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    roots = kept(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        lower = kept(roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = kept(lower.join(jump, "root", "left").select("node", "old", F.coalesce("further", "root").alias("root")))
        roots = new.select("node", "root")
        if not new.where("old <> root").limit(1).count():
            return roots


def stories(items: DataFrame, *links: DataFrame) -> DataFrame:
    """(id, story_id, changed) of items (id, dedup_of, story_id): the smallest id that dedup links, other links and prior stories reach.

    A duplicate's target counts only if it is at hand; a prior story counts even where its root is not, which keeps old members
    together. Other links are (a, b) tables whose ends are at hand. Run again on its own result it changes nothing.
    """
    own = items.select(F.col("id").alias("b"))
    dedup = items.where("dedup_of IS NOT NULL").select(F.col("id").alias("a"), F.col("dedup_of").alias("b")).join(own, "b", "left_semi").select("a", "b")
    every = dedup.union(items.where("story_id IS NOT NULL").select(F.col("id").alias("a"), F.col("story_id").alias("b")))
    for more in links:
        every = every.union(more.select("a", "b"))
    roots = components(every)
    story = F.coalesce("root", "id")
    return items.join(roots, F.col("id") == F.col("node"), "left").select("id", story.alias("story_id"), (~F.col("story_id").eqNullSafe(story)).alias("changed"))


def neighbourhood(edges: DataFrame, nodes: DataFrame, start: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth of the start (node, rank): the start itself and the `most` best by rank, with a flag `truncated`; and the edges among them."""
    near = reach(edges, start, depth).join(nodes.select("node", "rank"), "node")
    ordered = near.withColumn("centre", F.col("hops") == 0).orderBy(F.col("centre").desc_nulls_last(), F.col("rank").desc_nulls_last(), "node")
    total = near.agg(F.count("*")).scalar()
    kept = ordered.limit(most).select("node", "hops", "rank", (total > most).alias("truncated"))
    return kept, edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
