"""Documents as patents: classes, topics, clusters of like texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters
from .planting import quoted
from .registry import query

#: Words of topics, as the documents' languages have them.
TOPICS = {"english": ("the", "and", "that"), "german": ("und", "die", "der"), "spanish": ("que", "los", "las")}
_WORDS = r"list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}][\p{L}\p{N}_-]+'))"
_SHARED = ", ".join(f"struct_pack(n := len(list_intersect(w, [{', '.join(map(quoted, some))}])), o := {-i}, t := '{name}')" for i, (name, some) in enumerate(TOPICS.items()))


def _patents(t):
    classes = F.when(F.col("doc_id") % 4 == 0, F.array(F.concat(F.lit("C"), F.col("doc_id") % 7), F.lit("other")))
    return t("documents").select(F.col("doc_id").alias("id"), classes.alias("classes"), "text")


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT doc_id, list_max([{_SHARED}]) AS best FROM d),
k AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'C' || doc_id % 7 WHEN best.n >= 2 THEN best.t ELSE 'rest' END AS key FROM b)
SELECT key, count(*)::BIGINT AS n, min(doc_id) AS first FROM k GROUP BY key""")
def patent_groups(t):
    """Patents by first class, else by topic, else the rest, and how many."""
    found = clusters.classified(_patents(t), TOPICS)
    return found.groupBy(F.coalesce("by", F.lit("rest")).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query()
def patent_clusters(t):
    """Every patent's cluster; that of the rest depends on all before it, so tests hold it beside a plain pass."""
    return clusters.clustered(_patents(t), TOPICS)


@query()
def text_clusters(t):
    """Documents of each source in at most five clusters, with the terms that name them."""
    found = clusters.summaries(t("documents").select(F.col("source").alias("part"), F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("part").alias("source"), "cluster", "n", F.array_join("terms", " ").alias("terms"))
