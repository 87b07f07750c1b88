"""Folds in order within a group: a row is compared with those kept before it. Groups are one report or one item, which are small."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, titles
from ..functions.titles import STORY_RATIO


def _title(text: str | None) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", (text or "").strip().casefold()).split())


def cluster_titles(items: DataFrame, group: str, least: float = STORY_RATIO) -> DataFrame:
    """id, cluster (the first member's id), is_primary. items: group, id, nth (their order), title, target, fields, score, hebrew.

    An item joins the first cluster with a member of the same target (its story, else what it duplicates, else itself) or of a
    near title; else it begins one. The richest member is primary: most fields, then score, then Hebrew; of equals the first.
    Empty titles are near to nothing.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list[tuple]] = []
        for r in rows.sort_values("nth").itertuples():
            mine = _title(r.title)
            near = lambda m: m[1] == r.target or (mine and m[2] and SequenceMatcher(None, mine, m[2]).ratio() >= least)  # noqa: E731, B023
            home = next((c for c in clusters if any(near(m) for m in c)), None)
            if home is None:
                clusters.append(home := [])
            home.append((r.id, r.target, mine, (r.fields, r.score, r.hebrew)))
        out = []
        for c in clusters:
            best = max(c, key=lambda m: m[3])  # the first of equals
            out += [(m[0], c[0][0], m is best) for m in c]
        return pd.DataFrame(out, columns=["id", "cluster", "is_primary"])

    return items.select(group, "id", "nth", "title", "target", "fields", "score", "hebrew").groupBy(group).applyInPandas(fold, "id long, cluster long, is_primary boolean")


def drop_redundant(sentences: DataFrame, report: str, least: float = 0.6) -> DataFrame:
    """id, kept, merged (ids of later sentences whose citations go to this one). sentences: report, id, priority, text.

    In order of priority, then id, a sentence goes if it says what a kept one says: its words overlap by `least`, or it shares a
    distinctive number and a capitalised name with it. What it cites goes to the first such sentence. Words, numbers and names
    are cut by Spark; only the order of decisions needs the fold.
    """
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace("text", r"\[\d+\]", " "), F.lit(r"(?U)\w{2,}"), 0), F.lower))
    cut = sentences.select(report, "id", "priority", words.alias("words"), keys.distinctive_numbers(F.col("text")).alias("numbers"), titles.names(F.col("text")).alias("names"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        out: dict[int, tuple[bool, list[int]]] = {}
        for r in rows.sort_values(["priority", "id"]).itertuples():
            w, n, o = set(r.words), set(r.numbers), set(r.names)
            same = lambda k: (w and k[1] and len(w & k[1]) / len(w | k[1]) >= least) or (n & k[2] and o & k[3])  # noqa: E731, B023
            first = next((k for k in kept if same(k)), None)
            out[r.id] = (first is None, [])
            if first is None:
                kept.append((r.id, w, n, o))
            else:
                out[first[0]][1].append(r.id)
        return pd.DataFrame([(i, k, m) for i, (k, m) in out.items()], columns=["id", "kept", "merged"])

    return cut.groupBy(report).applyInPandas(fold, "id long, kept boolean, merged array<long>")


def best_duplicates(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """id, match, score: of each candidate the best event of its item that tells of the same. Both: id, item, kind, title, parties.

    Of one kind: titles that aren't just equal, no conflict of parties, and the rule of titles.same_kind; the score is the larger
    of characters and tokens. Of another kind: characters must agree at 0.9. Ties take the smaller id.
    """
    e = events.select(F.col("id").alias("match"), "item", F.col("kind").alias("kind_b"), F.col("title").alias("title_b"), F.col("parties").alias("parties_b")).where("title_b IS NOT NULL")
    a, b = F.col("title"), F.col("title_b")
    pairs = candidates.join(e, "item").where(F.col("id") != F.col("match")).withColumn("char", titles.event_ratio(a, b)).withColumn("token", titles.token_score(a, b))
    same = F.col("kind").eqNullSafe(F.col("kind_b"))
    agree = (F.col("char") >= titles.TITLE_RATIO) | (F.col("token") >= titles.TOKEN_SCORE) | ((F.col("token") >= titles.WEAK_TOKEN) & (F.col("char") >= titles.WEAK_RATIO))
    apart = titles.both_lack(titles.numbers(a), titles.numbers(b)) | titles.both_lack(titles.names(a), titles.names(b)) | titles.parties_conflict(F.col("parties"), F.col("parties_b"))
    able = F.when(same, (titles.plain(a) != titles.plain(b)) & ~apart & agree).otherwise(F.col("char") >= titles.TITLE_RATIO)
    scored = pairs.where(able).withColumn("score", F.when(same, F.greatest("char", "token")).otherwise(F.col("char")))
    best = F.max(F.struct("score", (-F.col("match")).alias("m")))
    return scored.groupBy("id").agg(best.alias("best")).select("id", (-F.col("best.m")).alias("match"), F.col("best.score").alias("score"))


def merge_windows(rows: DataFrame, report: str, keys: list[str], days: int = 14) -> DataFrame:
    """cluster (the first member's id), best (the better grade's id, of equals the first), first_day, last_day, n.

    rows: report, keys, nth (their order), id, grade (A before B before C; null as C), first_day, last_day. A row joins the first
    cluster of its keys with a member both of whose days lie within `days` of its own; one without both days stands by itself. Rows
    come to a task sorted by their keys, so that many small groups cost no more than their rows; one group at a time is held.
    """

    def near(a, b) -> bool:
        return abs((a.first_day - b.first_day).days) <= days and abs((a.last_day - b.last_day).days) <= days

    def told(cluster: list) -> tuple:
        best = min(cluster, key=lambda r: r.grade)  # the first of equals
        firsts, lasts = ([d for d in (getattr(r, name) for r in cluster) if d is not None] for name in ("first_day", "last_day"))
        return cluster[0].id, best.id, min(firsts, default=None), max(lasts, default=None), len(cluster)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, clusters, columns = None, [], ["cluster", "best", "first_day", "last_day", "n"]
        for batch in batches:
            done: list[list] = []
            for r in batch.itertuples():
                if r.key != key:
                    done.extend(clusters)
                    key, clusters = r.key, []
                home = next((c for c in clusters if c[0].known and any(near(m, r) for m in c)), None) if r.known else None
                if home is None:
                    clusters.append(home := [])
                home.append(r)
            yield pd.DataFrame(map(told, done), columns=columns)
        yield pd.DataFrame(map(told, clusters), columns=columns)

    known = (F.col("first_day").isNotNull() & F.col("last_day").isNotNull()).alias("known")
    key = F.to_json(F.struct(report, *keys)).alias("key")
    cut = rows.select(key, "nth", "id", F.coalesce("grade", F.lit("C")).alias("grade"), "first_day", "last_day", known)
    return cut.repartition("key").sortWithinPartitions("key", "nth", "id").mapInPandas(fold, "cluster long, best long, first_day date, last_day date, n long")
