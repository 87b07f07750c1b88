"""What reports list: markets and who is active there, spans that cover a moment, numbered sources, matrices, counts, edges of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rank


def allowed(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The named columns that df has, in the given order: what it lacks or has beyond them is left out."""
    return df.select(*(f for f in fields if f in df.columns))


def covering(moments: DataFrame, windows: DataFrame) -> DataFrame:
    """moments (id, day, ...) with each window (window, first, last) whose days hold theirs, ends included; null days lie in none.

    Windows become days and meet the moments by day: an equi-join that shuffles, whatever the number of windows.
    """
    days = windows.where("first <= last").select("window", F.explode(F.sequence("first", "last")).alias("day"))
    return moments.join(days, "day")


def extend_registry(items: DataFrame, told: DataFrame) -> DataFrame:
    """report, id, n: the numbered items, and what else is told (report, id, seq), numbered on in order of its first place.

    Numbers go on after the report's largest, from 1 in a report without items. Null ids get no number.
    """
    first = told.where("id IS NOT NULL").groupBy("report", "id").agg(F.min("seq").alias("seq"))
    fresh = first.join(items.select("report", "id"), ["report", "id"], "left_anti")
    last = items.groupBy("report").agg(F.max("n").alias("last"))
    nth = F.row_number().over(Window.partitionBy("report").orderBy("seq", "id"))
    numbered = fresh.withColumn("nth", nth).join(last, "report", "left")
    return items.select("report", "id", "n").unionByName(numbered.select("report", "id", (F.coalesce("last", F.lit(0)) + F.col("nth")).alias("n")))


def market_items(items: DataFrame, local: DataFrame, here: Column, n: int, *order: Column) -> DataFrame:
    """The first n items (id, names, ...) of a market, with their place `n`: those that are `here`, or name one of the local names (name)."""
    by_name = items.select("id", F.explode("names").alias("name")).join(local.select("name"), "name", "left_semi").select("id").distinct()
    found = items.join(by_name.withColumn("_named", F.lit(True)), "id", "left").where(F.coalesce(here, F.lit(False)) | F.col("_named"))
    top = rank.top(found.drop("_named"), n, *order)
    return top.withColumn("n", F.row_number().over(Window.orderBy(*order)))  # n rows at most


def active_companies(companies: DataFrame, items: DataFrame, awards: DataFrame, edges: DataFrame, here: Column, n: int) -> DataFrame:
    """The n companies (name, ...) most often mentioned by a market's items: name, mentions, wins (five newest ids), newest first.

    items: id, names. awards: id, item, day, names. edges: item, a, b. A company counts if it is `here` or mentioned, and if an item
    mentions it, or an award of an item names it, or an edge of an item touches it. Equal mentions go by name.
    """
    of_market = items.select(F.col("id").alias("item")).distinct()
    mentions = items.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("mentions"))
    won = awards.join(of_market, "item", "left_semi").select("id", "day", F.explode(F.array_distinct("names")).alias("name"))
    won = rank.first_per(won, ["name"], [F.col("day").desc_nulls_last(), F.col("id").desc_nulls_last()], 5, "nth")
    wins = won.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda w: w["id"]).alias("wins"))
    touched = edges.join(of_market, "item", "left_semi").select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("edge", F.lit(True))
    joined = companies.join(mentions, "name", "left").join(wins, "name", "left").join(touched, "name", "left")
    counted = joined.where((here | F.col("mentions").isNotNull()) & (F.col("mentions").isNotNull() | F.col("wins").isNotNull() | F.col("edge")))
    shown = counted.select("name", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("wins", F.array().cast("array<long>")).alias("wins"))
    return rank.top(shown, n, F.col("mentions").desc(), F.col("name"))


def spec_matrix(latest: DataFrame, row: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """A row for each key of `keys` that two rows or more carry: key, carriers, values (different ones), low and high."""
    held = latest.where(F.col(key).isin(*keys) & F.col(value).isNotNull())
    out = held.groupBy(key).agg(F.countDistinct(row).alias("carriers"), F.countDistinct(value).alias("values"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.where("carriers >= 2")


def counts_by_line(sources: dict[str, DataFrame]) -> DataFrame:
    """line and a column for each source {name: frame with a column `line`}: how many rows it has; 0 where none. Each is counted before they meet."""
    counted = [df.groupBy("line").agg(F.count("*").alias("n")).select("line", F.lit(name).alias("of"), "n") for name, df in sources.items()]
    every = counted[0]
    for more in counted[1:]:
        every = every.unionByName(more)
    columns = [F.coalesce(F.sum(F.when(F.col("of") == name, F.col("n"))), F.lit(0)).alias(name) for name in sources]
    return every.groupBy("line").agg(*columns)


def item_edges(items: DataFrame, edges: DataFrame) -> DataFrame:
    """id, src, dst, label: the different edges (item, src, dst, label) told by an item (id, names) that touch a name it mentions."""
    e = edges.withColumnRenamed("item", "id").join(items.select("id", "names"), "id")
    return e.where(F.array_contains("names", F.col("src")) | F.array_contains("names", F.col("dst"))).select("id", "src", "dst", "label").distinct()


def forecast_candidates(events: DataFrame, platforms: dict[str, str], against: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """Platforms that events tell of, by country; and which event belongs to which. events: id, country (as a code), text.

    The first: platform, country, n, first (least id), contradicted, whether one of its events also has words of a platform against it.
    The second: id, platform, country. platforms: {key: pattern}, tested in one pass over the text. An empty text tells nothing.
    """
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), k) for k, p in platforms.items())))
    told = events.select("id", "country", hits.alias("held")).select("id", "country", "held", F.explode("held").alias("platform"))
    enemies = F.create_map(*(x for k, some in against.items() for x in (F.lit(k), F.array(*map(F.lit, some)))))
    clash = F.coalesce(F.arrays_overlap("held", F.try_element_at(enemies, F.col("platform"))), F.lit(False))
    groups = told.groupBy("platform", "country").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max(clash).alias("contradicted"))
    return groups, told.select("id", "platform", "country")


def cached(asked: DataFrame, store: DataFrame, key: str, now: Column, hours: float) -> DataFrame:
    """asked with `hit`, the stored answer (key, made, answer) where it is at most `hours` old at `now`; no hours, no answer."""
    fresh = store.where((F.lit(hours) > 0) & (F.unix_micros(now) - F.unix_micros("made") <= int(hours * 3_600_000_000)))
    last = fresh.groupBy(F.col(key).alias("_key")).agg(F.max_by("answer", F.struct("made", "answer")).alias("hit"))
    return asked.join(last, F.col(key) == F.col("_key"), "left").drop("_key")


def same_title(now: DataFrame, before: DataFrame, title: Column, id: str = "id") -> DataFrame:
    """now (id, ...) with `previous`, the least id of an earlier row of the same title (a column of both; null or empty titles match nothing)."""
    keyed = before.select(title.alias("_t"), F.col(id).alias("_p")).where("_t <> ''").groupBy("_t").agg(F.min("_p").alias("previous"))
    return now.withColumn("_n", title).join(keyed, F.col("_n") == F.col("_t"), "left").drop("_n", "_t")


def best_of_runs(rows: DataFrame, keys: list[str], start: str, end: str, gap_days: int, *order: Column) -> DataFrame:
    """The first row by `order` of each run of date windows of a key (see match.islands), with all sources of the run, `sources`.

    rows: keys, start, end, sources (array). Sources are exploded before they meet, so that repeated ones shrink early.
    Null keys are runs of their own too, but find no sources.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.datediff(F.col(start), before) > gap_days), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    at = [*keys, "island"]
    united = numbered.select(*at, F.explode("sources").alias("s")).groupBy(*at).agg(F.sort_array(F.collect_set("s")).alias("sources"))
    return rank.latest(numbered.drop("sources"), at, *order).join(united, at, "left")
