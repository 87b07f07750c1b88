"""Which items other outlets bear out, for all items or for what a change touches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.keys import COMMON_NAMES
from ..sources.shared import written
from .dictionary import _small
from .meetings import Cell

#: Days on either side within which another item may bear one out, in microseconds, and the share of the larger amount by which close ones differ.
DAYS = 7
WEEK = DAYS * 86_400_000_000
CLOSE = 0.1
#: Of a cell, the items whose others a task lists, and the items among which it looks for them (some 100 bytes each).
CELL_MINE, CELL_OTHERS = 400_000, 4_000_000


def _plain(c: str) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _copies(able: DataFrame) -> DataFrame:
    """(id, copies): other items of the same root, week and hosts apart, in any order. Only roots that a duplicate names are looked at."""
    roots = able.where("dedup_of IS NOT NULL").select("root").distinct()
    rows = able.join(_small(roots), "root", "left_semi").select("id", "host", "t", "root", "week")
    weeks = rows.select(F.col("id").alias("i"), F.col("host").alias("h"), F.col("t").alias("u"), "root", F.explode(F.array(F.col("week") - 1, F.col("week"), F.col("week") + 1)).alias("week"))
    apart = (F.col("i") != F.col("id")) & (F.abs(F.col("t") - F.col("u")) <= WEEK) & ~F.coalesce(F.col("host") == F.col("h"), F.lit(False))
    return weeks.join(rows, ["root", "week"]).where(apart).groupBy(F.col("i").alias("id")).agg(F.collect_set("id").alias("copies"))


def _rows(items: DataFrame, events: DataFrame) -> DataFrame:
    """Items with all that decides whom they bear out: t, week (null without a time or domain), names, events and copies. By id, so it is exchanged by that once."""
    able = F.col("at").isNotNull() & F.col("domain").isNotNull()
    rows = items.withColumn("root", F.coalesce("dedup_of", "id")).withColumn("t", F.when(able, F.unix_micros(F.col("at").cast("timestamp"))))
    rows = rows.withColumn("week", F.floor(F.col("t") / WEEK)).withColumn("names", F.array_distinct(F.array_compact("entities")))
    event = F.struct("kind", _plain("customer").alias("customer"), _plain("program").alias("program"), F.col("amount").cast("double").alias("amount"))
    told = events.where("kind <> ''").groupBy(F.col("item_id").alias("id")).agg(F.collect_list(event).alias("events"))
    none = lambda c, like: F.coalesce(c, F.array().cast(like.schema[c].dataType)).alias(c)
    copies = _copies(rows.where("t IS NOT NULL"))
    met = rows.select("id", "domain", "official", "in_scope", "host", "t", "week", "names").join(told, "id", "left").join(copies, "id", "left")
    return met.select("id", "domain", "official", "in_scope", "host", "t", "week", none("names", rows), none("events", told), none("copies", copies))


def _cells(rows: DataFrame) -> DataFrame:
    """(d, w, first, lists, parts) for each domain and week with items that are mine: how many tasks share the lists of its items, how many parts
    the items among which their others are have, and the number of the first of these lists * parts cells. rows: domain, week, mine."""
    held = written(rows.where("week IS NOT NULL").groupBy("domain", "week").agg(F.sum(F.col("mine").cast("long")).alias("n"), F.count("*").alias("all")), "cells")
    beside = held.select("domain", F.explode(F.array(F.col("week") - 1, F.col("week"), F.col("week") + 1)).alias("week"), "all").groupBy("domain", "week").agg(F.sum("all").alias("others"))
    cells = held.where("n > 0").join(beside, ["domain", "week"])
    cells = cells.select(F.col("domain").alias("d"), F.col("week").alias("w"), "others", F.ceil(F.col("n") / CELL_MINE).alias("lists"), F.ceil(F.col("others") / CELL_OTHERS).alias("parts"))
    upto = F.sum(F.col("lists") * F.col("parts")).over(Window.orderBy("d", "w"))  # a row a domain and week
    return written(cells.withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("lists") * F.col("parts")), "cells")


def _met(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, official, others) for the rows of _rows() that have a time and domain and are mine (a column): who bears each out, in order.

    A cell has the rows of a domain and week that are mine, and those of the weeks beside it, so lists are found whole in one task and rows, not
    pairs, are exchanged. Only the lists of a cell in parts meet by id.
    """
    told = cells.agg(F.max("upto").alias("n"), F.max("parts").alias("parts"), F.sum(F.col("others") * F.col("lists")).alias("rows")).first()
    n = min(told["n"] or 1, -(-(told["rows"] or 0) // 2_000) or 1)  # small cells share tasks
    able = rows.where("week IS NOT NULL").withColumn("w", F.explode(F.array(F.col("week") - 1, F.col("week"), F.col("week") + 1)))
    near = able.join(_small(cells.withColumnRenamed("w", "v")), (F.col("domain") == F.col("d")) & (F.col("w") == F.col("v")))
    some = lambda c, salt: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.col(c))
    mine, other = F.col("mine") & (F.col("week") == F.col("w")), (F.size("names") >= 2) & (F.size("events") > 0)
    each = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    place = F.transform(each("lists"), lambda a: F.transform(each("parts"), lambda b: F.struct((F.col("first") + a * F.col("parts") + b).alias("cell"), (mine & (some("lists", 1) == a)).alias("mine"), (other & (some("parts", 2) == b)).alias("other"))))
    near = near.withColumn("place", F.explode(F.filter(F.flatten(place), lambda x: x["mine"] | x["other"])))
    wide = F.col("place.mine")
    near = near.select("place.cell", "place.mine", "place.other", "id", "t", "host", "names", "events", F.when(wide, F.col("official")).alias("official"), F.when(wide, F.col("copies")).alias("copies"))

    out = near.select("id", "official", "copies", F.array("id").alias("others"))
    schema = to_arrow_schema(out.schema)
    common = frozenset(COMMON_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, cell = None, None

        def left() -> Iterator[pa.RecordBatch]:
            for told, others in cell.lists(WEEK, CLOSE) if cell else ():
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*told.columns, others], schema.types, strict=True)], names=schema.names)

        for batch in batches:
            which = batch["cell"].to_numpy()
            starts = [0, *(i + 1 for i in range(len(which) - 1) if which[i] != which[i + 1])] if len(which) else []
            for at, to in zip(starts, [*starts[1:], len(which)], strict=True):
                if seen != which[at]:
                    yield from left()
                    seen, cell = which[at], Cell(common)
                cell.add(batch.slice(at, to - at), schema.names[:-1])
        yield from left()

    dealt = near.repartitionById(n, F.pmod("cell", F.lit(n)).cast("int")).sortWithinPartitions("cell", "id")
    found = dealt.mapInArrow(run, out.schema)
    if (told["parts"] or 1) > 1:
        found = found.groupBy("id").agg(F.first("official").alias("official"), F.first("copies").alias("copies"), F.array_sort(F.flatten(F.collect_list("others"))).alias("others"))
    return found.select("id", "official", F.when(F.size("copies") > 0, F.array_sort(F.array_union("others", "copies"))).otherwise(F.col("others")).alias("others"))


def _of(rows: DataFrame, of: DataFrame | None, mine: Column | None = None) -> DataFrame:
    """rows with mine: whether they are asked for."""
    mine = F.lit(True) if mine is None else F.coalesce(mine, F.lit(False))
    if of is None:
        return rows.withColumn("mine", mine)
    asked = of.select(F.col("id").alias("asked")).distinct()
    return rows.join(_small(asked), F.col("id") == F.col("asked"), "left").withColumn("mine", mine & F.col("asked").isNotNull()).drop("asked")


def _lists(items: DataFrame, rows: DataFrame, of: DataFrame | None, scope: Column | None = None) -> DataFrame:
    """_met() of rows; items: as for pairs(), of which cells are counted before anything is joined."""
    able = F.col("at").isNotNull() & F.col("domain").isNotNull()
    week = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / WEEK)
    return _met(_of(rows, of, scope), _cells(_of(items.where(able).withColumn("week", week), of, scope)))


def pairs(items: DataFrame, events: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, other) of items that bear each other out, once for each id in `of` (a column id; without it for all).

    items: id (unique), host, domain, at, entities (array), dedup_of. Both are at most 7 days apart and of different hosts (a null host is no one's).
    Either one is a duplicate of the other or both of a third; or they are of one domain, share two distinctive entities, and tell
    of the same event. Items without a time or domain bear out nothing.
    """
    return _lists(items, _rows(items, events), of).select("id", F.explode("others").alias("other"))


def records(items: DataFrame, events: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, status, n, others) of items in scope: corroborated, official_primary, single_source, or unknown without a time or domain.

    items: as for pairs(), with official and in_scope (booleans). others are the items that bear one out, in order.
    """
    return _records(items, _rows(items, events), of)


def _records(items: DataFrame, rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    found = _lists(items, rows, of, F.col("in_scope"))
    n = F.size("others")
    status = F.when(n > 0, "corroborated").when(F.col("official"), "official_primary").otherwise("single_source")
    unknown = _of(items.where("at IS NULL OR domain IS NULL"), of, F.col("in_scope")).where("mine")
    unknown = unknown.select("id", F.lit("unknown").alias("status"), F.lit(0).alias("n"), F.array().cast(found.schema["others"].dataType).alias("others"))
    return found.select("id", status.alias("status"), n.alias("n"), "others").unionByName(unknown)


def sweep(state: DataFrame, items: DataFrame, events: DataFrame, changed: DataFrame, came: bool = False) -> DataFrame:
    """The records after a change, from those before it: equal to records() over everything.

    state: records before; items, events: as they are now; changed: the ids that came, went or changed, their events too. Who bears whom out
    is mutual, so only the changed items and those that bore them out before or do so now are reckoned anew; the rest stays as it is.
    came: all of them came now, so no record before names them and state is read once.
    """
    ids = changed.select("id").distinct()
    rows = written(_rows(items, events), "rows")
    now = _lists(items, rows, ids).select(F.explode("others").alias("id"))
    touched = ids.unionByName(now)
    if not came:
        touched = touched.unionByName(state.select("id", F.explode("others").alias("o")).join(_small(ids.withColumnRenamed("id", "o")), "o", "left_semi").select("id"))
    touched = written(touched.distinct(), "touched")
    return state.join(_small(touched), "id", "left_anti").unionByName(_records(items, rows, touched))
