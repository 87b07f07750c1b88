"""Mixing sources to target weights: repetition rates from token totals, then floor(rate) copies and one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, words

#: Weights dealt to the sources in order of their names, again and again.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MAX_REPEATS = 3
SEED = "mix-1"


def text_size(text: Column | str) -> Column:
    """Number of words; a null text has none."""
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, size) rows: one row per source with source_size and target (double).

    Weights go round in code-point order of the names, the null source last. The sum of all sizes is shared by weight, a
    target stops at max_repeats times its source's size, and what is over is shared again by weight. That has a closed form:
    in order of max_repeats * size / weight, sources stop as long as theirs is below the level L that the rest gets per weight.
    Both windows run over one row per source, after the sizes have been summed.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    nth = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth + 1).cast("long"))
    most = F.col("source_size") * max_repeats
    by = Window.orderBy((most / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("nth", F.row_number().over(by))
    # The first source whose own stop is not below the level fixes it for itself and all that follow.
    fixed = F.min(F.when(most >= F.col("level") * F.col("weight"), F.struct("nth", "level"))).over(everything)["level"]
    target = F.least(most.cast("double"), F.coalesce(fixed, F.col("level")) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def chance(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the MD5 of seed and key: the same in every run and on every executor."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def copies(rate: Column, key: Column, nth: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more with the probability of the fraction, for the nth (from 0) of the rows that agree in their key.

    The key's one draw u places the rows at u, u + 1, ... along the rate: row n takes what lies between n * rate - u and
    (n + 1) * rate - u, so n rows together take n * rate, up to one. For the first row that is floor(rate) + (u < fraction).
    """
    u = chance(key, seed)
    return (F.ceil((nth + 1) * rate - u) - F.ceil(nth * rate - u)).cast("long")


def numbered(rows: DataFrame, key: str, row_id: str) -> DataFrame:
    """rows (a written table, row_id made by monotonically_increasing_id) with `nth`, from 0, among the rows of one key.

    Rows are counted per key and writing task first; each task's rows of a key are numbered apart and start where the tasks
    before end. So a key that a third of all rows hold is no one task's work.
    """
    task = F.shiftrightunsigned(F.col(row_id), 33)
    rows = rows.withColumn("__task", task)
    counts = rows.groupBy(F.col(key).alias("__k"), F.col("__task").alias("__t")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__k").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__k", "__t", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(key, "__task").orderBy(row_id)) - 1
    joined = rows.withColumn("__own", own).join(starts, (F.col(key) == F.col("__k")) & (F.col("__task") == F.col("__t")))
    return joined.withColumn("nth", (F.col("__start") + F.col("__own")).cast("long")).drop("__k", "__t", "__task", "__start", "__own")


def _repeated(keys: DataFrame) -> DataFrame | None:
    """The keys that several rows hold, as a written table; None if there are none. keys has the one column key."""
    found = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("again")))
    return found if found.limit(1).count() else None


def _rated(docs: DataFrame, targets: DataFrame, source: str) -> tuple[DataFrame, Column]:
    """docs with each row's source_size and target, and its rate. targets has one row per source."""
    t = small(targets.select(F.col("source").alias("__of"), "source_size", "target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return docs.join(t, docs[source].eqNullSafe(t["__of"]), "left").drop("__of"), rate


def _key(doc_id: str, text: str) -> Column:
    """What a row draws by: its id (null: none) and its text, so that rows of one id draw apart as long as their texts differ."""
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def mix_report(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, max_repeats=MAX_REPEATS, seed=SEED) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken = copies * size of every row.

    Null texts have size 0; null sources form one source of their own; rows with a null id draw by their text alone. Rows
    that agree in id and text share a draw and are numbered, so together they take their rate (see copies()); which of them
    takes one copy more is open, as they are equal. An empty table gives no rows. Of other columns nothing is read. The text
    is read once: sizes go into a narrow table in the shared folder, and only that is summed and joined.
    """
    key = _key(doc_id, text)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), text_size(text).alias("size"), key.alias("key"))
    sized = materialize(narrow.withColumn("row", F.monotonically_increasing_id()))
    targets = materialize(source_targets(sized, weights, max_repeats))
    again = _repeated(sized.select("key"))
    if again is not None:
        met = F.col("key") == F.col("again")
        one = sized.join(small(again), met, "left_anti").withColumn("nth", F.lit(0).cast("long"))
        sized = one.unionByName(numbered(sized.join(small(again), met, "left_semi"), "key", "row"))
    else:
        sized = sized.withColumn("nth", F.lit(0).cast("long"))
    rated, rate = _rated(sized, targets, "source")
    n = copies(rate, F.col("key"), F.col("nth"), seed)
    return rated.select("doc_id", "size", "source_size", "target", rate.alias("rate"), n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, max_repeats=MAX_REPEATS, seed=SEED) -> DataFrame:
    """docs, each row as often as the mix takes it (possibly not at all), with the columns of docs.

    Nulls, repeated rows and the draw are as in mix_report(); an empty table gives no rows. Only rows that agree in id and
    text with another one are written once more, to be numbered; the others go straight through.
    """
    narrow = docs.select(F.col(source).alias("source"), text_size(text).alias("size"), _key(doc_id, text).alias("key"))
    narrow = materialize(narrow)
    targets = materialize(source_targets(narrow, weights, max_repeats))
    again = _repeated(narrow.select("key"))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = plain.withColumn("key", _key(at[doc_id], at[text]))
    if again is not None:
        met = F.col("key") == F.col("again")
        written = materialize(plain.join(small(again), met, "left_semi").withColumn("row", F.monotonically_increasing_id()))
        one = plain.join(small(again), met, "left_anti").withColumn("nth", F.lit(0).cast("long"))
        plain = one.unionByName(numbered(written, "key", "row").drop("row"))
    else:
        plain = plain.withColumn("nth", F.lit(0).cast("long"))
    rated, rate = _rated(plain, targets, at[source])
    n = rated.withColumn("n", copies(rate, F.col("key"), F.col("nth"), seed)).where("n > 0")
    return n.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*(F.col(c).alias(old) for old, c in at.items()))
