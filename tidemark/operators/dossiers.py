"""What changed from one dossier of a product to the next: parameters by key or by likeness, deals by who, how much and what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import name_key
from ..functions.text import jaccard
from ..sources.shared import written

# Likeness from which a name or a value is taken for the same, and what stands for no customer.
NAME_LIKENESS, VALUE_LIKENESS = 0.5, 0.6
NO_CUSTOMER = r"(?i)^[\s\-—–_.]*$|^(?:n/?a|unknown|לא\s*ידוע|לא\s*צוין|אין\s*מידע|לא\s*מזוהה)[\s.]*$"


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{M}_]+"), 0))


def same_value(a: Column, b: Column) -> Column:
    """Equal but for case and blanks around, or with tokens alike by 0.6; an empty value is like an empty one only."""
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    return (F.lower(x) == F.lower(y)) | ((x != "") & (y != "") & (jaccard(tokens(x), tokens(y)) >= VALUE_LIKENESS))


def _indexed(rows: DataFrame, kind: str, found: Column, least: float, often: DataFrame) -> DataFrame:
    """(product, id, kind, token): of each row's tokens so many of the rarest that two rows alike by `least` must share one."""
    t = rows.select("product", "id", F.explode(found).alias("token")).join(often, ["product", "token"])
    w = Window.partitionBy("product", "id").orderBy("n", "token")
    t = t.withColumn("nth", F.row_number().over(w)).withColumn("all", F.count("*").over(Window.partitionBy("product", "id")))
    return t.where(F.col("nth") <= F.col("all") - F.ceil(F.col("all") * F.lit(least)) + 1).select("product", "id", F.lit(kind).alias("kind"), "token")


def like_pairs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(product, a, b, score): rows of one product whose names are alike by 0.5 (score 1 and more) or else whose values are the same.

    previous, current: product, id, name, value. Pairs meet by their rarest tokens only, so a word that every row has makes no
    pair; each pair is then judged by all tokens. Values without a token are the same if they are equal. Rows are written once to the
    shared folder, as each side serves many times.
    """
    previous, current = (written(rows.select("product", "id", "name", "value"), "parameters") for rows in (previous, current))
    pairs = []
    for kind, column, least in (("name", "name", NAME_LIKENESS), ("value", "value", VALUE_LIKENESS)):
        sides = [rows.select("product", "id", tokens(F.col(column)).alias("t")) for rows in (previous, current)]
        often = sides[0].unionByName(sides[1]).select("product", F.explode("t").alias("token")).groupBy("product", "token").agg(F.count("*").alias("n"))
        a, b = (_indexed(side, kind, F.col("t"), least, often) for side in sides)
        pairs.append(a.withColumnRenamed("id", "a").join(b.withColumnRenamed("id", "b"), ["product", "kind", "token"]).select("product", "a", "b"))
    bare = [rows.where((F.size(tokens(F.col("value"))) == 0) & (F.trim("value") != "")).select("product", F.col("id").alias(i), F.lower(F.trim("value")).alias("v")) for rows, i in ((previous, "a"), (current, "b"))]
    pairs.append(bare[0].join(bare[1], ["product", "v"]).select("product", "a", "b"))
    met = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()
    full = met.join(previous.select("product", F.col("id").alias("a"), F.col("name").alias("an"), F.col("value").alias("av")), ["product", "a"])
    full = full.join(current.select("product", F.col("id").alias("b"), F.col("name").alias("bn"), F.col("value").alias("bv")), ["product", "b"])
    by_name, by_value = jaccard(tokens(F.col("an")), tokens(F.col("bn"))), jaccard(tokens(F.col("av")), tokens(F.col("bv")))
    same = (F.trim("av") != "") & (F.trim("bv") != "") & same_value(F.col("av"), F.col("bv"))
    score = F.when(by_name >= NAME_LIKENESS, 1 + by_name).when(same, F.greatest(by_value, F.lit(VALUE_LIKENESS)))
    return full.select("product", "a", "b", F.round(score, 9).alias("score")).where("score IS NOT NULL")


def assigned(pairs: DataFrame) -> DataFrame:
    """(product, a, b): the pairs taken greedily, best score first, then the smaller b, then the smaller a; no row is in two of them.

    In each round all pairs are taken that are the best of both their rows; they go with all other pairs of those rows, until none
    is left. That is the same as one pass in order, and takes as many rounds as the longest chain of rows waiting for each other.
    Each round ends in a written table.
    """
    best = lambda k: F.row_number().over(Window.partitionBy("product", k).orderBy(F.col("score").desc(), "b", "a"))
    left, taken = written(pairs, "assigned"), None
    while left.limit(1).count():
        now = written(left.withColumn("of_a", best("a")).withColumn("of_b", best("b")).where("of_a = 1 AND of_b = 1").select("product", "a", "b"), "assigned")
        taken = now if taken is None else taken.unionByName(now)
        used_a, used_b = now.select("product", "a"), now.select("product", "b")
        left = written(left.join(used_a, ["product", "a"], "left_anti").join(used_b, ["product", "b"], "left_anti"), "assigned")
    return left.select("product", "a", "b") if taken is None else taken


def spec_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(product, id, change, name, before, after) of parameters: new, changed or retracted.

    previous, current: product, id (unique in its run), key, name, value, cited. Parameters meet by key; only where the previous
    run has rows but no key at all, by likeness, one to one. A change counts if it is cited: a new one with a value, one whose
    value isn't the same, one whose value is gone. A product without previous rows has no changes. Of equal keys the
    smallest id counts. Both runs are written once to the shared folder, whatever they are made of.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    previous, current = written(previous.select("product", "id", "key", "name", "value"), "parameters"), written(current.select("product", "id", "key", "name", "value", "cited"), "parameters")
    known = previous.groupBy("product").agg(F.max(blank("key") != "").alias("keyed"))
    now = current.join(known, "product")
    before = previous.join(known, "product")
    by_key = before.where("keyed").where(blank("key") != "").groupBy("product", "key").agg(F.min_by("value", "id").alias("before"), F.lit(True).alias("met"))
    keyed = now.where("keyed").join(by_key, ["product", "key"], "left")
    old, new = before.where("NOT keyed"), now.where("NOT keyed")
    pairs = assigned(like_pairs(old, new))
    met = pairs.join(old.select("product", F.col("id").alias("a"), F.col("value").alias("before")), ["product", "a"]).select("product", F.col("b").alias("id"), "before", F.lit(True).alias("met"))
    columns = ["product", "id", "name", "value", "cited", "before", "met"]
    rows = keyed.select(*columns).unionByName(new.join(met, ["product", "id"], "left").select(*columns))
    is_new = F.col("met").isNull() & (blank("value") != "")
    changed = F.col("met") & (blank("value") != "") & ~same_value(F.col("before"), F.col("value"))
    retracted = F.col("met") & (blank("value") == "") & (blank("before") != "")
    change = F.when(F.col("cited"), F.when(is_new, "new").when(changed, "changed").when(retracted, "retracted"))
    return rows.select("product", "id", change.alias("change"), "name", "before", F.col("value").alias("after")).where("change IS NOT NULL")


def deal_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(product, id, change) of cited deals: new, or dated where the same deal had no date before.

    previous, current: product, id, customer, amount, kind, date, cited. A deal is the same if customer (by name_key), amount (to
    the hundredth) and kind are; if that fails, if amount and kind are and the first previous one of them or this one names no
    customer. Of equal previous deals the smallest id counts. Products without previous rows have no changes.
    """
    nobody = lambda c: F.coalesce(c, F.lit("")).rlike(NO_CUSTOMER)
    customer = F.when(nobody(F.col("customer")), "").otherwise(name_key(F.col("customer")))
    amount, kind = F.coalesce(F.format_string("%.2f", F.col("amount").cast("double")), F.lit("")), F.coalesce("kind", F.lit(""))
    amount = F.when(F.col("amount").isNull(), "").otherwise(amount)
    told = lambda rows, *more: rows.select("product", "id", "customer", "date", *more, customer.alias("who"), amount.alias("sum"), kind.alias("what"))
    old = told(previous)
    exact = old.groupBy("product", "who", "sum", "what").agg(F.min_by(F.struct("date"), "id").alias("exact"))
    loose = old.groupBy("product", "sum", "what").agg(F.min_by(F.struct("date", nobody(F.col("customer")).alias("nobody")), "id").alias("loose"))
    rows = told(current, "cited").join(previous.select("product").distinct(), "product").join(exact, ["product", "who", "sum", "what"], "left").join(loose, ["product", "sum", "what"], "left")
    fits = F.col("exact").isNull() & F.col("loose").isNotNull() & (nobody(F.col("customer")) | F.col("loose.nobody"))
    date = F.when(F.col("exact").isNotNull(), F.col("exact.date")).when(fits, F.col("loose.date"))
    met = F.col("exact").isNotNull() | fits
    change = F.when(~met, "new").when(F.col("date").isNotNull() & date.isNull(), "dated")
    return rows.where("cited").select("product", "id", change.alias("change")).where("change IS NOT NULL")

