"""Latest rows, caps per group, top k, samples, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must end in something unique. Spark limits a key before it is exchanged."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def cap_per_group(df: DataFrame, keys: list[str], n: int, *order: Column, always: Column | None = None) -> DataFrame:
    """The first n rows of each group, and those that always stay. Spark limits a group before it is exchanged."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where((F.col("_nth") <= n) | (always if always is not None else F.lit(False))).drop("_nth")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """The rows of page `number` (from 1). A page has 200 rows at most: larger sizes are taken as 200, smaller than 1 as 1."""
    size = max(1, min(200, size))
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def seeded_sample(df: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """n rows by the smallest MD5 of key and seed: the same rows in every run."""
    return df.orderBy(F.md5(F.concat(key.cast("string"), F.lit(seed))), key).limit(n)


def first_non_null(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key: least order, number of rows, and each column's first value that isn't null in that order."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return df.groupBy(*keys).agg(F.min(order).alias(order), F.count("*").alias("n"), *first)


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int, nth: str) -> DataFrame:
    """The first n rows of each key with their place in a column `nth`. Spark limits a key before it is exchanged."""
    return df.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(nth) <= n)
