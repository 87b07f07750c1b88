"""What the operators of this subpackage share: words, tables kept in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands between words: ASCII white space only, so that every engine counts alike.
GAP = r"[ \t-\r]+"
#: A table of at most so many narrow rows (a key and a few numbers) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master one in the warehouse will do, a cluster must name one."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return told or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it: the lineage ends there, and a lost executor loses nothing.

    The reread table also has a known size, which lets the planner choose joins by it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most `rows` rows, else df as it is (joined by shuffle)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column | str) -> Column:
    """The words of a text in order; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
