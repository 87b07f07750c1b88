"""Tables in the folder that a cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; on a local master one in the warehouse will do, a cluster must name one."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(told or spark.conf.get('spark.sql.warehouse.dir').rstrip('/') + '/_shared').rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as Parquet at a fresh path, reread: its lineage ends there."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
