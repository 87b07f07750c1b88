"""Streams over the events: windows, sessions, first sights, and upserts; each runs over all that is there and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path


def events(spark: SparkSession, sf_dir: str, ts: str = "ts", delay: str = "60 days") -> DataFrame:
    """The events as a stream, a file at a time, with a watermark on their time."""
    path = f"{sf_dir}/events.parquet"
    # a pattern rather than a path, as the stream reader takes no single file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed(stream: DataFrame, window: Column, *keys: str) -> DataFrame:
    return stream.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_seen(stream: DataFrame, *keys: str) -> DataFrame:
    """One row per key; a key's state goes once the watermark (60 days late, see events) has passed it: a key that comes back later is new again."""
    return stream.dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def last_result(result: DataFrame, path: str | None = None) -> DataFrame:
    """The whole result after the last batch of an aggregation. path keeps state and results: a stopped stream goes on from there.

    Each batch goes to a folder of its own number, so that a batch done again does no harm.
    """
    path = path or new_path(result.sparkSession, "streams")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch_{number}")

    _run(result.writeStream.outputMode("complete").foreachBatch(write), path)
    return _newest(result.sparkSession, path, result.schema)


def appended(result: DataFrame, path: str | None = None) -> DataFrame:
    spark, path = result.sparkSession, path or new_path(result.sparkSession, "streams")
    _run(result.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out"), path)
    return spark.read.schema(result.schema).parquet(f"{path}/out")


def upserted(stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """A table kept by merging each batch into the version before it; a stopped stream goes on from the last version at path.

    Batch n reads the newest version below n that is on disk and writes version n, so a batch done again gives the same.
    """
    spark, path = stream.sparkSession, path or new_path(stream.sparkSession, "streams")

    def write(batch: DataFrame, number: int) -> None:
        last = _last(batch.sparkSession, path, number)
        old = None if last is None else batch.sparkSession.read.parquet(f"{path}/out/batch_{last}").drop("batch")
        merge(old, batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch_{number}")

    _run(stream.writeStream.outputMode("append").foreachBatch(write), path)
    return _newest(spark, path, None)


def _last(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The largest number of a written batch (below a bound): names of files only, by Spark's own file access."""
    done = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    try:
        names = [r[0] for r in done.load(f"{path}/out").select("path").collect()]
    except AnalysisException:  # nothing was written yet
        names = []
    numbers = [int(n.rsplit("/", 2)[1].removeprefix("batch_")) for n in names]
    return max((n for n in numbers if below is None or n < below), default=None)


def _newest(spark: SparkSession, path: str, schema) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/out/batch_{_last(spark, path)}").drop("batch")


def _run(writer, path: str) -> None:
    running = writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
