"""Exact duplicates in a stream of documents: keyed state on disk without expiry, and whole texts compared where it is hit."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small

#: Files that a batch of the stream takes at most: what a lost batch does anew. Nothing is left out by it.
FILES = 4096
STORE = "spark.sql.streaming.stateStore.providerClass"
#: No disk is set aside in advance: a store that holds little takes little, however many partitions the state has.
SETTINGS = {STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normal(text: Column | str) -> Column:
    """What must be equal: the text with A-Z lowered and nothing else; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def file_stream(spark: SparkSession, folder: str, name: str, files: int = FILES) -> DataFrame:
    """The Parquet files of a table as a stream; a pattern stands for the path, as the reader takes no single file."""
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parque[t]")


@contextmanager
def _on_disk(spark: SparkSession) -> Iterator[None]:
    """State goes to RocksDB on the executors' disks, with its changes in the checkpoint, from where a lost executor's come back."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _located(docs: DataFrame, doc_id: str, text: str, digest_bytes: int) -> DataFrame:
    """(id, place, sha, key, norm): place is the file and the row in it, key the part of the digest that the state is kept by."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = docs.select(F.col(doc_id).alias("id"), place.alias("place"), normal(text).alias("norm"))
    sha = F.unhex(F.sha2(F.col("norm").cast("binary"), 256))
    return rows.withColumn("sha", sha).withColumn("key", F.substring("sha", 1, digest_bytes))


def stream_state(stream: DataFrame, path: str, doc_id="doc_id", text="text", digest_bytes: int = 32) -> DataFrame:
    """Runs the stream over all that is there and returns the state: (key, keep, n), one row per digest, as a written table.

    keep is the row that stays: its id (the largest) and its place, the locator of the content; n counts the rows so far.
    The state never expires. Rows are counted per digest before they are exchanged, so a text that a third of all rows hold
    comes to its state as one row a task. A stream stopped at any time goes on at `path`; new files are added to the old state.
    """
    spark = stream.sparkSession
    rows = _located(stream, doc_id, text, digest_bytes).groupBy("key").agg(F.max(F.struct("id", "place")).alias("keep"), F.count("*").alias("n"))
    with _on_disk(spark):
        # what changes is not written out batch by batch: the state itself is read when the stream has caught up
        running = rows.writeStream.outputMode("update").format("noop").option("checkpointLocation", path).trigger(availableNow=True).start()
        running.awaitTermination()
        return materialize(spark.read.format("statestore").load(path).select("key.key", F.col("value.max").alias("keep"), F.col("value.count").alias("n")))


def checked(docs: DataFrame, state: DataFrame, doc_id="doc_id", text="text", digest_bytes: int = 32) -> DataFrame:
    """(key, place, keep, n) of the rows whose digest hits a text of other bytes: their own group's, not the state's.

    All rows of a digest that was hit (n > 1) are grouped by their whole texts, counted before they are exchanged. Usually a
    digest has one group, that of the content at its locator, and the result is empty.
    """
    hit = small(state.where("n > 1").select("key"))
    texts = _located(docs, doc_id, text, digest_bytes).join(hit, "key", "left_semi")
    groups = texts.groupBy("key", "norm").agg(F.max(F.struct("id", "place")).alias("keep"), F.count("*").alias("n"))
    several = materialize(groups.groupBy("key").agg(F.count("*").alias("groups")).where("groups > 1").select("key"))
    few = small(several)
    own = groups.join(few, "key", "left_semi").select("key", "norm", "keep", "n")
    return materialize(texts.join(few, "key", "left_semi").select("key", "norm", "place").join(own, ["key", "norm"]).select("key", "place", "keep", "n"))


def dedup(stream: DataFrame, docs: DataFrame, path: str | None = None, doc_id="doc_id", text="text", digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs, the Parquet files that the stream reads.

    Texts are equal when identical after A-Z are lowered; a null text is empty, and empty texts are equal to each other. Of
    equal texts the row with the largest id stays: of repeated ids the one furthest on by file and row, so that exactly one
    row of a group has kept; null ids come last, and a group of null ids has a null keep_id. path is the folder of the
    stream's state (a new one in the shared folder if not given); a run after new files came goes on from it. The digest
    is SHA-256 (digest_bytes of it key the state); rows that share it with other bytes are parted by comparing whole texts.
    An empty table gives no rows. Of other columns nothing is read.
    """
    spark = docs.sparkSession
    state = stream_state(stream, path or f"{shared_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}", doc_id, text, digest_bytes)
    other = checked(docs, state, doc_id, text, digest_bytes)
    hit = small(state.where("n > 1"))  # whoever is alone in its digest stays
    rows = _located(docs, doc_id, text, digest_bytes).drop("norm").join(hit, "key", "left")
    rows = rows.withColumns({"keep": F.coalesce("keep", F.struct("id", "place")), "n": F.coalesce("n", F.lit(1))})
    if other.limit(1).count():
        own = small(other.select("key", "place", F.col("keep").alias("own_keep"), F.col("n").alias("own_n")))
        rows = rows.join(own, ["key", "place"], "left").withColumns({"keep": F.when(F.col("own_n").isNull(), F.col("keep")).otherwise(F.col("own_keep")), "n": F.coalesce("own_n", "n")})
    return rows.select(
        F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("place") == F.col("keep.place")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )

