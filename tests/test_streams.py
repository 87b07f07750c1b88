"""Streams that stop and go on: state, versions and results lie at the path."""

from pyspark.sql import functions as F

from tidemark.streaming import runs


def test_a_stopped_upsert_goes_on_from_its_last_version(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "run")
    schema = "k long, v long"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def merge(old, batch):
        both = batch if old is None else old.unionByName(batch)
        return both.groupBy("k").agg(F.sum("v").alias("v"))

    put([(1, 1), (2, 5)])
    put([(1, 2)])
    assert dict(runs.upserted(stream(), merge, path).collect()) == {1: 3, 2: 5}
    put([(3, 7), (1, 4)])
    assert dict(runs.upserted(stream(), merge, path).collect()) == {1: 7, 2: 5, 3: 7}
    assert dict(runs.upserted(stream(), merge, path).collect()) == {1: 7, 2: 5, 3: 7}

    path = str(tmp_path / "sums")
    count = lambda: runs.last_result(stream().groupBy("k").agg(F.count("*").alias("n")), path)
    assert dict(count().collect()) == {1: 3, 2: 1, 3: 1}
    put([(2, 0)])
    assert dict(count().collect()) == {1: 3, 2: 2, 3: 1}
