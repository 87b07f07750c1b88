"""The stream of exact duplicates: batches, stops, new files, weak digests, odd rows; beside plain grouping."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact

LONG = "Very long text " * 40_000
ROWS = [
    (1, "Hello World"), (2, "hello world"), (9, "HELLO WORLD"), (3, "hello  world"), (4, None), (5, ""), (6, None), (7, "É"), (8, "é"), (10, "İi"), (11, "i̇i"),
    (12, LONG), (13, LONG.upper()), (14, LONG + "."), (None, "of no one"), (None, "of no one"), (15, "Of No One"), (None, "alone"), (16, "twin"), (16, "twin"), (16, "Twin"), (17, "x" * 70_000), (18, " "),
]
COLUMNS = ("keep", "key", "n", "place", "norm", "sha", "kept", "group_size")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def told(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        stays = ids.index(best)
        out += [(i, best, len(ids), k == stays, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def put(spark, folder, rows, files=1, mode="append"):
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in COLUMNS}).repartition(files).write.mode(mode).parquet(f"{folder}/documents.parquet")


def run(spark, folder, files=1, **more):
    return exact.dedup(exact.file_stream(spark, folder, "documents", files), spark.read.parquet(f"{folder}/documents.parquet"), **more)


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_batches_and_weak_digests(spark, tmp_path, digest_bytes):
    """A file a batch; with a digest of a byte or none, hits of other bytes are told apart by the texts."""
    put(spark, tmp_path, ROWS + [(100 + i, f"text {i % 40}") for i in range(200)], files=6)
    found = got(run(spark, tmp_path, digest_bytes=digest_bytes))
    assert found == told(ROWS + [(100 + i, f"text {i % 40}") for i in range(200)])


def test_goes_on_with_new_files(spark, tmp_path):
    state = str(tmp_path / "state")
    put(spark, tmp_path, ROWS[:9])
    assert got(run(spark, tmp_path, path=state)) == told(ROWS[:9])
    put(spark, tmp_path, ROWS[9:], files=3)
    assert got(run(spark, tmp_path, path=state)) == told(ROWS)
    assert got(run(spark, tmp_path, path=state)) == told(ROWS)  # nothing new


def test_empty_table(spark, tmp_path):
    put(spark, tmp_path, [])
    assert got(run(spark, tmp_path)) == []


def test_store_is_as_it_was(spark, tmp_path):
    before = spark.conf.get(exact.STORE, None)
    put(spark, tmp_path, ROWS)
    run(spark, tmp_path)
    assert spark.conf.get(exact.STORE, None) == before
