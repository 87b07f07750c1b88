"""What must hold at every size: verdicts that do not fade as the corpus grows, and that hold for documents of the same kind that no label names."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries
from tidemark.llm.common import table


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_rejects_what_is_like_junk(spark, sf):
    """Of documents that pass the plain rules one in twelve is labelled as junk; as many unlabelled ones go, and trusted documents whose labels were held back stay."""
    sf = f"/root/testdata/{sf}"
    labels = table(spark, sf, "labels").withColumn("back", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    told = labels.where("quality = 1 AND NOT back").select("doc_id")
    judged = quality.quality(table(spark, sf, "documents"), told).where("NOT base_failed").join(labels, "doc_id", "left")
    gone = {(r["quality"], r["back"]): r["gone"] for r in judged.groupBy("quality", "back").agg(F.avg(1 - F.col("kept").cast("int")).alias("gone")).collect()}
    assert gone[0, False] >= 0.94 and gone[1, False] <= 0.01 and gone[1, True] <= 0.01 and 0.05 <= gone[None, None] <= 0.09, gone


def test_bucket_count_follows_the_corpus():
    assert [quality.bucket_count(x) for x in (0, 495_892, 25_413_332, 172_961_921)] == [8192, 28672, 184320, 475136]
