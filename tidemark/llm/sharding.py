"""Extendible hashing: shards are hash prefixes; only a prefix with too many bytes is split on another bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes that a shard may hold, and bits by which the directory deepens in one pass over what is still too large.
SHARD_BYTES, STEP = 1 << 20, 12
#: Bits of the hash: 64 of the key, then 64 of the row's own content and place.
BITS = 128


def _bits(key) -> F.Column:
    """64 binary digits of an MD5."""
    digits = F.md5(key.cast("binary"))
    return F.concat(*(F.lpad(F.conv(F.substring(digits, i, 8), 16, 2), 32, "0") for i in (1, 9)))


def directory(rows: DataFrame, limit: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """From (bits, bytes) rows: one row per shard with depth, shard (the prefix), shard_bytes and shard_rows.

    Every pass sums bytes by prefixes of up to `step` more bits (sums start before the exchange), keeps the prefixes that
    fit while the prefix one bit shorter does not, and goes on with those rows whose longest prefix is still too large.
    """
    left, depth, found = rows.select("bits", "bytes"), 0, []
    while True:
        last = min(depth + step, BITS)
        fine = left.groupBy(F.substring("bits", 1, last).alias("bits")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        levels = fine.select(F.explode(F.sequence(F.lit(depth), F.lit(last))).alias("depth"), "bits", "bytes", "rows")
        sums = levels.groupBy("depth", F.expr("substring(bits, 1, depth)").alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        sums = materialize(sums)
        # a single row, or rows that no bit can part, make a shard whatever its size
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
        up = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
        split = sums.where(fits & (F.col("depth") > depth)).withColumn("parent", F.expr("substring(shard, 1, depth - 1)")).join(up, ["depth", "parent"], "left_semi")
        found.append((split if depth else split.unionByName(sums.where(fits & (F.col("depth") == 0)), True)).select("depth", "shard", "shard_bytes", "shard_rows"))
        large = sums.where(~fits & (F.col("depth") == last)).select(F.col("shard").alias("of"))
        if last == BITS or not large.limit(1).count():
            break
        left = materialize(left.join(large, F.substring("bits", 1, last) == F.col("of"), "left_semi"))
        depth = last
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def shard(docs: DataFrame, doc_id="doc_id", text="text", limit: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """doc_id, bytes, shard (a string of bits), depth, shard_bytes and shard_rows of every row.

    bytes is the length of the text in UTF-8, null as 0. The first 64 bits hash the id (null: the text). Rows of one id can
    only part on the next 64, which hash the text and the row's place in the table: so repeated rows spread as well. A shard
    is over the limit only if it is one row. An empty table gives no rows.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.col(text)), F.lit(""))
    own = F.concat(F.xxhash64(text).cast("string"), F.lit(":"), F.monotonically_increasing_id().cast("string"))
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), size.alias("bytes"), F.concat(_bits(key), _bits(own)).alias("bits")))
    shards = materialize(directory(rows, limit, step))
    # A row's shard is the one directory entry that its bits begin with: look it up at every depth that the directory has.
    depths = [r[0] for r in shards.select("depth").distinct().orderBy("depth").collect()]  # at most BITS + 1 numbers
    looked = rows.select("doc_id", "bytes", "bits", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")).alias("depth"))
    looked = looked.select("doc_id", "bytes", "depth", F.expr("substring(bits, 1, depth)").alias("shard"))
    return looked.join(shards, ["depth", "shard"]).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_rows")
