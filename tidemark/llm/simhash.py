"""SimHash near-duplicates: segment popcounts as a lower bound in a grid join, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, small
from .components import connected_components

SHINGLE = 3
HASH_SEED = 42
MAX_BITS = 3
#: Bits per segment whose popcounts make the embedding: 1, 2 or 4. Narrow segments give more keys and fewer candidates, so
#: two bits are taken up to so many fingerprints, and one bit beyond: both find every link.
SEGMENT, MANY, NARROW = 2, 1 << 23, 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits of a UTF-8 text: bit i is 1 if it is set in over half of the hashes of its shingles, repeats included.

    Only A-Z are lower-cased; words end at ASCII white space. A text of fewer words than a shingle is one shingle; without
    words it is 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), len(starts)
    for i in range(0, n, 1 << 16):
        spans = zip(starts[i : i + (1 << 16)].tolist(), ends[k - 1 + i : k - 1 + i + (1 << 16)].tolist(), strict=False)
        h = np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long; null texts count as empty."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = (fingerprint(t.as_buffer().to_pybytes(), shingle) for t in texts.cast(pa.binary()))
            yield pa.array(np.fromiter(found, dtype=np.uint64, count=len(texts)).view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def popcounts(half: Column, segment: int = SEGMENT) -> Column:
    """The embedding of 32 bits (as a long): popcounts of its segments, each in a field of `segment` bits of one long."""
    every = lambda v, mask: v.bitwiseAND(F.lit(mask).cast("long"))
    if segment >= 2:
        half = every(half, 0x55555555) + every(F.shiftright(half, 1), 0x55555555)
    if segment == 4:
        half = every(half, 0x33333333) + every(F.shiftright(half, 2), 0x33333333)
    return half


def links(fps: DataFrame, segment: int = SEGMENT, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of fps.fp that differ in at most max_bits (3 or fewer, as the docs say) bits; a pair may come twice.

    The Manhattan distance of two popcount vectors is at most the number of differing bits. With at most 3, the vectors'
    lower or upper halves are at distance 0 or 1. So every fingerprint stands in the grid cell of each of its halves, and
    looks into that cell and into those where one count is higher by one; of two that differ by one, the lower looks.
    Every link is met this way, none is lost. The join checks the whole fingerprints.
    """
    if max_bits > 3:
        raise ValueError("two halves cover at most 3 bits")
    fields = 32 // segment
    field = (1 << segment) - 1
    half = lambda i: F.shiftrightunsigned("fp", 32 * i).bitwiseAND(F.lit(0xFFFFFFFF))
    cells = fps.select("fp", F.inline(F.array(*(F.struct(F.lit(i).alias("half"), popcounts(half(i), segment).alias("cell")) for i in (0, 1)))))
    step = [F.when(F.shiftright("cell", segment * i).bitwiseAND(F.lit(field)) < segment, F.col("cell") + F.lit(1 << (segment * i))) for i in range(fields)]
    looks = cells.select("half", F.col("fp").alias("a"), "cell", F.explode(F.array_compact(F.array(F.col("cell"), *step))).alias("look"))
    looks = looks.select("half", "a", F.col("look").alias("at"), (F.col("look") == F.col("cell")).alias("own"))
    homes = cells.select("half", F.col("fp").alias("b"), F.col("cell").alias("at"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (~F.col("own") | (F.col("a") < F.col("b")))
    found = looks.join(homes, (looks["half"] == homes["half"]) & (looks["at"] == homes["at"]) & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def classes(fps: DataFrame, segment: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, class) for every distinct fp that has a link; class is the smallest linked fp, read as a signed number."""
    segment = segment or (SEGMENT if fps.limit(MANY + 1).count() <= MANY else NARROW)
    return connected_components(links(fps, segment, max_bits)).select(F.col("node").alias("fp"), F.col("component").alias("class"))


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", segment: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed long), fingerprint (hex) and component_id of every row.

    Equal fingerprints are merged before the join, so a third of all rows may be one text. component_id is the smallest
    id reachable; null ids are passed over, and a component of null ids only has null. Null and wordless texts have
    fingerprint 0 and link like others. Repeated rows each come back. An empty table gives no rows.
    """
    fps = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")))
    first = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    classed = materialize(first.join(classes(first, segment, max_bits), "fp", "left").select("fp", "first", F.coalesce("class", "fp").alias("class")))
    smallest = classed.groupBy("class").agg(F.min("first").alias("component_id"))
    by_fp = classed.join(smallest, "class").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id="doc_id", text="text", segment: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with the columns of docs: that of the smallest id (nulls last), of equal ids any one.

    Decisions are made on (id, hash of the text, fingerprint) alone. Texts are exchanged only for rows that come repeatedly
    with one id and text, and where the rows to go are too many to be broadcast. Null texts count as empty; an empty table
    gives no rows.
    """
    id_, h = fresh(docs, "id"), fresh(docs, "text_hash")
    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    narrow = materialize(docs.select(F.col(doc_id).alias("id"), text_hash.alias("h"), fingerprints(F.col(text)).alias("fp")))
    per = materialize(narrow.groupBy("fp", "id", "h").agg(F.count("*").alias("n")))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    first = materialize(per.groupBy("fp").agg(F.min(order).alias("first")))
    # Only fingerprints with links can lose their first row; that is a narrow table, and often a short one.
    linked = classes(first.select("fp"), segment, max_bits).join(first, "fp")
    best = linked.groupBy("class").agg(F.min_by("fp", "first").alias("best"))
    beaten = linked.join(best, "class").where("fp <> best").select(F.col("fp").alias("beaten"))
    state = per.join(first, "fp").join(beaten, F.col("fp") == F.col("beaten"), "left")
    stays = F.col("beaten").isNull() & (order == F.col("first"))
    odd = state.select("id", "h", F.when(~stays, "gone").when(F.col("n") > 1, "many").alias("state")).where("state IS NOT NULL")
    odd = materialize(odd)
    told = small(odd.select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("state").alias("__state")))
    marked = docs.withColumn(h, text_hash).withColumn(id_, F.col(doc_id))
    marked = marked.join(told, F.col(id_).eqNullSafe(F.col("__id")) & (F.col(h) == F.col("__h")), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = marked.where("__state IS NULL").select(*columns)
    if odd.where("state = 'many'").limit(1).count():
        kept = kept.unionByName(marked.where("__state = 'many'").dropDuplicates([id_, h]).select(*columns))
    return kept
