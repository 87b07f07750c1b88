"""Secret scans: candidate spans by pattern, and how many owners and repositories in the whole corpus hold each value."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The kinds in their order, each with its pattern, the group that holds the value, and the value's least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Spans that only corpus-wide counts can tell from noise: long words that mix digits with both cases.
MIXED = ("mixed", r"[A-Za-z0-9+/_-]{32,}", 0, 32)
#: A value that this many owners hold is a copied example; with fewer it looks like its owner's own.
SHARED_OWNERS = 3
#: So is one in this many different repositories, however few owners they have.
SHARED_REPOSITORIES = 4


def matches(text: Column, place: int, pattern: str, group: int, least: int, salt: str, fits=lambda v: F.lit(True)) -> Column:
    """One struct for each of a pattern's leftmost matches that don't overlap, in order, in one pass over the text.

    place: the kind's number; gap: characters between the end of the match before and this one; n: its length; hash: salted
    SHA-256 of its value, null if the value is too short or doesn't fit. No value leaves this function in clear text.
    """
    pieces, found, values = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), group)
    both = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(found, F.length).alias("n"), values.alias("value"))
    hashed = lambda v: F.when((F.length(v) >= least) & fits(v), F.sha2(F.concat(F.lit(salt), v).cast("binary"), 256))
    made = F.transform(F.filter(both, lambda m: m["n"].isNotNull()), lambda m: F.struct(F.lit(place).alias("place"), m["gap"].alias("gap"), m["n"].alias("n"), hashed(m["value"]).alias("hash")))
    none = F.array().cast("array<struct<place:int,gap:int,n:int,hash:string>>")
    return F.when(text.rlike(pattern), made).otherwise(none)


def _spans(found: DataFrame) -> DataFrame:
    """row, owner, repo, place, start, end, hash of every match that counts: base spans, and mixed ones outside of them.

    A match starts where all gaps and matches of its kind before it end: running sums within a row, so the work follows the
    number of matches. A row's matches stand in one task, as its text did.
    """
    m = found.select("row", "owner", "repo", F.posexplode("matches").alias("nth", "m")).select("row", "owner", "repo", "nth", "m.*").repartition("row")
    until = Window.partitionBy("row", "place").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(until)).withColumn("start", F.col("end") - F.col("n")).where("hash IS NOT NULL")
    base = F.col("place") < len(KINDS)
    # both frames grow with their rows (one runs backwards); a frame that shrinks would be summed anew for every row
    frame = lambda order: Window.partitionBy("row").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    before = F.max(F.when(base, F.col("end"))).over(frame(F.asc("start")))
    after = F.min(F.when(base, F.col("start"))).over(frame(F.desc("start")))
    m = m.withColumn("before", before).withColumn("after", after)
    outside = F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    return m.where(base | outside).select("row", "owner", "repo", "place", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "hash")


def find_secrets(docs: DataFrame, doc_id="doc_id", text="text", owner="source", repository="lang", shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, how many values are live or shared, and the most owners and
    repositories of any value, for every row.

    A repository is a pair (owner, repository column). A candidate's value is hashed; over the whole corpus its different
    owners and repositories are counted. One that `shared_owners` owners or `shared_repositories` repositories hold, or more,
    is a widely copied example (shared), others look live. The method adds mixed spans: long words with digits and both cases that look live and lie in no base
    span. Base spans always stay.

    Null texts count as empty. A null owner is one owner, a null repository one repository of its owner. Repeated rows come
    back each and count as one owner. An empty table gives no rows. Columns of other names are not read. Values are hashed
    with a salt drawn for this run before anything is written or exchanged.
    """
    t, salt = F.coalesce(F.col(text), F.lit("")), uuid.uuid4().hex
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    every = [matches(t, i, *k[1:], salt) for i, k in enumerate(KINDS)] + [matches(t, len(KINDS), *MIXED[1:], salt, mixed)]
    found = docs.select(F.col(doc_id).alias("doc_id"), name(owner).alias("owner"), name(repository).alias("repo"), F.concat(*every).alias("matches"))
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()))  # row ids are fixed by being written

    spans = materialize(_spans(found.where(F.size("matches") > 0)))
    # Three sums, each started before its exchange: a value that a third of all rows hold shrinks to its owners at once.
    holders = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    holders = holders.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    judged = spans.join(holders, "hash").withColumn("live", (F.col("owners") < shared_owners) & (F.col("repos") < shared_repositories))
    is_base = F.col("place") < len(KINDS)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    per = judged.groupBy("row").agg(
        *(n(F.col("place") == i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)), n(is_base & F.col("live")).alias("n_live"), n(is_base & ~F.col("live")).alias("n_shared"),
        F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"), F.array_sort(F.collect_list(F.when(is_base | F.col("live"), F.struct("start", "place", "end")))).alias("s"),
    )
    names = F.array(*(F.lit(k[0]) for k in (*KINDS, MIXED)))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["place"]), x["start"], x["end"])), ",")
    per = per.select("row", *(f"n_{k[0]}" for k in KINDS), "n_live", "n_shared", "most_owners", "most_repos", joined(F.filter("s", lambda x: x["place"] < len(KINDS))).alias("base"), joined(F.col("s")).alias("spans"))
    done = found.select("row", "doc_id").join(per, "row", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    said = lambda c: F.coalesce(c, F.lit(""))
    return done.select(
        "doc_id", *(count(f"n_{k[0]}") for k in KINDS), F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"),
        *(count(c) for c in ("n_live", "n_shared", "most_owners", "most_repos")),
    )
