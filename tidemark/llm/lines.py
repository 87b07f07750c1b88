"""Line dedup: a line that a large share of a site's pages holds is boilerplate there and goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize, small

#: A line goes if more than this share of the host's pages hold it, and at least so many pages.
MAX_RATIO, MIN_PAGES = 0.05, 5
#: The lists of boilerplate are broadcast if they hold at most so many lines (8 bytes each); else pages are exchanged by host, and
#: a host is parted into one part for so many of its pages.
BROADCAST_LINES, PART_PAGES = 4_000_000, 20_000


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without user and port; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def text_runs(html: Column) -> Column:
    """The text between the tags of a page, one run per line."""
    return F.regexp_replace(html, "<[^>]+>", "\n")


def _bare(line: Column) -> Column:
    """A line as it is compared: without white space at its ends."""
    return F.regexp_replace(line, r"^[ \t-\r]+|[ \t-\r]+$", "")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio=MAX_RATIO, min_pages=MIN_PAGES) -> DataFrame:
    """One row per host that has boilerplate: host, total (its pages), lines (hashes of its boilerplate lines).

    Both counts are sums that start in the reading tasks, over 16 bytes per distinct line of a page. A host's list is
    short whatever its size: its pages hold L lines on average, so fewer than L / max_ratio lines can pass.
    """
    seen = docs.select(host.alias("host"), F.array_distinct(F.transform(F.filter(_lines(text), lambda x: x.rlike(r"[^ \t-\r]")), lambda x: F.xxhash64(_bare(x)))).alias("lines"))
    # the page itself is counted as the line null
    rows = seen.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.col("lines"))).alias("line"))
    n = rows.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("line").isNull() | (F.col("n") >= min_pages))
    n = materialize(n)
    total = n.where("line IS NULL").select(F.col("host").alias("h"), F.col("n").alias("total"))
    often = n.where("line IS NOT NULL").join(total, F.col("host").eqNullSafe(F.col("h")))
    return often.where(F.col("n") > max_ratio * F.col("total")).groupBy("host").agg(F.max("total").alias("total"), F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio=MAX_RATIO, min_pages=MIN_PAGES, max_broadcast: int = BROADCAST_LINES, part_pages: int = PART_PAGES) -> DataFrame:
    """docs with two more columns at the end: `lines` (how many with a word) and `text` (what stays), under fresh names.

    Blank lines stay where they are. Null hosts are one host; a null text counts as empty and becomes empty; repeated rows
    each count as a page. An empty table gives no rows. Lines are compared by 64-bit hashes of their trimmed text.
    """
    listed = materialize(boilerplate(docs, host, text, max_ratio, min_pages))
    at, part, bad, total, left = (fresh(docs, c) for c in ("at_host", "at_part", "bad", "n_lines", "left"))
    # A few long lists weigh as much as many short ones: what is broadcast is bounded by the lists' lines.
    weight = listed.agg(F.coalesce(F.sum(F.size("lines") + 8), F.lit(0))).first()[0]
    few = weight <= max_broadcast
    parts = F.lit(1) if few else F.ceil(F.col("total") / part_pages).cast("int")
    listed = listed.withColumn("parts", parts)
    named = listed.select(F.col("host").alias(at + "_"), F.col("lines").alias(bad), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(part + "_"))
    marked = docs.withColumn(at, host).withColumn(left, _lines(text))
    if few:
        marked = marked.withColumn(part, F.lit(0))
    else:  # the pages of a large host are dealt over its parts, whatever they hold; there is one such host for part_pages pages at most
        hot = small(listed.where("parts > 1").select(F.col("host").alias(part + "_h"), F.col("parts").alias(part + "_n")))
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(F.col(part + "_n"), F.lit(1)).cast("long")).cast("int")
        marked = marked.join(hot, F.col(at).eqNullSafe(F.col(part + "_h")), "left").withColumn(part, dealt)
    joined = marked.join(F.broadcast(named) if few else named, F.col(at).eqNullSafe(F.col(at + "_")) & (F.col(part) == F.col(part + "_")), "left")
    worded = lambda x: x.rlike(r"[^ \t-\r]")
    # one hashed intersection per page; then only the lines it found are looked for. Lists hold no blank lines: those stay.
    without = lambda hs, hit: F.filter(left, lambda x, i: ~F.array_contains(hit, F.get(hs, i)))
    some = lambda hs: let(F.array_intersect(hs, F.col(bad)), lambda hit: F.when(F.size(hit) == 0, F.col(left)).otherwise(without(hs, hit)))
    kept = let(F.transform(left, lambda x: F.xxhash64(_bare(x))), some)
    n = F.size(F.filter(left, worded)).cast("long")
    stays = F.when(F.col(bad).isNull(), F.col(left)).otherwise(kept)
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), n.alias(total), stays.alias(left))


def line_report(pages: DataFrame, page_id="page_id", url="url", html="html", max_ratio=MAX_RATIO, min_pages=MIN_PAGES, max_broadcast: int = BROADCAST_LINES, part_pages: int = PART_PAGES) -> DataFrame:
    """page_id, host, n_lines and n_dropped (lines with a word, before and taken away) and the text that stays, of every page.

    Null and empty pages have no lines and an empty text; addresses without a host, null ones too, are one host. A line that
    exactly max_ratio of a host's pages hold stays. Repeated rows each count as a page. An empty table gives no rows.
    """
    plain = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    done = drop_boilerplate(plain, host_of(F.col("url")), text_runs(F.col("html")), max_ratio, min_pages, max_broadcast, part_pages)
    after = F.size(F.filter("left", lambda x: x.rlike(r"[^ \t-\r]"))).cast("long")
    return done.select("page_id", host_of(F.col("url")).alias("host"), "n_lines", (F.col("n_lines") - after).alias("n_dropped"), F.array_join("left", "\n").alias("text"))


def clean_lines(docs: DataFrame, host="source", text="text", max_ratio=MAX_RATIO, min_pages=MIN_PAGES) -> DataFrame:
    """docs with their boilerplate lines gone from the text, n_chars counted anew if there is such a column; no row goes.

    Null texts and their n_chars stay; null sources are one host; repeated rows each count. An empty table gives no rows.
    """
    done = drop_boilerplate(docs, F.col(host), F.col(text), max_ratio, min_pages)
    left = F.array_join(done.columns[-1], "\n")
    new = {text: F.when(F.col(text).isNotNull(), left)} | ({"n_chars": F.when(F.col(text).isNotNull(), F.length(left)).otherwise(F.col("n_chars")).cast("long")} if "n_chars" in docs.columns else {})
    return done.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
