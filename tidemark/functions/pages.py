"""Web pages: titles, kinds of addresses, dates told by metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths and parameters of pages that list others.
LISTS = r"/(?:tag|category|page|index|search)(?:/|$|\.)"
PAGING = r"[?&](?:page|offset)=[0-9]+"
# What separates a title from the name of its site, and the longest name taken for one.
SEPARATORS, SUFFIX_CHARS = r" [|–—-] ", 40


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title(html: Column) -> Column:
    """The title tag, else the first heading, collapsed."""
    tag = F.nullif(F.regexp_extract(html, r"<title>([^<]*)</title>", 1), F.lit(""))
    return collapse(F.coalesce(tag, F.regexp_extract(html, r"<h1>([^<]*)</h1>", 1)))


def without_site(text: Column) -> Column:
    """Without what stands after the last separator, if that is short and shorter than what stands before."""
    head, tail = F.regexp_extract(text, rf"^(.*){SEPARATORS}(.*)$", 1), F.regexp_extract(text, rf"^(.*){SEPARATORS}(.*)$", 2)
    return F.when((head != "") & (F.length(tail) <= SUFFIX_CHARS) & (F.length(tail) < F.length(head)), F.trim(head)).otherwise(text)


def is_article(url: Column) -> Column:
    """False for lists, paging and a site's front page."""
    return ~(url.rlike(LISTS) | url.rlike(PAGING) | url.rlike(r"^[a-z]+://[^/]+/?$"))


def published(html: Column) -> Column:
    """A day told by metadata: the article's property, else that of structured data, else a time tag; null if it is none."""
    found = None
    for pattern in (r"""(?:article|og):published_time["'][^>]*content=["'](\d{4}-\d\d-\d\d)""", r'"datePublished"\s*:\s*"(\d{4}-\d\d-\d\d)', r"""<time[^>]*datetime=["'](\d{4}-\d\d-\d\d)"""):
        day = F.try_to_timestamp(F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
        found = day if found is None else F.coalesce(found, day)
    return found
