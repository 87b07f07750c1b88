"""Keys by which names, addresses, numbers and records are taken for the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import amounts_close

# Names too common to tell two records apart, and parts of paths that lead to a site's own pages.
COMMON_NAMES = (
    "us army", "us navy", "us air force", "us marine corps", "dod", "department of defense", "pentagon",
    "israel", "idf", "imod", "nato", "mod", "ministry of defense", "ministry of defence",
)
SITE_PAGES = (
    "/privacy", "/terms", "/cookie", "/legal", "/accessibility", "/sitemap", "/newsletter", "/subscribe",
    "/login", "/signin", "/register", "/about-us", "/contact",
)
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"


def name_key(name: Column) -> Column:
    """Lower case, punctuation and runs of white space as one blank; null counts as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}\p{M}_]+", " ")))


def web_key(url: Column) -> Column:
    """https, host without www., path without slashes at its end; no query, no fragment. Null counts as empty."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/]*//([^/]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/]*//[^/]*(/.*)?$", 1), "/+$", "")
    return F.when(bare == "", "").otherwise(F.concat(F.lit("https://"), host, path))


def is_site_page(url: Column) -> Column:
    """True for privacy notices, logins and the like, which are no articles."""
    return F.regexp_replace(F.lower(url), r"\?.*$", "").rlike("|".join(SITE_PAGES))


def distinctive_numbers(text: Column) -> Column:
    """The different numbers of a text, in order of their first place; years from 2000 on and whole numbers below 10 are left out."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 0))
    digits = lambda n: F.regexp_replace(n, ",", "")
    return F.filter(found, lambda n: ~digits(n).rlike(r"^20[0-9]{2}$") & (F.contains(n, F.lit(".")) | (digits(n).cast("double") >= 10)))


def shared_distinctive(a: Column, b: Column) -> Column:
    """Names in both arrays, sorted: all of three or more, else those that aren't too common. Null arrays share none."""
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_intersect(F.coalesce(a, none), F.coalesce(b, none)))
    return F.when(F.size(both) >= 3, both).otherwise(F.filter(both, lambda n: ~F.lower(F.trim(n)).isin(*COMMON_NAMES)))


def same_event(kind: tuple[Column, Column], customer: tuple[Column, Column], program: tuple[Column, Column], amount: tuple[Column, Column]) -> Column:
    """Of one kind, and of one customer or program (blank ones are none) or of close amounts; never null."""
    plain = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    known = lambda c: F.coalesce(c, F.lit(False))
    same = known(plain(customer[0]) == plain(customer[1])) | known(plain(program[0]) == plain(program[1])) | known(amounts_close(*amount))
    return known(F.nullif(kind[0], F.lit("")) == kind[1]) & same
