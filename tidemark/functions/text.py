"""Text: normal forms, hashes, tokens, redaction, content bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a wall in place of the article, and lengths that bound the bands.
WALL_PHRASES = (
    "unlock free access", "premium content", "subscribe to continue", "discover b2b marketing", "subscribe to read",
    "subscribe now to read", "sign in to continue reading", "this content is for subscribers", "this article is for subscribers",
    "to continue reading this article", "please enable cookies", "accept all cookies to continue", "manage your cookie settings",
    "become a member to continue", "log in to view this content", "create a free account to continue", "רק למנויים", "להמשך קריאה יש להירשם",
)
STUB_CHARS, PARTIAL_CHARS = 400, 1500
# What is blanked, in this order, and by what.
REDACTIONS = (
    (r"(?i)([?&](?:key|api_key|token)=)[^&\s\"']+", "$1[REDACTED]"),
    (r"AIza[0-9A-Za-z_\-]{10,}", "[REDACTED]"),
    (r"sk-[A-Za-z0-9_\-]{10,}", "[REDACTED]"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._\-]+", "$1[REDACTED]"),
)
# Zero-width characters and marks of direction.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"


def collapse(text: Column) -> Column:
    """Line ends as \\n, runs of blanks and tabs as one blank, no blanks at line ends, at most one empty line in a row."""
    steps = ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"))
    return F.regexp_replace(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text), r"^[ \n]+|[ \n]+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def content_status(text: Column, blocked: Column | None = None) -> Column:
    """stub, partial or full, by length and wall phrases; a blocked or blank text is a stub."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    walled = reduce(lambda a, p: a | F.contains(F.lower(t), F.lit(p)), WALL_PHRASES, F.lit(False))
    n = F.length(t)
    told = F.when(n == 0, "stub").when(walled, F.when(n <= PARTIAL_CHARS, "stub").otherwise("partial")).when(n <= STUB_CHARS, "stub").when(n <= PARTIAL_CHARS, "partial").otherwise("full")
    return told if blocked is None else F.when(blocked, "stub").otherwise(told)


def quality_rank(blocked: Column, status: Column) -> Column:
    """0 if blocked, else 1 for stubs, 2 for partial and 3 for full texts."""
    return F.when(blocked, 0).otherwise(F.when(status == "full", 3).when(status == "partial", 2).otherwise(1))


def redact(text: Column) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, *s), REDACTIONS, text)


def strip_blobs(text: Column, max_chars: int = 200) -> Column:
    """Without base64 or hex runs longer than max_chars."""
    return F.regexp_replace(text, rf"[A-Za-z0-9+/]{{{max_chars + 1},}}={{0,2}}", " ")


def strip_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def latin_tokens(text: Column) -> Column:
    """Different lower-cased Latin tokens of two or more characters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9-]+"), 0), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def same_kind_veto(a: Column, b: Column) -> Column:
    """Two sets contradict each other if each holds something that the other lacks."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def trim_words(text: Column, cap: int) -> Column:
    """At most cap characters, cut at the last blank where there is one."""
    return F.when(F.length(text) <= cap, text).otherwise(F.regexp_replace(F.substring(text, 1, cap), r"\s+\S*$", ""))


def citations(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), 1), lambda x: x.cast("int"))


def latest_year(text: Column, now: int) -> Column:
    """The latest standalone year from 1990 on; null if none, or if it lies more than a year ahead."""
    year = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:199|20[0-9])[0-9])\b"), 1), lambda x: x.cast("int")))
    return F.when(year <= now + 1, year)
