"""Titles of events and stories: tokens, character ratios, and the rules by which two titles tell of the same."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import jaccard

# Hebrew prefixes (longer ones first), words without content, and the thresholds of the rule.
PREFIXES = ("וש", "וב", "ול", "ומ", "וה", "וכ", "ש", "ב", "ל", "מ", "ה", "כ", "ו")
STOPWORDS = (
    "של", "עם", "בין", "את", "על", "ידי", "אל", "אצל", "לפי", "או", "גם", "כי", "אם",
    "the", "of", "to", "for", "and", "a", "an", "with", "by", "in", "on", "at", "from", "as", "is",
)
TITLE_RATIO, TOKEN_SCORE, WEAK_TOKEN, WEAK_RATIO = 0.9, 0.6, 0.45, 0.55
STORY_RATIO = 0.85
_EDGE = "[-'\"״׳]+"


def plain(title: Column) -> Column:
    """Lower case, white space collapsed; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))


def ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all, by longest matching blocks; 0 where either is empty. Arrow batches: titles are short."""

    @F.arrow_udf("double")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return of(a, b)


def event_ratio(a: Column, b: Column) -> Column:
    return ratio(plain(a), plain(b))


def story_ratio(a: Column, b: Column) -> Column:
    """As event_ratio, punctuation taken as blanks."""
    bare = lambda t: F.trim(F.regexp_replace(F.regexp_replace(plain(t), r"(?U)[^\w\s]", " "), r"\s+", " "))
    return ratio(bare(a), bare(b))


def tokens(title: Column) -> Column:
    """Different content words; one Hebrew prefix goes where three letters or more are left."""
    bare = lambda w: F.regexp_replace(w, f"^{_EDGE}|{_EDGE}$", "")
    words = F.transform(F.regexp_extract_all(plain(title), F.lit(r"""(?U)[\w'"״׳-]+"""), 0), bare)
    known = F.array(*map(F.lit, STOPWORDS))
    content = F.filter(words, lambda w: (w != "") & ~F.array_contains(known, w))
    stems = F.transform(content, lambda w: bare(F.regexp_replace(w, f"^(?:{'|'.join(PREFIXES)})(?=.{{3,}}$)", "")))
    return F.array_distinct(F.filter(stems, lambda w: (w != "") & ~F.array_contains(known, w)))


def token_score(a: Column, b: Column) -> Column:
    """The mean of Jaccard and containment over the titles' tokens; 0 where either has none."""
    x, y = tokens(a), tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, (jaccard(x, y) + F.size(F.array_intersect(x, y)) / least) / 2).otherwise(0.0)


def both_lack(a: Column, b: Column) -> Column:
    """Each of two sets holds something that the other lacks."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def numbers(title: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"(?U)(?<![\w.])\d[\d.,-]*(?!\w)"), 0)
    return F.array_distinct(F.filter(F.transform(found, lambda n: F.regexp_replace(n, "[.,-]+$", "")), lambda n: n != ""))


def names(title: Column) -> Column:
    """Capitalised Latin words of three letters or more, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\b[A-Z][A-Za-z0-9-]{2,}\b"), 0), F.lower))


def same_kind(a: Column, b: Column) -> Column:
    """Two titles of one kind tell of one event: no numbers or names set them apart, and characters, words or both agree."""
    char, token = event_ratio(a, b), token_score(a, b)
    agree = (char >= TITLE_RATIO) | (token >= TOKEN_SCORE) | ((token >= WEAK_TOKEN) & (char >= WEAK_RATIO))
    return ~both_lack(numbers(a), numbers(b)) & ~both_lack(names(a), names(b)) & agree


def parties_conflict(a: Column, b: Column) -> Column:
    """Both name parties, and no name of one is or holds a name of the other."""
    known = lambda p: F.filter(F.transform(F.coalesce(p, F.array().cast("array<string>")), plain), lambda n: n != "")
    x, y = known(a), known(b)
    shared = F.exists(x, lambda n: F.exists(y, lambda m: F.contains(n, m) | F.contains(m, n)))
    return (F.size(x) > 0) & (F.size(y) > 0) & ~shared


def redundant(a: Column, b: Column, numbers_a: Column, numbers_b: Column, names_a: Column, names_b: Column, least: float = 0.6) -> Column:
    """Two sentences (sets of words a, b) say the same: their words overlap enough, or they share a number and a name."""
    both = (F.size(F.array_intersect(numbers_a, numbers_b)) > 0) & (F.size(F.array_intersect(names_a, names_b)) > 0)
    return (jaccard(a, b) >= least) | both


def same_indicator(a: Column, b: Column) -> Column:
    """Two indicators are one: near in characters, or sets of three words or more that overlap by half, or by 0.3 with two shared numbers."""
    x, y = tokens(a), tokens(b)
    shared, least = F.array_intersect(x, y), F.least(F.size(x), F.size(y))
    overlap = F.when(least >= 3, F.size(shared) / least).otherwise(0.0)
    figures = F.size(F.filter(shared, lambda w: w.rlike("^[0-9]+$")))
    return (event_ratio(a, b) >= STORY_RATIO) | (overlap >= 0.5) | ((figures >= 2) & (overlap >= 0.3))
