"""Rules over single records: relevance, value, gates, states, keys, amounts. Columns in, a column out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, scales and floors of an entity's relevance.
IN_SCOPE, MENTIONS, EDGES, EVENTS = 0.30, 0.25, 0.25, 0.20
KEPT_KINDS, FLOOR_KINDS, FLOOR = ("company", "program", "system", "org"), ("org", "program", "system"), 0.5
NEWS, COUNTRY, BARE_COUNTRY = 0.1, 0.45, 0.2
# A patent's years, and days of a year.
TERM, YEAR = 20.0, 365.25
# Words that multiply an amount, and words and signs of currencies, in the order they are looked for.
SCALES = (("מיליארד", 1e9), ("מיליארדי", 1e9), ("billion", 1e9), ("מיליון", 1e6), ("מיליוני", 1e6), ("million", 1e6), ("אלפי", 1e3), ("אלף", 1e3), ("thousand", 1e3))
CURRENCIES = (
    ("דולר", "USD"), ("דולרים", "USD"), ("usd", "USD"), ("dollars", "USD"), ("dollar", "USD"), ("$", "USD"), ("שקל", "ILS"), ("שקלים", "ILS"), ("nis", "ILS"), ("ils", "ILS"), ("₪", "ILS"),
    ("יורו", "EUR"), ("eur", "EUR"), ("euros", "EUR"), ("euro", "EUR"), ("€", "EUR"), ("לירה שטרלינג", "GBP"), ("gbp", "GBP"), ("pounds", "GBP"), ("£", "GBP"),
)


def _between(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def entity_relevance(kind: Column, mentions: Column, edges: Column, events: Column, in_scope: Column, total: Column, watched: Column, news: Column) -> Column:
    """0 to 1: 1 if watched; fixed for news sources and countries; else weighted logarithms of the evidence, less for kinds that are
    often false, and at least 0.5 for organisations, programs and systems with an edge or an event. Rounded to four places; what lies on
    a half but for the last bit of a sum goes up."""
    part = lambda n, scale: F.least(F.lit(1.0), F.log2(F.greatest(F.lit(0), n) + 1.0) / math.log2(scale))
    share = F.when(total > 0, _between(in_scope / total)).otherwise(0.0)
    base = IN_SCOPE * share + MENTIONS * part(mentions, 9) + EDGES * part(edges, 9) + EVENTS * part(events, 4)
    weak = F.when(mentions + edges + events <= 1, 0.35).otherwise(0.7)
    score = base * F.when(kind.isin(*KEPT_KINDS), 1.0).otherwise(weak)
    linked = (edges > 0) | (events > 0)
    score = F.when(kind.isin(*FLOOR_KINDS) & linked, F.greatest(score, F.lit(FLOOR))).otherwise(score)
    nothing = (mentions <= 0) & (edges <= 0) & (events <= 0)
    plain = F.when(kind == "country", F.when(linked, COUNTRY).otherwise(BARE_COUNTRY)).when(nothing, 0.0).otherwise(F.round(_between(score) + 1e-9, 4))
    return F.when(watched, 1.0).when(news, NEWS).otherwise(plain)


def patent_value(jurisdictions: Column, citations: Column, published: Column, filed: Column, siblings: Column, disputed: Column, today: Column) -> Column:
    """0 to 100: jurisdictions 25, citations a year 25, life left 20, siblings of the owner 15, disputes 15; half to even."""
    years = lambda since: F.datediff(today, since) / YEAR
    spread = F.least(F.size(F.array_distinct(F.filter(F.coalesce(jurisdictions, F.array().cast("array<string>")), lambda j: j != ""))), F.lit(5)) / 5 * 25
    cited = F.coalesce(_between(citations / F.coalesce(F.greatest(F.lit(1.0), years(published)), F.lit(1.0)) / 2) * 25, F.lit(0.0))
    life = F.when(filed.isNull(), 10.0).otherwise(_between((TERM - years(filed)) / TERM) * 20)
    pace = F.least(siblings, F.lit(10)) / 10 * 15
    total = spread + cited + life + pace + F.when(disputed, 15.0).otherwise(0.0)
    return F.bround(_between(total / 100) * 100).cast("int")


def code_gate(codes: Column, allow: tuple[str, ...], deny: tuple[str, ...]) -> Column:
    """The denied prefix for which a notice is rejected, or null: one allowed code passes all, and prefix hits must be as many as codes."""
    known = F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    begins = lambda c, some: F.filter(F.array(*map(F.lit, some)), lambda p: F.startswith(c, p))
    allowed = F.exists(known, lambda c: F.size(begins(c, allow)) > 0)
    denied = F.flatten(F.transform(known, lambda c: begins(c, deny)))
    return F.when(~allowed & (F.size(denied) > 0) & (F.size(denied) >= F.size(known)), F.get(denied, F.lit(0)))


def initial_status(hint: Column, notice_type: Column, deadline: Column, published: Column, today: Column, stale_days: int = 365) -> Column:
    """A told status, else awarded for awards, else by the deadline, else by the age of the notice; unknown without any date."""
    told = F.when(hint.isin("awarded", "closed"), hint).when(notice_type == "award", "awarded")
    dated = told.when(deadline < today, "closed").when(deadline.isNotNull(), "open")
    return dated.when(published.isNull(), "unknown").when(F.datediff(today, published) > stale_days, "closed").otherwise("open")


def occurrence(name: Column, start: Column) -> Column:
    """(name without its year, year, month) of a dated occurrence; null without name or date."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\b(?:19|20)\d\d\b", " "), r"[^\p{L}\p{N}]+", " "))
    return F.when(start.isNotNull() & (F.coalesce(name, F.lit("")) != ""), F.struct(bare.alias("name"), F.year(start).alias("year"), F.month(start).alias("month")))


def past(status: Column, start: Column, end: Column, today: Column) -> Column:
    """The status, past for one that isn't over yet whose end (else start) lies before today."""
    over = ~status.isin("past", "cancelled") & F.coalesce(F.coalesce(end, start) < today, F.lit(False))
    return F.when(over, "past").otherwise(status)


def reminders(relevance: Column, opens: Column, early: Column, papers: Column, start: Column, today: Column) -> Column:
    """What falls due today: opening (relevance 4 or more), early price and papers two weeks ahead, the event itself (relevance 5) thirty days ahead."""
    of = lambda name, due: F.when(F.coalesce(due, F.lit(False)), name)
    return F.array_compact(F.array(
        of("registration_opens", (relevance >= 4) & (opens == today)), of("early_bird", early == F.date_add(today, 14)),
        of("cfp", papers == F.date_add(today, 14)), of("major_conference", (relevance == 5) & (start == F.date_add(today, 30)))))


def spans_overlap(start: Column, end: Column, first: Column, last: Column) -> Column:
    """A span (open ends count as its start) meets [first, last]."""
    return (F.coalesce(end, start) >= first) & (start <= last)


def amount(text: Column) -> Column:
    """(value, currency) told by a text: its first number, times a word of scale behind it; null without a number."""
    number = r"(\d[\d,.']*)"
    value = F.regexp_replace(F.regexp_extract(text, number, 1), "[,']", "").try_cast("double")
    tail = F.lower(F.regexp_extract(text, rf"(?s){number}(.*)$", 2))
    scale, currency = F.lit(1.0), F.lit(None).cast("string")
    for word, times in reversed(SCALES):
        scale = F.when(F.contains(tail, F.lit(word)), times).otherwise(scale)
    for word, told in reversed(CURRENCIES):
        currency = F.when(F.contains(F.lower(text), F.lit(word)), told).otherwise(currency)
    return F.when(value.isNotNull(), F.struct((value * scale).alias("value"), currency.alias("currency")))


def has_term(term: str, text: Column, short: int = 4) -> Column:
    """Whether a text holds a term in any case; one of at most `short` letters must stand alone."""
    low, t = F.lower(F.coalesce(text, F.lit(""))), term.lower()
    return low.rlike(rf"(?U)\b\Q{t}\E\b") if len(term) <= short else F.contains(low, F.lit(t))


def aged_day(latest_year: Column, now: int, least_age: int = 2) -> Column:
    """1 January of the latest year told by an undated text, if that is old enough; else null."""
    return F.when(latest_year <= now - least_age, F.make_date(latest_year, F.lit(1), F.lit(1)))


def bar(n: Column, most: Column, width: int = 30, sign: str = "█") -> Column:
    """A bar in proportion to the largest number, one sign at least for anything above zero."""
    return F.when(n > 0, F.repeat(F.lit(sign), F.greatest(F.lit(1), F.bround(n / most * width)).cast("int"))).otherwise("")


def over_long(sentence: Column, most: int) -> Column:
    """The number of words of a sentence with more than `most`, else null."""
    n = F.size(F.array_remove(F.split(sentence, r"\s+"), ""))
    return F.when(n > most, n)


def numbers_told(value: Column, source: Column) -> Column:
    """Every number of a value stands in its source as well (grouping commas left out)."""
    bare = lambda t: F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\d[\d,]*(?:\.\d+)?"), 0), lambda n: F.regexp_replace(n, ",", ""))
    return F.size(F.array_except(bare(value), bare(source))) == 0


def distinct_facts(facts: Column) -> Column:
    """Facts in order, without those that repeat an earlier one but for case and punctuation; blank ones go."""
    keyed = F.transform(facts, lambda f: F.struct(F.trim(F.regexp_replace(F.lower(f), r"(?U)[^\w]+", " ")).alias("key"), f.alias("fact")))
    first = F.filter(keyed, lambda x, i: (x["key"] != "") & (F.array_position(F.transform(keyed, lambda y: y["key"]), x["key"]) == i + 1))
    return F.transform(first, lambda x: x["fact"])


def changed_fields(old: Column, new: Column) -> Column:
    """The names of map entries that differ, sorted: added, gone or of another value."""
    names = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    return F.filter(names, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))
