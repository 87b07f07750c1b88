"""Gates and classes of single records: what is due, trusted, official, in scope, and how sure. Columns in, a column out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import is_site_page
from .scores import LEVELS
from .text import latin_tokens
from .urls import registrable_host

# Hours until a source is due again, and days that a fetch looks back.
WEEKLY_HOURS, DAILY_HOURS = 156, 20
FIRST_DAYS, MARGIN_DAYS, MOST_DAYS = 14, 1, 21
# Hosts and paths of official statements.
OFFICIAL_HOSTS = (
    "sam.gov", "beta.sam.gov", "ted.europa.eu", "mod.gov.il", "sibat.mod.gov.il", "www.sibat.mod.gov.il", "prnewswire.com",
    "www.prnewswire.com", "businesswire.com", "www.businesswire.com", "globenewswire.com", "www.globenewswire.com",
)
OFFICIAL_SUFFIXES = (".gov", ".gov.il", ".mil", ".europa.eu")
INVESTOR_HOSTS, PRESS_PATHS = ("ir.", "investor.", "investors."), ("/press-release", "/press-releases", "/newsroom", "/press-room")
# Kinds of web sources by domain, and the kinds that make a row sure.
TRADE_PRESS = (
    "defensenews.com", "janes.com", "shephardmedia.com", "defense-update.com", "breakingdefense.com", "flightglobal.com",
    "military.com", "thedrive.com", "airforce-technology.com", "army-technology.com", "naval-technology.com", "globes.co.il",
)
ENCYCLOPEDIAS = ("wikipedia.org", "wiktionary.org", "britannica.com", "dictionary.com", "investopedia.com")
FORUMS = ("forum", "reddit.com", "quora.com", "wetransfer.com", "groups.google.com")
SURE_KINDS, SURE_SOURCES = ("datasheet", "official", "contract", "tender", "budget"), ("vendor_official", "datasheet")
# Reasons of relevance to the focus, and what each adds.
FOCUS = (
    ("israeli_company_mentioned", 0.6), ("israeli_agency_or_customer", 0.5), ("competitor_to_israeli_company", 0.3),
    ("export_market_signal", 0.25), ("hebrew_language_source", 0.2),
)
# Phrases of pages that failed to load.
FAILED_FETCH = (
    "this website is using a security service", "attention required", "enable javascript and cookies to continue",
    "checking your browser before accessing", "403 forbidden", "access denied",
)
# Words of labour-market pieces.
LABOUR = (
    "job market", "jobs market", "labor market", "hiring", "layoffs", "in-demand skills", "in-demand jobs", "career path", "professions",
    "שוק העבודה", "מקצועות מבוקשים", "מקצועות", "משרות", "גיוס עובדים", "פיטורים", "כישורים נדרשים", "כוח אדם",
)
# Words that make a test an exercise.
EXERCISE = r"תרגיל|\bexercises?\b|\bdeployment\b|\bOperation\s+[A-Z][A-Za-z]+"
# Words of titles that tell nothing.
TITLE_WORDS = (
    "the", "a", "an", "of", "to", "in", "on", "at", "for", "with", "and", "or", "as", "by", "from", "is", "are", "was", "were", "be",
    "this", "that", "it", "its", "after", "before", "new", "first", "into", "over", "up", "out", "about", "than", "now", "will", "has",
    "have", "amid", "said",
)
# Bounds of a learned threshold.
THRESHOLD_LOW, THRESHOLD_HIGH = 0.3, 0.8


def any_of(conditions) -> Column:
    return reduce(or_, conditions, F.lit(False))


def _level(name: str) -> int:
    return dict(LEVELS)[name]


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty where there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[^/]*//(?:[^/@]*@)?([^/:?#]*)", 1)


def within_domains(domain: Column, names: tuple[str, ...]) -> Column:
    return domain.isin(*names) | any_of(F.endswith(domain, F.lit("." + n)) for n in names)


def due(schedule: Column, last: Column, now: Column, poll: bool = False) -> Column:
    """A source is due if it never succeeded, if its interval is over, or, unless it is weekly or this is a daytime poll, always."""
    weekly = schedule.eqNullSafe(F.lit("weekly"))
    waited = F.unix_micros(now) - F.unix_micros(last)
    over = waited >= F.when(weekly, WEEKLY_HOURS).otherwise(DAILY_HOURS) * F.lit(3_600_000_000)
    return last.isNull() | over | (F.lit(not poll) & ~weekly)


def lookback_days(last: Column, default: Column, now: Column) -> Column:
    """Days to look back: since the last success and one more, a fortnight where there was none; the default at least, 21 at most."""
    gone = F.floor(F.greatest(F.lit(0), F.unix_micros(now) - F.unix_micros(last)) / 86_400_000_000)
    return F.least(F.lit(MOST_DAYS), F.greatest(default, F.when(last.isNull(), FIRST_DAYS).otherwise(gone + MARGIN_DAYS))).cast("int")


def trusted_redirect(asked: Column, landed: Column, blocked: Column) -> Column:
    """Where a fetch landed names the article: not blocked, no page of the site's own, and on the host that was asked."""
    return ~blocked & ~is_site_page(landed) & registrable_host(asked).eqNullSafe(registrable_host(landed))


def official(url: Column) -> Column:
    """True for portals of states, news wires, and press pages of a company's investor site; null counts as none."""
    site, path = host(url), F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[^/]*//[^/?#]*([^?#]*)", 1)
    press = any_of(F.startswith(site, F.lit(p)) for p in INVESTOR_HOSTS) & any_of(F.contains(path, F.lit(p)) for p in PRESS_PATHS)
    return site.isin(*OFFICIAL_HOSTS) | any_of(F.endswith(site, F.lit(x)) for x in OFFICIAL_SUFFIXES) | press


def web_source(url: Column, vendor: Column) -> Column:
    """(kind, reliability) of an address: the vendor's own if its host holds the vendor's name (three letters or more), else by domain."""
    site = host(url)
    bare = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "")
    told = lambda kind, sure: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("reliability"))
    own = (F.length(bare(vendor)) >= 3) & F.contains(bare(site), bare(vendor))
    kind = F.when(own, told("vendor_official", "primary")).when(within_domains(site, ENCYCLOPEDIAS), told("reference", "low"))
    kind = kind.when(any_of(F.contains(site, F.lit(f)) for f in FORUMS), told("forum", "low"))
    return kind.when(within_domains(site, TRADE_PRESS), told("trade_press", "secondary")).otherwise(told("press", "secondary"))


def row_confidence(cites: Column, kind: Column, cited_kinds: Column) -> Column:
    """low without a cite; high for a sure kind, two cites, or a cite of a sure source; else medium."""
    n = F.when(cites.isNull(), 0).otherwise(F.size(cites))
    sure = F.coalesce(kind.isin(*SURE_KINDS), F.lit(False)) | (n >= 2)
    sure = sure | F.coalesce(F.exists(cited_kinds, lambda k: F.coalesce(k.isin(*SURE_SOURCES), F.lit(False))), F.lit(False))
    return F.when(n == 0, "low").when(sure, "high").otherwise("medium")


def focus_relevance(*signals: Column) -> Column:
    """(score, reasons) of the five signals in the order of FOCUS: their weights' sum, one at most; null signals are false."""
    on = [F.coalesce(s, F.lit(False)) for s in signals]
    score = sum((F.when(s, w).otherwise(0.0) for s, (_, w) in zip(on, FOCUS, strict=True)), F.lit(0.0))
    reasons = F.array_compact(F.array(*(F.when(s, r) for s, (r, _) in zip(on, FOCUS, strict=True))))
    return F.struct(F.round(F.least(F.lit(1.0), score), 3).alias("score"), reasons.alias("reasons"))


def exercise_kind(kind: Column, text: Column) -> Column:
    """A test whose text tells of an exercise, a deployment or a named operation is a deployment."""
    return F.when((kind == "test") & F.coalesce(text, F.lit("")).rlike(EXERCISE), "deployment").otherwise(kind)


def acquisition_boost(score: Column, watched: Column, deal_words: Column) -> Column:
    """Red at least for a watched company in words of an acquisition."""
    return F.when(watched & deal_words, F.greatest(score, F.lit(_level("red")))).otherwise(score)


def opportunity_floor(score: Column, tags: Column, tag: str) -> Column:
    """Yellow at least for items with the tag."""
    return F.when(F.coalesce(F.array_contains(tags, tag), F.lit(False)), F.greatest(score, F.lit(_level("yellow")))).otherwise(score)


def has_word(text: Column, *terms: str) -> Column:
    """Any of the terms stands as words of its own in a text, in any case; null holds none."""
    return F.coalesce(text, F.lit("")).rlike(r"(?iU)(?<!\w)(?:" + "|".join(rf"\Q{t}\E" for t in terms) + r")(?!\w)")


def scope(domain: Column, text: Column, named: Column, watched: Column, vocabulary: tuple[str, ...], fashion: tuple[str, ...]) -> Column:
    """(domain, note): out_of_scope without vocabulary where nothing is named and nobody watched, or where fashionable words meet the
    labour market, whoever is named. What is out of scope stays so, without a note."""
    lacks = ~has_word(text, *vocabulary)
    empty, market = lacks & ~named & ~watched, lacks & has_word(text, *fashion) & has_word(text, *LABOUR)
    note = F.when(domain == "out_of_scope", None).when(empty, "gate:vocabulary").when(market, "gate:market")
    return F.struct(F.when(note.isNotNull(), "out_of_scope").otherwise(domain).alias("domain"), note.alias("note"))


def two_signals(text: Column, terms: tuple[str, ...], signals: tuple[str, ...]) -> Column:
    """The terms that a text holds, in their order; none unless it holds one of the signals as well."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t.lower())), t) for t in terms)))
    return F.when(any_of(F.contains(low, F.lit(s.lower())) for s in signals), held).otherwise(F.array().cast("array<string>"))


def rubric(text: Column, words: tuple[str, ...]) -> Column:
    """1, and 1 more for each different word that a text holds, 5 at most."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in sorted({w.lower() for w in words})), F.lit(0))
    return F.least(F.lit(5), hits + 1)


def retrievable(status: Column, domain: Column, summary: Column, title: Column, text: Column) -> Column:
    """Clean (or not judged), in scope, summarised, and no page that failed to load, as its title and first 300 characters tell."""
    opening = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 300)))
    clean = (F.coalesce(status, F.lit("clean")) == "clean") & ~domain.eqNullSafe(F.lit("out_of_scope"))
    return clean & (F.coalesce(summary, F.lit("")) != "") & ~any_of(F.contains(opening, F.lit(p)) for p in FAILED_FETCH)


def deal_key(value: Column, amount: Column, kind: Column, customer: Column, date: Column) -> Column:
    """(amount, kind, who): the value, else the amount as told; the customer, else the year. Equal keys tell of one deal."""
    plain = lambda c: F.lower(F.trim(c))
    told = F.coalesce(value.cast("double").cast("string"), plain(F.coalesce(amount, F.lit(""))))
    year = F.when(F.coalesce(date, F.lit("")) != "", F.substring(date, 1, 4))
    who = F.when(F.coalesce(customer, F.lit("")) != "", plain(customer)).otherwise(year)
    return F.struct(told.alias("amount"), kind.alias("kind"), who.alias("who"))


def title_tokens(title: Column) -> Column:
    """Latin tokens of a title but for common words."""
    return F.array_except(latin_tokens(title), F.array(*map(F.lit, TITLE_WORDS)))


def learned_threshold(found: Column, samples: Column, least_samples: int) -> Column:
    """A threshold held between its bounds; null below the least number of samples."""
    return F.when(samples >= least_samples, F.least(F.lit(THRESHOLD_HIGH), F.greatest(F.lit(THRESHOLD_LOW), found)))


def forecast_window(today: Column, least_months: Column, most_months: Column) -> Column:
    """(opens, closes): months after today, at the month's last day where it has no such day."""
    return F.struct(F.add_months(today, least_months).alias("opens"), F.add_months(today, most_months).alias("closes"))


def rotating(seed: Column, n: int, k: int) -> Column:
    """k places from 0 to n - 1 in a row, from the seed on, round the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(seed + i, F.lit(n)).cast("int"))


def off_trade(text: Column, negative: tuple[str, ...], defence: tuple[str, ...]) -> Column:
    """A term of another trade stands in the text and none of defence, each as words of its own; null texts hold none."""
    return has_word(text, *negative) & ~has_word(text, *defence)


def notice_relevance(relevance: Column, penalty: Column) -> Column:
    """A relevance of 0 to 10 as a share, 0.5 where there is none; 0.2 at most under a penalty."""
    base = F.coalesce(relevance.cast("double") / 10, F.lit(0.5))
    return F.when(penalty, F.least(base, F.lit(0.2))).otherwise(base)
