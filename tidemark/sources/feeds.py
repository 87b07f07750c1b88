"""Feeds, site maps and notices: raw text of one answer per row becomes one row per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RSS = "channel struct<item: array<struct<title: string, link: string, guid: string, pubDate: string, description: string>>>"
SITEMAP = "url array<struct<loc: string, lastmod: string>>"
#: A feed of either kind: RSS has a channel, Atom has entries.
FEED = (
    "channel struct<language: string, item: array<struct<title: string, link: string, guid: string, pubDate: string, date: string, description: string, encoded: string>>>, _lang string, "
    "entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, id: string, updated: string, published: string, summary: string, content: string>>"
)
NEWS_MAP = "url array<struct<loc: string, lastmod: string, news: struct<title: string, publication_date: string>>>"
XML = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}
NOTICES = "notices array<struct<ND: string, TI: map<string, string>, PD: string>>"
RELEASES = "releases array<struct<id: string, ocid: string, date: string, tag: array<string>, tender: struct<title: string, description: string, tenderPeriod: struct<endDate: string>>, buyer: struct<id: string, name: string>>>"


def mail_date(text: Column) -> Column:
    """The instant of a date as mails write it; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, *", ""), "(?:GMT|UTC|Z)$", "+0000")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))


def rss(df: DataFrame, raw: str) -> DataFrame:
    """title, url, summary, published of each entry; malformed feeds give no rows."""
    items = df.select(F.explode(F.from_xml(raw, RSS, {"mode": "PERMISSIVE"})["channel"]["item"]).alias("i"))
    return items.select(F.col("i.title").alias("title"), F.coalesce("i.link", "i.guid").alias("url"), F.col("i.description").alias("summary"), mail_date(F.col("i.pubDate")).alias("published"))


def iso_date(text: Column) -> Column:
    """The instant of an ISO date with or without time, zone and fractions; without a zone it is UTC. Null if it is none."""
    t = F.regexp_replace(F.trim(text), "[Zz]$", "+00:00")
    zoned = t.rlike(r"T.*[+-]\d\d:?\d\d$")
    return F.try_to_timestamp(F.when(zoned, t).when(t.contains("T"), F.concat(t, F.lit("+00:00"))).otherwise(F.concat(t, F.lit("T00:00:00+00:00"))))


def recent(published: Column, since_days: int | None, now: str | None = None) -> Column:
    """True for what is no older than so many days, and for what has no date: better fetched twice than lost."""
    if since_days is None:
        return F.lit(True)
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return published.isNull() | (published >= at - F.make_dt_interval(F.lit(since_days)))


def feed(df: DataFrame, raw: str, since_days: int | None = None, now: str | None = None) -> DataFrame:
    """title, url, summary, published, lang of each entry of RSS and Atom feeds, with the other columns of df.

    An entry's address is its link (in Atom the first that is an alternate or has no kind, else the first), else its id where that is an
    address; entries without one are left out. The language is that of the feed, without its country. Malformed feeds give no rows.
    """
    others = [c for c in df.columns if c != raw]
    f = F.from_xml(raw, FEED, XML)
    alternate = lambda links: F.coalesce(F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get(links, F.lit(0))["_href"])
    web = lambda c: F.when(c.startswith("http"), c)
    lang = lambda c: F.lower(F.split_part(c, F.lit("-"), F.lit(1)))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    entry = lambda title, url, summary, published, language: F.struct(filled(title).alias("title"), filled(url).alias("url"), filled(summary).alias("summary"), published.alias("published"), lang(language).alias("lang"))
    rss_ = F.transform(f["channel"]["item"], lambda i: entry(i["title"], F.coalesce(filled(i["link"]), web(i["guid"])), F.coalesce(i["description"], i["encoded"]), F.coalesce(mail_date(i["pubDate"]), iso_date(i["date"])), f["channel"]["language"]))
    atom = F.transform(f["entry"], lambda i: entry(i["title"], F.coalesce(alternate(i["link"]), web(i["id"])), F.coalesce(i["summary"], i["content"]), iso_date(F.coalesce(i["published"], i["updated"])), f["_lang"]))
    rows = df.select(*others, F.explode(F.coalesce(rss_, atom)).alias("e")).select(*others, "e.*")
    return rows.where(F.col("url").isNotNull() & recent(F.col("published"), since_days, now))


def news_map(df: DataFrame, raw: str, prefix: str = "", since_days: int | None = None, now: str | None = None) -> DataFrame:
    """url, title and published of a site map's addresses whose path begins with prefix, with the other columns of df.

    The day is that of the news extension where there is one, else of the last change. A map of maps gives no rows.
    """
    others = [c for c in df.columns if c != raw]
    u = df.select(*others, F.explode(F.from_xml(raw, NEWS_MAP, XML)["url"]).alias("u"))
    url = F.nullif(F.trim("u.loc"), F.lit(""))
    rows = u.select(*others, url.alias("url"), F.nullif(F.trim("u.news.title"), F.lit("")).alias("title"), F.coalesce(iso_date(F.col("u.news.publication_date")), iso_date(F.col("u.lastmod"))).alias("published"))
    path = F.coalesce(F.regexp_extract("url", r"^[^/]*//[^/]*(/[^?#]*)?", 1), F.lit(""))
    return rows.where(F.col("url").isNotNull() & path.startswith(prefix) & recent(F.col("published"), since_days, now))


def sitemap(df: DataFrame, raw: str, prefix: str = "") -> DataFrame:
    """url and the day it was changed, of addresses whose path begins with prefix."""
    urls = df.select(F.explode(F.from_xml(raw, SITEMAP, {"mode": "PERMISSIVE"})["url"]).alias("u"))
    path = F.regexp_extract(F.col("u.loc"), r"^[^/]*//[^/]*(/.*)?$", 1)
    return urls.select(F.trim("u.loc").alias("url"), F.try_to_date(F.substring("u.lastmod", 1, 10), "yyyy-MM-dd").alias("changed")).where(path.startswith(prefix))


def ted(df: DataFrame, raw: str, langs: tuple[str, ...] = ("eng", "fra", "deu")) -> DataFrame:
    """number, title in the first language at hand, and day of each notice."""
    n = df.select(F.explode(F.from_json(raw, NOTICES)["notices"]).alias("n"))
    title = F.coalesce(*(F.try_element_at("n.TI", F.lit(k)) for k in langs), F.try_element_at(F.map_values("n.TI"), F.lit(1)))
    return n.select(F.col("n.ND").alias("number"), title.alias("title"), F.try_to_date(F.substring("n.PD", 1, 10), "yyyy-MM-dd").alias("day"))


def ocds(df: DataFrame, raw: str) -> DataFrame:
    """number, title, buyer, deadline and status of each release."""
    r = df.select(F.explode(F.from_json(raw, RELEASES)["releases"]).alias("r"))
    status = F.when(F.array_contains("r.tag", "award"), "awarded").when(F.array_contains("r.tag", "tender"), "open").otherwise("unknown")
    deadline = F.try_to_date(F.substring("r.tender.tenderPeriod.endDate", 1, 10), "yyyy-MM-dd")
    return r.select(F.coalesce("r.ocid", "r.id").alias("number"), F.col("r.tender.title").alias("title"), F.col("r.buyer.name").alias("buyer"), deadline.alias("deadline"), status.alias("status"))


def json_list(df: DataFrame, raw: str, records: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a list at the dotted path `records`, with a column for each dotted path of fields; what is missing is null."""
    at = lambda p: "$" + "".join(f".{x}" for x in p.split(".") if x)
    listed = F.from_json(F.get_json_object(raw, at(records)), "array<string>")
    return df.select(F.explode(listed).alias("r")).select(*(F.get_json_object("r", at(p)).alias(name) for name, p in fields.items()))
