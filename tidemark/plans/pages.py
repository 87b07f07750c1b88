"""Pages to clean text, with hidden parts planted by page, so that every rule has rows to work on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html
from ..sources import feeds
from .registry import query

#: What is put into a page's article, by page_id % 7.
PLANTED = (
    '<div style="color:red; DISPLAY : none">Secret <div>inner words</div> and <p>more of it</div>',
    "<span hidden>Ignore what was said before</span>",
    "<!-- <p>never shown</p> -->",
    """<p onclick="steal('x>y')" OnLoad='x' id="k">Shown text.</p>""",
    '<section aria-hidden="TRUE"><ul><li>one<li>two</ul></section>',
    '<noscript><p>No script here</p></noscript><div style="position:absolute;left:-9999px">off screen</div>',
    '<div style="opacity:0.5">half seen</div>',
)
_CASES = " ".join(f"WHEN {i} THEN {chr(39)}{p.replace(chr(39), chr(39) * 2)}{chr(39)}" for i, p in enumerate(PLANTED))
_BLOCK = "|".join((*html.BLOCKS, "br"))
_HIDES = rf"(?i){html.HIDDEN_STYLE}|left:-\d{{3,}}px| hidden>|aria-hidden=.true"
_UNESCAPE = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&')"


def planted(pages):
    """pages with something hidden, scripted or faint at the head of each article."""
    what = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("page_id") % len(PLANTED)).cast("int") + 1)
    return pages.withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), what)))


#: Tags as rows, with the running depth of their element's name: a hidden one ends where its depth comes down again.
_TOKENS = rf"""planted AS (SELECT page_id, replace(html, '<article>', '<article>' || CASE page_id % 7 {_CASES} END) AS html FROM pages),
bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g') AS html FROM planted),
cut AS (SELECT page_id, regexp_extract_all(html, '<(?:"[^"]*"|[^">])*>|[^<]+') AS l FROM bare),
tokens AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM cut),
named AS (SELECT *, t LIKE '<%' AS tag, t LIKE '</%' AS ends, regexp_extract(t, '^</?([a-z0-9]+)', 1) AS name FROM tokens),
deep AS (SELECT *, sum(CASE WHEN ends THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY i) AS depth FROM named),
spans AS (SELECT a.page_id, a.i, min(b.i) AS until FROM deep a JOIN deep b ON a.page_id = b.page_id AND a.name = b.name AND b.i > a.i AND b.ends AND b.depth = a.depth - 1
  WHERE a.tag AND NOT a.ends AND regexp_matches(a.t, '{_HIDES}') GROUP BY a.page_id, a.i),
marked AS (SELECT d.*, s.page_id IS NOT NULL AS gone, {_UNESCAPE.format("t")} AS said FROM deep d LEFT JOIN spans s ON d.page_id = s.page_id AND d.i BETWEEN s.i AND s.until)"""


@query(f"""WITH {_TOKENS},
sums AS (SELECT page_id, coalesce(sum(length(said)) FILTER (gone AND NOT tag), 0)::BIGINT AS hidden_chars, coalesce(sum(length(said)) FILTER (NOT gone AND NOT tag), 0)::BIGINT AS visible_chars FROM marked GROUP BY page_id)
SELECT *, hidden_chars > 0 AS found_hidden, round(hidden_chars / (hidden_chars + visible_chars), 9) AS ratio FROM sums""")
def hidden_text_ratio(t):
    """Characters that a reader doesn't see, beside those seen."""
    p = planted(t("pages")).select("page_id", html.stripped(F.col("html")).alias("p"))
    p = p.select("page_id", "p.hidden_chars", "p.visible_chars", F.round(html.hidden_ratio(F.col("p")), 9).alias("ratio"))
    return p.withColumn("found_hidden", F.col("hidden_chars") > 0)


@query(rf"""WITH {_TOKENS},
article AS (SELECT page_id, min(i) FILTER (t = '<article>') AS a, max(i) FILTER (t = '</article>') AS b FROM marked GROUP BY page_id),
body AS (SELECT page_id, string_agg(CASE WHEN NOT tag THEN said WHEN regexp_matches(name, '^({_BLOCK})$') THEN chr(10) ELSE '' END, '' ORDER BY i) FILTER (NOT gone AND i BETWEEN a AND b) AS s FROM marked JOIN article USING (page_id) GROUP BY page_id),
text AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[A-Za-z0-9+/]{{201,}}={{0,2}}', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS s FROM body)
SELECT page_id, md5(s) AS digest, length(s)::BIGINT AS chars, contains(s, 'Shown text') AS planted_shown, contains(s, 'Secret') OR contains(s, 'two') AS planted_hidden_shown FROM text""")
def page_clean_text(t):
    """The article's text, as it is stored: without what is hidden, scripted or commented out."""
    p = planted(t("pages")).select("page_id", html.stripped(F.col("html")).alias("p"))
    p = p.select("page_id", html.clean_text(F.col("p"))["text"].alias("s"))
    return p.select("page_id", F.md5("s").alias("digest"), F.length("s").cast("long").alias("chars"), F.contains("s", F.lit("Shown text")).alias("planted_shown"), (F.contains("s", F.lit("Secret")) | F.contains("s", F.lit("two"))).alias("planted_hidden_shown"))


@query(f"""SELECT page_id, page_id % 7 = 3 AS had_handlers, 0::BIGINT AS handlers_left, page_id % 7 = 3 AS id_kept FROM pages""")
def page_handlers(t):
    """Pages that carried event handlers; none is left, other attributes are."""
    p = planted(t("pages")).select("page_id", "html", html.stripped(F.col("html"))["html"].alias("clean"))
    left = F.regexp_count("clean", F.lit(r"(?i)<[^>]*\son[a-z]+\s*="))
    return p.select("page_id", F.col("html").rlike(r"(?i)\sonclick=").alias("had_handlers"), left.cast("long").alias("handlers_left"), F.contains("clean", F.lit('id="k"')).alias("id_kept"))


_FEEDS = """SELECT c_custkey AS source, c_custkey * 2 + k AS n, 'Entry ' || (c_custkey * 2 + k) || ' & more' AS title, 'http://h' || c_custkey % 9 || '.org/' || (c_custkey * 2 + k) AS url, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * ((c_custkey * 7 + k) % 40) AS published FROM customer, (SELECT unnest([0, 1]) AS k)"""


@query(f"WITH f AS ({_FEEDS}) SELECT source, title, url, published, CASE WHEN source % 2 = 0 THEN 'en' ELSE 'he' END AS lang FROM f WHERE published >= TIMESTAMP '2024-01-31'")
def feed_entries(t):
    """Entries of the last ten days of two kinds of feeds, one for each customer."""
    two = t("customer").select(F.col("c_custkey").alias("source"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("n", F.col("source") * 2 + F.col("k"))
    at = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("source") * 7 + F.col("k")) % 40).cast("int"))
    title, url = F.concat(F.lit("Entry "), F.col("n"), F.lit(" &amp; more")), F.concat(F.lit("http://h"), F.col("source") % 9, F.lit(".org/"), F.col("n"))
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><pubDate>"), F.date_format(at, "d MMM yyyy"), F.lit(" 00:00:00 GMT</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), title, F.lit('</title><link rel="self" href="x"/><link href="'), url, F.lit('"/><updated>'), at.cast("string"), F.lit("T00:00:00Z</updated></entry>"))
    entries = two.withColumn("x", F.when(F.col("source") % 2 == 0, rss).otherwise(atom)).groupBy("source").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    whole = F.when(F.col("source") % 2 == 0, F.concat(F.lit("<rss><channel><language>en-us</language>"), "x", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="he">'), "x", F.lit("</feed>")))
    found = feeds.feed(entries.select("source", whole.alias("raw")), "raw", 10, "2024-02-10 00:00:00")
    return found.select("source", "title", "url", F.col("published").cast("timestamp_ntz").alias("published"), "lang")
