"""Feeds, site maps and notices from literal answers."""

from datetime import date

from tidemark.sources import feeds


def one(spark, text):
    return spark.createDataFrame([(text,), (None,)], "raw string")


def test_rss(spark):
    raw = "<rss version='2.0'><channel><title>t</title><item><title>A &amp; B</title><link>http://h/1</link><pubDate>Mon, 06 Sep 2021 16:45:00 GMT</pubDate><description>d</description></item><item><title>C</title><guid>http://h/2</guid><pubDate>never</pubDate></item></channel></rss>"
    rows = feeds.rss(one(spark, raw), "raw").selectExpr("title", "url", "summary", "cast(published as string) p").collect()
    assert [tuple(r) for r in rows] == [("A & B", "http://h/1", "d", "2021-09-06 16:45:00"), ("C", "http://h/2", None, None)]


def test_sitemap(spark):
    raw = "<urlset><url><loc>https://h.example/news/a</loc><lastmod>2024-02-03T10:00:00Z</lastmod></url><url><loc>https://h.example/about</loc></url></urlset>"
    assert [tuple(r) for r in feeds.sitemap(one(spark, raw), "raw", "/news").collect()] == [("https://h.example/news/a", date(2024, 2, 3))]
    assert feeds.sitemap(one(spark, raw), "raw").count() == 2


def test_notices(spark):
    raw = '{"notices": [{"ND": "1-2024", "TI": {"deu": "Titel", "fra": "Titre"}, "PD": "2024-05-06+02:00"}, {"ND": "2-2024", "TI": {"pol": "Nazwa"}}]}'
    assert [tuple(r) for r in feeds.ted(one(spark, raw), "raw").collect()] == [("1-2024", "Titre", date(2024, 5, 6)), ("2-2024", "Nazwa", None)]


def test_ocds(spark):
    raw = '{"releases": [{"id": "a", "tag": ["tender"], "tender": {"title": "T", "tenderPeriod": {"endDate": "2024-03-01T00:00:00Z"}}, "buyer": {"name": "B"}}, {"ocid": "o", "tag": ["award"]}]}'
    assert [tuple(r) for r in feeds.ocds(one(spark, raw), "raw").collect()] == [("a", "T", "B", date(2024, 3, 1), "open"), ("o", None, None, None, "awarded")]


def test_json_list(spark):
    nested = '{"data": {"hits": [{"id": 7, "fields": {"title": "x"}}, {"id": 8}]}}'
    assert [tuple(r) for r in feeds.json_list(one(spark, nested), "raw", "data.hits", {"id": "id", "title": "fields.title"}).collect()] == [("7", "x"), ("8", None)]


def told(df):
    return sorted((tuple(r) for r in df.selectExpr("*", "cast(published as string) as p").drop("published").collect()), key=str)


def test_feeds_of_both_kinds(spark):
    rss = "<rss xmlns:dc='d'><channel><language>en-US</language><item><title>A</title><link> http://h/1 </link><pubDate>Mon, 06 Sep 2021 16:45:00 GMT</pubDate></item><item><title>B</title><guid>http://h/2</guid><dc:date>2021-09-01</dc:date></item><item><title>C</title><guid>7</guid></item></channel></rss>"
    atom = (
        "<feed xmlns='http://www.w3.org/2005/Atom' xml:lang='he'><title>f</title><entry><title type='html'>D</title><link rel='self' href='http://h/s'/><link rel='alternate' href='http://h/3'/><updated>2021-09-05T10:00:00+02:00</updated><summary>s</summary></entry>"
        "<entry><title>E</title><id>http://h/4</id><published>2021-08-01T00:00:00Z</published><content>c</content></entry><entry><title>F</title><link href='http://h/5'/></entry><entry><id>tag:x</id></entry></feed>"
    )
    df = spark.createDataFrame([(1, rss), (2, atom), (3, "no feed <"), (4, None), (5, "")], "k int, raw string")
    assert told(feeds.feed(df, "raw")) == [
        (1, "A", "http://h/1", None, "en", "2021-09-06 16:45:00"), (1, "B", "http://h/2", None, "en", "2021-09-01 00:00:00"), (2, "D", "http://h/3", "s", "he", "2021-09-05 08:00:00"),
        (2, "E", "http://h/4", "c", "he", "2021-08-01 00:00:00"), (2, "F", "http://h/5", None, "he", None),
    ]
    assert [r[1] for r in told(feeds.feed(df, "raw", 7, "2021-09-10 00:00:00"))] == ["A", "D", "F"]


def test_news_map(spark):
    raw = (
        "<urlset xmlns='s' xmlns:news='n'><url><loc>https://h.example/news/a</loc><lastmod>2024-01-01</lastmod><news:news><news:title> T </news:title><news:publication_date>2024-02-03T10:00:00Z</news:publication_date></news:news></url>"
        "<url><loc>https://h.example/news/b?x=/about</loc><lastmod>2024-01-05</lastmod></url><url><loc>https://h.example/about</loc></url><url><loc/></url></urlset>"
    )
    index = "<sitemapindex><sitemap><loc>https://h.example/1.xml</loc></sitemap></sitemapindex>"
    df = spark.createDataFrame([(raw,), (index,), (None,)], "raw string")
    assert told(feeds.news_map(df, "raw", "/news")) == [("https://h.example/news/a", "T", "2024-02-03 10:00:00"), ("https://h.example/news/b?x=/about", None, "2024-01-05 00:00:00")]
    assert [r[0] for r in told(feeds.news_map(df, "raw", "", 10, "2024-02-04 00:00:00"))] == ["https://h.example/about", "https://h.example/news/a"]
