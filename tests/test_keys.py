"""Keys and comparisons on literal values."""

from pyspark.sql import functions as F

from tidemark.functions import keys


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_names_and_addresses(spark):
    rows = spark.createDataFrame([("Elbit-Systems  UK",), (" elbit systems uk!",), (None,), ("Ärzte, e.V.",)], "n string").select(keys.name_key(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["elbit systems uk", "elbit systems uk", "", "ärzte e v"]
    urls = ["http://WWW.A.com/X/?b=1#c", "https://a.com/X", "http://a.com", None, "", "http://a.com/x/Privacy-policy?y", "http://a.com/x?u=/login"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(keys.web_key(F.col("u"))).collect()][:5] == ["https://a.com/X", "https://a.com/X", "https://a.com", "", ""]
    assert [r[0] for r in df.select(keys.is_site_page(F.col("u"))).collect()] == [False, False, False, None, False, True, False]


def test_numbers(spark):
    text = "In 2024 some 5 of 12 units, 3.5 t and 1,200 or 12; 2,024"
    assert one(spark, keys.distinctive_numbers(F.lit(text)), keys.distinctive_numbers(F.lit(None).cast("string")))[:] == (["12", "3.5", "1,200"], [])


def test_shared_names(spark):
    names = lambda *n: F.array(*map(F.lit, n))
    rows = one(spark, keys.shared_distinctive(names("IDF", "NATO", "x"), names("NATO", "IDF")), keys.shared_distinctive(names("IDF", "NATO", "Acme"), names("Acme", "NATO", "IDF")), keys.shared_distinctive(F.lit(None).cast("array<string>"), names("a")))
    assert rows[:] == ([], ["Acme", "IDF", "NATO"], [])


def test_same_event(spark):
    rows = [("k", "k", " A", "a ", None, None, None, None), ("k", "k", "", "", "", "", None, None), ("k", "k", None, None, None, None, 100.0, 110.0), ("k", "j", "a", "a", "p", "p", 1.0, 1.0), (None, None, "a", "a", None, None, None, None), ("k", "k", None, None, None, None, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "k1 string, k2 string, c1 string, c2 string, p1 string, p2 string, a1 double, a2 double")
    two = lambda c: (F.col(f"{c}1"), F.col(f"{c}2"))
    assert [r[0] for r in df.select(keys.same_event(two("k"), two("c"), two("p"), two("a"))).collect()] == [True, False, True, False, False, False]
