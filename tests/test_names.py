"""Names and garbled letters, on literal values."""

from pyspark.sql import functions as F

from tidemark.functions import names


def of(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_people(spark):
    assert of(spark, names.skeleton, "Amiram Norkin", "עמירם נורקין", "צחי שמש", "Émile 7", None) == ["mrmnrkn", "mrmnrkn", "tzkhshmsh", "ml", ""]
    pairs = [("Amikam Norkin", "עמירם נורקין", True), ("Dan Cohen", "Rita Levi", False), ("A.B", "a b", True), (None, "x", False), ("12", "34", False)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean").select(names.same_person(F.col("a"), F.col("b")), "same")
    assert all(x == y for x, y in df.collect())
    shapes = {"דן כהן": True, "Dan O'Hara": True, "Dan": False, "Acme Systems": False, "Acme Co.": False, "dan cohen": False, "Dan כהן": False, "A B C D E": False, None: False}
    assert of(spark, names.person_shape, *shapes) == list(shapes.values())
    assert of(spark, lambda t: names.person_shape(t, t == "Red Cross"), "Red Cross", "Dan Cohen") == [False, True]


def test_mentions(spark):
    known = {"BlueHalo": ("LOCUST", "Blue Halo"), "Rafael Systems": ("Rafael",), "Titan": ()}
    told = lambda t: names.mentioned(t, known, ("locust", "Titan"))
    texts = "a Locust X3", "Locust by blue halo", "Rafael and BlueHalo", "BlueHalo, Rafael Systems", "Rafaels", "TITAN", None
    assert of(spark, told, *texts) == [[], ["BlueHalo"], ["BlueHalo", "Rafael Systems"], ["Rafael Systems", "BlueHalo"], [], [], []]


def test_garbled(spark):
    once = "עברית it’s".encode().decode("latin-1")
    twice = "שלום".encode().decode("latin-1").encode().decode("latin-1")
    quote = "it’s fine".encode().decode("cp1252")
    assert of(spark, names.repaired, once, twice, quote, "café ü", "עברית", "plain", None, "") == ["עברית it’s", "שלום", "it’s fine", "café ü", "עברית", "plain", None, ""]
