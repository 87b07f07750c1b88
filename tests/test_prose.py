"""What sentences say, on literal values."""

from pyspark.sql import functions as F

from tidemark.functions import prose


def s(value):
    return F.lit(value).cast("string")


def of(spark, f, *values):
    return [tuple(r[0]) if isinstance(r[0], tuple) else r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_sentences(spark):
    assert of(spark, prose.factual, "יש 3", "רק מילים", "€", "an Acme thing", "a thing", "בחודש מרץ", "החברה זכתה", None, "") == [True, False, True, True, False, True, True, False, False]
    assert of(spark, prose.without_connective, "מקביל לכך, ארצות", "בנוסף לכך החברה", "בנוסףא", "בנוסף", "סוף", None, "") == ["ארצות", "החברה", "בנוסףא", "בנוסף", "סוף", None, ""]
    told = of(spark, prose.without_filler, "יש לציין כי החברה זכתה", "החברה, בהקשר זה , זכתה.", "נקי  לגמרי", None)
    assert told == [("החברה זכתה", ["יש לציין כי"]), ("החברה, זכתה.", ["בהקשר זה"]), ("נקי  לגמרי", []), (None, [])]
    claims = "ניכרת התעצמות דרמטית ברכש של מערכות הגנה", "זינוק של 30% ברכש", "זינוק בשוק", "החברה מסרה מערכות הגנה", None, "  "
    assert of(spark, prose.backed_claim, *claims) == ["נרשמו דיווחים על רכש של מערכות הגנה", claims[1], None, claims[3], None, "  "]


def test_kinds_and_wishes(spark):
    deal = lambda t, *kinds: prose.deal_signal(s(t), F.array(*map(F.lit, kinds)).cast("array<string>"))
    row = spark.range(1).select(deal("A STAKE in"), deal("mistake"), deal("על רכישת חברה"), deal(None, "x", "partnership"), deal(None), prose.deal_signal(s("x"), F.lit(None).cast("array<string>"))).first()
    assert tuple(row) == (True, False, True, True, False, False)
    kind = lambda k, t: prose.event_kind(s(k), s(t))
    row = spark.range(1).select(kind("m_and_a", "X acquired Y"), kind("m_and_a", "joint venture, new CEO"), kind("m_and_a", "y" * 40 + " raised " + "z" * 40), kind("m_and_a", None), kind("other", "net profit up"), kind("deal", "revenue")).first()
    assert [tuple(r) for r in row] == [
        ("m_and_a", None), ("partnership", "joint venture, new CEO"), ("investment", "y" * 29 + " raised " + "z" * 29), ("other", "none of the vocabularies"),
        ("financial_results", "net profit up"), ("deal", None),
    ]
    assert of(spark, prose.wishes, "קצר יותר, להוסיף מעקב אחרי אלביט.", "לא רלוונטי: ספורט", "טוב", None) == [("shorter", "אלביט", None), (None, None, "ספורט"), (None, None, None), (None, None, None)]


def test_products_and_layers(spark):
    named = lambda t: prose.names_product(t, "SPECTRO XR", "Controp", ("iSky-50HD", "MWS"))
    assert of(spark, named, "the spectro xr pod", "ISKY-50HD", "an MWS", "MWS by Controp", "MWSX Controp", None) == [True, True, False, True, False, False]
    assert of(spark, lambda t: prose.names_product(t, "", None, ("MWS",)), "MWS") == [False]
    why = lambda owners, title: prose.patent_reason(F.array(*map(F.lit, owners)).cast("array<string>"), s(title), s(None), "Toplite", "Rafael", ())
    row = spark.range(1).select(why(["Acme", "RAFAEL Ltd."], "x"), why(["Acme"], "a toplite"), why(["Acme"], "x"), why([], "toplite")).first()
    assert [r and tuple(r) for r in row] == [("assignee", "RAFAEL Ltd."), ("product", "Toplite"), None, None]
    defs = {"optics": (("עדשה",), ("lens",)), "ai": ((), ("machine learning",)), "none": ((), ())}
    codes = lambda c, t: prose.patent_layers(F.array(*map(F.lit, c)).cast("array<string>"), s(t), s(None), {"optics": ("G02B",), "ai": ()}, defs)
    row = spark.range(1).select(prose.layers(s("עדשה"), s("Machine Learning"), defs), prose.layers(s(None), s("lenses"), defs), codes(["G02B1/0"], "machine learning"), codes(["H04"], "a lens"), codes([], None)).first()
    assert tuple(row) == (["optics", "ai"], [], ["optics"], ["optics"], [])
    at = lambda u, t=None: prose.sheet_order(s(u), s(t), "acme.com")
    row = spark.range(1).select(at("https://www.acme.com/x.PDF?a=1", "Brochure"), at("https://instro.com/a.pdf"), at("https://b.acme.com/datasheet"), at(None), at("https://notacme.com/pdf")).first()
    assert [tuple(r) for r in row] == [(0, 0, 1), (1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 1, 1)]


def test_hebrew(spark):
    raw = 'כטב\\"ם', "⁦XR⁩ [1] .", 'צה""ל', "ג'ירפה", "ב- %75", "it's", None
    out = of(spark, prose.hebrew_marks, *raw)
    assert out == ["כטב״ם", "XR [1].", "צה״ל", "ג׳ירפה", "ב-75%", "it's", None]
    assert of(spark, prose.hebrew_marks, *out) == out
    names = lambda t: prose.hebrew_names(t, {"רפאל": ("ראפאל", "רפאל"), "אלביט": ("אלבית", "אלבית מערכות")})
    texts = "ראפאל", "וראפאל לראפאל", "ראפאלים", "אלבית מערכות", "http://x/ראפאל ראפאל", "<bdi>ראפאל</bdi>", None, ""
    assert of(spark, names, *texts) == ["רפאל", "ורפאל לרפאל", "ראפאלים", "אלביט", "http://x/ראפאל רפאל", "<bdi>ראפאל</bdi>", None, ""]


def test_numbers_and_searches(spark):
    v = lambda x, t: prose.verbatim(F.lit(x).cast("double"), s(t))
    assert tuple(spark.range(1).select(v(1200, "mass 1,200 kg"), v(2.5, "2,5 um"), v(2.5, "25"), v(7, None), v(None, "7"), v(1.00001, "1 x")).first()) == (1200, 2.5, None, None, None, 1.00001)
    key = lambda q, *e: prose.search_key(s("p"), s(q), s("EN "), s(None), s(None), F.array(*map(F.lit, e)).cast("array<string>"))
    a, b, c, d = spark.range(1).select(key(" A  b", "X", "y"), key("a b", "y", "x "), key("a c", "x", "y"), key(None)).first()
    assert a == b and len({a, c, d}) == 3
