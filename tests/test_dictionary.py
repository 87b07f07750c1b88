"""Names: literal cases of their rules, and a dictionary of 100,000 names against a plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import entities
from tidemark.operators import dictionary

ENTRIES = "surface string, name string, kind string, rank int, strict boolean, product boolean"
KNOWN = [
    ("Elbit", "Elbit", "company", 0, False, False), ("Elbit Systems UK", "Elbit", "company", 0, False, False), ("אלביט מערכות", "Elbit", "company", 0, False, False),
    ("BlueHalo", "BlueHalo", "company", 0, False, False), ("LOCUST", "BlueHalo", "company", 0, True, True), ("Anduril", "Anduril", "company", 0, False, False),
    ("Lattice", "Anduril", "company", 0, False, True), ("Titan", "Titan Co", "company", 0, False, False), ("IAI", "IAI", "company", 0, False, False),
    ('צבא ארה"ב', "US Army", "org", 1, False, False), ("US Army", "US Army", "org", 1, False, False), ("Iron Beam", "Iron Beam", "program", 0, False, False),
    ("יפן", "Japan", "country", 2, False, False), ("Japan", "Japan", "country", 2, False, False), ("דנמרק", "Denmark", "country", 2, False, False), ("US", "United States", "country", 2, False, False),
    ("U.S.", "United States", "country", 2, False, False), ("...", "nobody", "org", 0, False, False), ("Elbit", "Elbit", "company", 0, False, False),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(KNOWN, ENTRIES)


def of(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_canonical(spark, entries):
    cases = [
        ("Elbit-Systems  uk", "company", "Elbit", "company", False), ("Elbit", "system", "Elbit", "system", False), ("Elbit", "thing", "Elbit", "company", False),
        ("LOCUST", "company", "LOCUST", "system", False), ("Locust X3", None, "Locust X3", "system", False), ("יפן", "company", "Japan", "country", False),
        ('צבא ארה"ב', "company", "US Army", "org", False), ("Ministry of Widgets", "country", "Ministry of Widgets", "org", False), ("Acme Corp", "company", "Acme Corp", "company", False),
        ("John Smith", "person", "John Smith", "person", False), ("Nobody", "thing", "Nobody", "org", False), ("יפן, דנמרק, גרמניה", "company", "יפן, דנמרק, גרמניה", "company", True),
        ("image captioning", "org", "image captioning", "org", True), ("Iron Beam", "program", "Iron Beam", "program", False), ("", "org", "", "org", True), (None, "org", None, "org", True),
        ("arXiv cs.CV", "person", "arXiv cs.CV", "person", True), ("u.s.", "company", "United States", "country", False),
    ]
    names = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "id int, name string, kind string")
    got = {r["id"]: (r["canonical"], r["canonical_kind"], r["junk"]) for r in dictionary.canonical(names, entries).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2:] for c in cases]


def test_techniques(spark):
    yes = (
        "image captioning", "RF-DETR vehicle detectors", "Object Detection", "camouflaged military vehicle detection", "feature-level multimodal fusion", "GenAI image editing",
        "LLM-based summarization", "deep learning object recognition", "potential suppliers", "proxy-guided placement", "existing C-UAS approaches", "future uncrewed ground vehicles (UGVs)",
    )
    no = "Elbit Systems", "Drone Dome", "Sniper ATP", "LITENING", "US Air Force", "ePlane", "ePlane Company", "e200X", "acme corp", "", None
    assert of(spark, entities.is_technique, *yes) == [True] * len(yes)
    assert of(spark, entities.is_technique, *no) == [False] * len(no)


def test_venues_and_press(spark):
    assert of(spark, entities.is_venue, "arXiv", "arXiv cs.CV", "IEEE Xplore", "Google Scholar", "Naturelle", "Elbit", "", None) == [True, True, True, True, False, False, False, False]
    names = "The War Zone (TWZ)", "Reuters - World", "Jane's", "Defense News Weekly", "Anduril", "", None
    assert of(spark, entities.is_press, *names) == [True, True, True, True, False, False, False]


def found(spark, entries, texts, safe=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["names"] for r in dictionary.mentions(dictionary.spans(df, entries, "id", "text"), "id", safe).collect()}
    return [got.get(i, []) for i in range(len(texts))]


def test_mentions(spark, entries):
    cases = {
        "Elbit announced a new contract.": ["Elbit"], "Elbit Systems UK and Elbit": ["Elbit"], "אלביט מערכות זכתה": ["Elbit"], "nothing here": [], "": [],
        "This is trIAIl text": [], 'צבא ארה"ב חתם': ["US Army"], "a Locust X3": [], "Locust by bluehalo": ["BlueHalo"], "in Japan, Titan met ELBIT": ["Japan", "Titan Co", "Elbit"],
        "Elbit\nSystems UK": ["Elbit"], "the US Army": ["US Army"], "US. Army": ["United States"],
    }
    assert found(spark, entries, list(cases)) == list(cases.values())


def test_assignees(spark, entries):
    cases = {
        "(Lattice Semiconductor Corporation, USA)": [], "Anduril Industries": [], "by Anduril, Inc.": ["Anduril"], "US Army Titan": ["US Army"], "The Titan won": ["Titan Co"],
        "prime Elbit Systems UK Ltd": ["Elbit"], "Titan GmbH and then Titan again": ["Titan Co"], 'said "Titan': ["Titan Co"], "Big (Titan": [], "Locust of BlueHalo": ["BlueHalo"],
    }
    assert found(spark, entries, list(cases), safe=True) == list(cases.values())


def test_nobody(spark, entries):
    none = spark.createDataFrame([], ENTRIES)
    assert found(spark, none, ["Elbit", None]) == [[], []]
    assert found(spark, entries, [None]) == [[]]


def test_100_000_names(spark):
    """Leftmost, longest, never overlapping; as by looking at each word in turn."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["École", "naïve", "É", "שלום"]
    surfaces = sorted({" ".join(rng.choices(words, k=rng.choice([1, 2, 2, 3, 3, 4, 5]))) for _ in range(112_000)})
    assert len(surfaces) > 90_000
    texts = ["".join(rng.choice(words).upper() + rng.choice([" "] * 9 + [", ", "\n"]) for _ in range(rng.randrange(300))) for _ in range(60)]
    entries = spark.createDataFrame([(s, s, False, False) for s in surfaces], "surface string, name string, strict boolean, product boolean")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r["id"], r["pos"], r["n"], r["name"]) for r in dictionary.spans(df, entries, "id", "text").collect())
    by = {s.lower(): s for s in surfaces}
    told = []
    for i, text in enumerate(texts):
        pieces = re.findall(r"\w+|\W+", text.lower())
        at = 0
        while 2 * at < len(pieces):
            n = next((n for n in (5, 4, 3, 2, 1) if 2 * (at + n) - 1 <= len(pieces) and "".join(pieces[2 * at : 2 * (at + n) - 1]) in by), 0)
            if n:
                told.append((i, at, n, by["".join(pieces[2 * at : 2 * (at + n) - 1])]))
            at += n or 1
    assert got == sorted(told) and len(got) > 3000


def test_only_hashes_meet_the_dictionary(spark, entries, monkeypatch):
    """No window of words is built for each word; the same names are found where the dictionary is too large to be broadcast, and its hashes, too."""
    texts = ["Elbit Systems UK and Elbit", "…Iron Beam of IAI", "US", "", None, "ΟΔΟΣ Α'Σ'Α", "οδος α'σ'α Elbit", "Anduril, Inc. of US Army"]
    more = entries.unionByName(spark.createDataFrame([("Οδος Α'Σ'α", "Odos", "org", 0, False, False)], ENTRIES))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "Titan GmbH")], "id int, text string")
    told = None
    for names, hashes in ((1_000_000, 8_000_000), (2, 8_000_000), (2, 2)):
        monkeypatch.setattr(dictionary, "BROADCAST_NAMES", names)
        monkeypatch.setattr(dictionary, "BROADCAST_HASHES", hashes)
        rows = dictionary.spans(df, more, "id", "text")
        got = sorted(tuple(r) for r in rows.select(F.coalesce("id", F.lit(-1)), "pos", "n", "surface", "name", "fragment").collect())
        assert got == (told or got)
        told = got
    assert told == [
        (-1, 0, 1, "Titan", "Titan Co", True), (0, 0, 3, "Elbit Systems UK", "Elbit", False), (0, 4, 1, "Elbit", "Elbit", False), (1, 0, 2, "Iron Beam", "Iron Beam", False), (1, 3, 1, "IAI", "IAI", False), (2, 0, 1, "US", "United States", False),
        (5, 0, 4, "ΟΔΟΣ Α'Σ'Α", "Odos", False), (6, 0, 4, "οδος α'σ'α", "Odos", False), (6, 4, 1, "Elbit", "Elbit", False), (7, 0, 1, "Anduril", "Anduril", False), (7, 3, 2, "US Army", "US Army", False),
    ]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.count("slice(") <= 5
