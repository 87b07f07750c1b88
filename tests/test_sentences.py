"""Sentences and citations on literal cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import sentences as s
from tidemark.operators import citations


def split(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = [[] for _ in texts]
    for r in citations.sentences(df, "i", "t").orderBy("i", "nth").collect():
        assert texts[r["i"]][r["start"] : r["start"] + len(r["sentence"])] == r["sentence"] and r["nth"] == len(out[r["i"]])
        out[r["i"]].append(r["sentence"])
    return out


def test_sentences(spark):
    cases = {
        "One. Two! Three? Four: five": ["One.", "Two!", "Three?", "Four:", "five"], "It is 3.5 m. High": ["It is 3.5 m.", "High"], "a.b c.": ["a.b c."], " \n One.\n\n Two. \t": ["One.", "Two."],
        'פגש את ד"ר. כהן. סוף.': ['פגש את ד"ר. כהן.', "סוף."], 'צבא ארה"ב . חתם. אז': ['צבא ארה"ב . חתם.', "אז"], "Wait... what?! Yes.": ["Wait...", "what?!", "Yes."], "": [], "   ": [], ". .": [".", "."],
        "no end": ["no end"], "end.": ["end."], "x" * 50_000 + ". y": ["x" * 50_000 + ".", "y"],
    }
    assert split(spark, *cases) == list(cases.values())
    assert citations.sentences(spark.createDataFrame([(1, None)], "i int, t string"), "i", "t").count() == 0


def test_repeat_key(spark):
    rows = [("Acme won the deal [3].",), ("  acme  won the DEAL! [12]",), ("Acme won deal",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(s.repeat_key(F.col("t"))).collect()]
    assert got == ["acme won the deal", "acme won the deal", None, None, None]


@pytest.fixture(scope="module")
def checked(spark):
    drafts = [
        ("d", 1, "Acme won the deal [1]. It cost $5. nothing here. Acme won the deal [2]."), ("d", 2, "Acme won the deal [9][1][0010]. so it goes on. All is well here."), ("d", 3, "so it goes on! all is well here [2]."),
        ("e", 1, "Acme won the deal [1]."), ("f", 1, "plain words only."), (None, 1, "plain words [1]."), ("g", 1, None),
    ]
    registry = [("d", 1), ("d", 2), ("d", 2), ("e", 1)]
    return citations.check_citations(spark.createDataFrame(drafts, "draft string, section int, text string"), spark.createDataFrame(registry, "draft string, n int"))


def test_citations(checked):
    got = {(r["draft"], r["section"], r["nth"]): (r["uncited"], r["bad_refs"], r["repeats"]) for r in checked.collect()}
    fine = (False, [], None)
    assert got == {
        ("d", 1, 0): fine, ("d", 1, 1): (True, [], None), ("d", 1, 2): fine, ("d", 1, 3): fine, ("d", 2, 0): (False, ["9", "10"], 1), ("d", 2, 1): fine, ("d", 2, 2): (True, [], None),
        ("d", 3, 0): (False, [], 2), ("d", 3, 1): (False, [], 2), ("e", 1, 0): fine, ("f", 1, 0): fine, (None, 1, 0): (False, ["1"], None),
    }


def test_verdicts(checked):
    got = {r["draft"]: tuple(r)[1:] for r in citations.draft_verdicts(checked).collect()}
    assert got == {"d": (9, 2, 2, 3, False), "e": (1, 0, 0, 0, True), "f": (1, 0, 0, 0, True), None: (1, 0, 1, 0, False)}


def test_texts_are_cut_once(spark):
    """Before, the first sections of sentences and the sentences themselves were each cut, keyed and judged from the texts."""
    drafts = spark.createDataFrame([("d", 1, "One two three four. It grew by 3 [1]."), ("d", 2, "One, two three FOUR! One two three four.")], "draft string, section int, text string")
    found = citations.check_citations(drafts, spark.createDataFrame([("d", 1)], "draft string, n int"))
    assert "(?<=[.?!:])" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["section"], r["nth"], r["repeats"]) for r in found.collect()) == [(1, 0, None), (1, 1, None), (2, 0, 1), (2, 1, None)]
