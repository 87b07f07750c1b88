"""Texts as sentences, and drafts held against the registry of what they may cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences as s
from ..functions.prose import factual
from ..sources.shared import written
from .dictionary import _small


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, start, sentence): the sentences of each text, numbered from 0, with the character each begins at, from 0.

    Blank pieces are no sentences, and take no number. Rows of one key are taken for one text: keys must be unique. A window
    over one text's sentences finds where they begin, so what is brought together is bounded by a text's length.
    """
    pieces = df.select(F.col(key), F.posexplode(s.split(F.col(text))).alias("p", "piece"))
    before = Window.partitionBy(key).orderBy("p")
    lead = F.length("piece") - F.length(F.regexp_replace("piece", rf"^{s.SPACE}+", ""))
    said = s.bare(F.col("piece"))
    rows = pieces.select(
        key, said.alias("sentence"), (F.sum(F.length("piece")).over(before) - F.length("piece") + lead).cast("long").alias("start"),
        (F.sum((said != "").cast("int")).over(before) - 1).cast("int").alias("nth"),
    )
    return rows.where("sentence <> ''").select(key, "nth", "start", "sentence")


def check_citations(drafts: DataFrame, registry: DataFrame) -> DataFrame:
    """Every sentence of drafts with what is wrong with it: (draft, section, nth, sentence, uncited, bad_refs, repeats).

    drafts: draft, section (unique within a draft, its order), text. registry: draft, n (text of a number): what a draft may cite.
    uncited: it says something checkable and cites nothing. bad_refs: the cited numbers that aren't in the registry, in order.
    repeats: the first section of the draft with the same sentence, if that is an earlier one; sentences of less than four
    words don't count, nor does a repetition within a section after the first. Sentences are cut, numbered and judged within
    their row; the cut texts are written once to the shared folder. A draft's registry comes to its sections as one array, so it is bounded by what one draft may cite. The first section
    of a sentence is a minimum, taken before it is exchanged, so a sentence that very many sections share is no one task's work.
    Null texts have no sentences; a draft without registry rows may cite nothing.
    """
    said = F.filter(F.transform(s.split(F.col("text")), s.bare), lambda x: x != "")
    numbers = _small(registry.groupBy(F.col("draft").alias("r")).agg(F.collect_set(F.col("n").cast("string")).alias("may")))
    able = drafts.join(numbers, F.col("draft").eqNullSafe(F.col("r")), "left").withColumn("may", F.coalesce("may", F.array().cast("array<string>")))
    hashed = able.select("draft", "section", "may", said.alias("said")).withColumn("h", F.transform("said", lambda x: F.unhex(F.md5(s.repeat_key(x).cast("binary")))))
    hashed = written(hashed, "sentences")  # the cut texts serve twice
    judged = F.transform("said", lambda x, i: F.struct(
        x.alias("sentence"), F.get(F.col("h"), i).alias("hash"), (F.array_position("h", F.get(F.col("h"), i)) == i + 1).alias("first_here"),
        (factual(x) & ~x.rlike(s.REFERENCE)).alias("uncited"), F.filter(s.references(x), lambda r: ~F.array_contains("may", r)).alias("bad_refs"),
    ))
    rows = hashed.select("draft", "section", F.posexplode(judged).alias("nth", "x")).select("draft", "section", "nth", "x.*")
    keys = hashed.select(F.col("draft").alias("d"), "section", F.explode(F.array_distinct(F.array_compact("h"))).alias("h"))
    first = keys.groupBy("d", "h").agg(F.min("section").alias("first"))
    met = rows.join(first, F.col("draft").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    return met.select("draft", "section", "nth", "sentence", "uncited", "bad_refs", F.when(F.col("first_here") & (F.col("first") < F.col("section")), F.col("first")).alias("repeats"))


def draft_verdicts(checked: DataFrame) -> DataFrame:
    """(draft, sentences, uncited, bad_refs, repeats, passed): a draft passes if none of its sentences is at fault."""
    count = lambda c: F.sum(c.cast("long"))
    sums = checked.groupBy("draft").agg(
        F.count("*").alias("sentences"), count(F.col("uncited")).alias("uncited"), count(F.size("bad_refs")).alias("bad_refs"), count(F.col("repeats").isNotNull()).alias("repeats")
    )
    return sums.withColumn("passed", (F.col("uncited") + F.col("bad_refs") + F.col("repeats")) == 0)
