"""Documents as sentences, and as drafts that cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prose
from ..functions import sentences as s
from ..operators import citations
from .registry import query

_KNOWN = "|".join(a.replace("'", "''") for a in s.ABBREVIATIONS)
#: Sentences in SQL: a sign after each end, taken back after abbreviations, and cut there.
_CUT = rf"""marked AS (SELECT doc_id, source, regexp_replace(regexp_replace(text, '([.?!:])([ \t-\r]|$)', '\1' || chr(1) || '\2', 'g'), '((?:{_KNOWN})[ \t-\r]{{0,8}}[.?!:])' || chr(1), '\1', 'g') AS t FROM told),
rows AS (SELECT doc_id, source, unnest(string_split(t, chr(1))) AS piece, generate_subscripts(string_split(t, chr(1)), 1) AS p FROM marked),
said AS (SELECT *, regexp_replace(piece, '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS sentence,
  sum(length(piece)) OVER w - length(piece) + length(piece) - length(regexp_replace(piece, '^[ \t-\r]+', '')) AS start FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
sentences AS (SELECT doc_id, source, sentence, start::BIGINT AS start, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INT AS nth FROM said WHERE sentence <> '')"""
#: What is put before a document by doc_id % 4: decimals, abbreviations, marks without blanks.
PLANTED = ("It grew by 3.5 percent. Then it fell! ", 'דו"ח של ד"ר כהן פורסם בארה"ב. 2.75 מיליון? כן: ', "See example.com/a.b?c=d for it.No blank. ", "")
_TOLD = "told AS (SELECT doc_id, source, [" + ", ".join("'" + p.replace("'", "''") + "'" for p in PLANTED) + "][doc_id % 4 + 1] || coalesce(text, '') AS text FROM documents)"


def _told(t):
    planted = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("doc_id") % 4).cast("int") + 1)
    return t("documents").select("doc_id", "source", F.concat(planted, F.coalesce("text", F.lit(""))).alias("text"))


@query(f"WITH {_TOLD}, {_CUT} SELECT doc_id, nth, start, md5(sentence) AS digest, length(sentence)::BIGINT AS chars FROM sentences")
def sentence_rows(t):
    """Every sentence of every document, with its place."""
    rows = citations.sentences(_told(t), "doc_id", "text")
    return rows.select("doc_id", "nth", "start", F.md5("sentence").alias("digest"), F.length("sentence").cast("long").alias("chars"))


_NO = r"[^\p{L}\p{N}\p{M}_]"
_HEBREW = "|".join(prose.HEBREW_MONTHS + prose.ENGLISH_MONTHS + prose.FACTUAL_VERBS)
#: A document is a section of its source's draft; one that is divisible by 3 refers to number doc_id % 12 after its first full stop.
_CITING = r"""told AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(coalesce(text, ''), '\.', ' [' || (doc_id % 12) || '][7].') ELSE coalesce(text, '') END AS text FROM documents)"""


@query(rf"""WITH {_CITING}, {_CUT},
checked AS (SELECT *, regexp_extract_all(sentence, '\[([0-9]+)\]', 1) AS refs,
  lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sentence, '\[[0-9]+\]', '', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_ \t-\r]', '', 'g'), '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), '[ \t-\r]+', ' ', 'g')) AS key FROM sentences),
keyed AS (SELECT * REPLACE (CASE WHEN len(string_split(key, ' ')) >= 4 THEN key END AS key) FROM checked),
firsts AS (SELECT source, key, min(doc_id) AS first FROM keyed WHERE key IS NOT NULL GROUP BY source, key),
again AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, key ORDER BY nth) > 1 AS again FROM keyed)
SELECT doc_id, nth, len(refs) = 0 AND (regexp_matches(sentence, '[0-9]') OR regexp_matches(sentence, '{prose.CURRENCIES}') OR regexp_matches(sentence, '(?:^|{_NO})[A-Z](?:[A-Za-z0-9.&\-]*[A-Za-z0-9](?:{_NO}|$)|[A-Za-z0-9.&\-]*[.&\-][\p{{L}}\p{{N}}_])') OR regexp_matches(sentence, '{_HEBREW}')) AS uncited,
  array_to_string(list_filter(refs, lambda r: NOT (r::INT BETWEEN 1 AND 8 AND contains(a.source, 'a'))), ',') AS bad_refs, CASE WHEN NOT again AND first < doc_id THEN first END AS repeats
FROM again a LEFT JOIN firsts f ON a.source IS NOT DISTINCT FROM f.source AND a.key = f.key""")
def citation_check(t):
    """Sentences of drafts, one a source: claims without a reference, references to nothing, repetitions across documents."""
    docs = t("documents")
    number = F.concat(F.lit(" ["), (F.col("doc_id") % 12).cast("string"), F.lit("][7]."))
    text = F.coalesce("text", F.lit(""))
    cut = F.instr(text, ".")
    citing = F.when((F.col("doc_id") % 3 == 0) & (cut > 0), F.concat(F.substring(text, F.lit(1), cut - 1), number, F.substring(text, cut + 1, F.length(text)))).otherwise(text)
    drafts = docs.select(F.col("source").alias("draft"), F.col("doc_id").alias("section"), citing.alias("text"))
    registry = docs.where(F.contains("source", F.lit("a"))).select(F.col("source").alias("draft")).distinct().select("draft", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n"))
    rows = citations.check_citations(drafts, registry)
    return rows.select(F.col("section").alias("doc_id"), "nth", "uncited", F.array_join("bad_refs", ",").alias("bad_refs"), "repeats")
