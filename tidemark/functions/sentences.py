"""Sentences of prose, with abbreviations and decimals kept whole, and the references they carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = (
    'ד"ר', 'עו"ד', 'רו"ח', 'ח"כ', "אלוף", 'סא"ל', 'רס"ן', "סרן", 'ארה"ב', 'בריה"מ', 'צה"ל', 'משה"ב', "וכו'", "תואר", 'ע"י', 'ע"פ', 'א"א', 'י"ג', 'י"ד',
)
#: Blanks that may stand between an abbreviation and its mark; a look behind has to be bounded.
BLANKS = 8
SPACE = r"[ \t-\r]"
#: A repeated sentence counts from so many words.
REPEATED_WORDS = 4
REFERENCE = r"\[([0-9]+)\]"


def split(text: Column) -> Column:
    """Pieces of a text, one a sentence with the white space around it; put together they are the text. Null and empty texts have none.

    A sentence ends after a full stop, question mark, exclamation mark or colon with white space or the end behind it, but not
    after an abbreviation; a mark within a number ends nothing, as no white space follows it.
    """
    known = "|".join(ABBREVIATIONS)
    t = F.coalesce(text, F.lit(""))
    pieces = F.split(t, rf"(?<=[.?!:])(?={SPACE}|\z)(?<!(?:{known}){SPACE}{{0,{BLANKS}}}[.?!:])")
    return F.filter(pieces, lambda p: p != "")


def bare(piece: Column) -> Column:
    return F.regexp_replace(piece, rf"^{SPACE}+|{SPACE}+$", "")


def references(sentence: Column) -> Column:
    """Numbers in brackets, as decimals: a number of any length is kept."""
    return F.transform(F.regexp_extract_all(sentence, F.lit(REFERENCE), 1), lambda n: F.regexp_replace(n, "^0+(?=.)", ""))


def repeat_key(sentence: Column) -> Column:
    """What two repeated sentences share: no references, no marks, one blank between words, lower case; null under four words."""
    t = F.regexp_replace(F.regexp_replace(sentence, REFERENCE, ""), r"[^\p{L}\p{N}\p{M}_ \t-\r]", "")
    # at least so many words; told by the text before it is lowered, and the key is reckoned once
    collapsed = F.regexp_replace(bare(t), rf"{SPACE}+", " ")
    return F.get(F.transform(F.array(collapsed), lambda k: F.when(F.size(F.split(k, " ")) >= REPEATED_WORDS, F.lower(k))), F.lit(0))
