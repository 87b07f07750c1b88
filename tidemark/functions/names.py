"""Names of people and companies: spellings of one name in two scripts, the shape of a person's name, aliases in texts, garbled letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .gates import has_word
from .keys import name_key
from .titles import ratio

# Consonants of Hebrew letters; letters that stand for vowels have none.
CONSONANTS = {
    "א": "", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "", "ז": "z", "ח": "kh", "ט": "t", "י": "", "כ": "k", "ך": "k", "ל": "l", "מ": "m",
    "ם": "m", "נ": "n", "ן": "n", "ס": "s", "ע": "", "פ": "p", "ף": "p", "צ": "tz", "ץ": "tz", "ק": "k", "ר": "r", "ש": "sh", "ת": "t",
}
SAME_PERSON = 0.85
# Words that make a name a company's.
COMPANY_WORDS = (
    "inc", "ltd", "llc", "corp", "corporation", "group", "systems", "technologies", "industries", "aerospace", "defense", "defence",
    "electronics", "dynamics", "solutions", "holdings", "company", "co",
)
# Fixed value: what text looks like whose UTF-8 was misread.
MISREAD = "â€|Ã[\u0080-ÿ]"
#: The characters that windows-1252 has where Latin-1 has control characters, and those.
_BYTES = bytes(b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_BEYOND_LATIN = (_BYTES.decode("cp1252"), _BYTES.decode("latin-1"))


def skeleton(name: Column) -> Column:
    """A name's consonants in Latin letters, whichever of the two scripts it is in; all else is dropped, and null is empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-zא-ת]|[aeiou]", "")
    pairs = [k for k, v in CONSONANTS.items() if len(v) == 2]
    for k in pairs:
        bare = F.replace(bare, F.lit(k), F.lit(CONSONANTS[k]))
    single = [k for k in CONSONANTS if k not in pairs]
    single.sort(key=lambda k: not CONSONANTS[k])  # translate drops the letters that come last, without a counterpart
    return F.translate(bare, "".join(single), "".join(CONSONANTS[k] for k in single))


def same_person(a: Column, b: Column, least: float = SAME_PERSON) -> Column:
    """Names equal but for case and marks, or whose consonants agree by `least`."""
    return (name_key(a) == name_key(b)) | (ratio(skeleton(a), skeleton(b)) >= least)


def person_shape(name: Column, known: Column | None = None) -> Column:
    """Two to four words, all Hebrew, or all Latin with a capital and none of a company; a name known for something else has it not."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")), " ")
    hebrew = F.forall(words, lambda w: w.rlike(r"""^[\x{590}-\x{5FF}'"\-]+$"""))
    company = F.exists(words, lambda w: F.lower(F.regexp_replace(w, r"^\.+|\.+$", "")).isin(*COMPANY_WORDS))
    latin = F.forall(words, lambda w: w.rlike(r"^[A-Z][a-zA-Z.'\-]*$")) & ~company
    return F.size(words).between(2, 4) & (hebrew | latin) & (~F.coalesce(known, F.lit(False)) if known is not None else F.lit(True))


def mentioned(text: Column, companies: dict[str, tuple[str, ...]], strict: tuple[str, ...] = ()) -> Column:
    """Companies {name: aliases} that a text names, in order of their longest surface found; a strict alias counts only beside a
    surface of its company that isn't strict. Null names none."""
    hits = []
    for name, aliases in companies.items():
        surfaces = sorted({name, *aliases} - {""}, key=lambda s: (-len(s), s))
        plain = [s for s in surfaces if s.lower() not in {x.lower() for x in strict}]
        found = has_word(text, *plain) if plain else F.lit(False)
        longest = F.coalesce(*(F.when(has_word(text, s), len(s)) for s in surfaces))
        hits.append(F.when(found, F.struct((-longest).alias("size"), F.lit(name).alias("name"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*hits))), lambda h: h["name"])


def _reading(text: Column, table: tuple[str, str] = ("", "")) -> Column:
    """The characters as bytes of a one-byte encoding, read as UTF-8; null where they are no such bytes or no UTF-8.

    table turns the characters that the encoding has beyond Latin-1 into the characters of their bytes there.
    """
    possible = text.rlike(f"^[\\x{{00}}-\\x{{7F}}\\x{{A0}}-\\x{{FF}}{table[0]}]*$") if table[0] else text.rlike(r"^[\x{00}-\x{FF}]*$")
    own = F.encode(F.translate(F.when(possible, text), *table), "ISO-8859-1")
    return F.try_validate_utf8(own.cast("string"))


def _worth(text: Column) -> Column:
    """Letters of the two scripts, less five for each mark of a wrong reading."""
    return F.regexp_count(text, F.lit("[\u0590-\u05ffA-Za-z]")) - 5 * F.regexp_count(text, F.lit(f"\ufffd|{MISREAD}"))


def repaired(text: Column) -> Column:
    """Text whose UTF-8 was read as windows-1252 or Latin-1, once or twice, read right where that is worth more; else as it is.

    Of equal worth stays what comes first: the text, the readings by windows-1252, those by Latin-1. Built-in functions only.
    """
    readings = [text]
    for table in (_BEYOND_LATIN, ("", "")):
        once = _reading(text, table)
        readings += [once, _reading(once, table)]
    ranked = [F.when(r.isNotNull(), F.struct(_worth(r).alias("worth"), F.lit(-i).alias("first"), r.alias("text"))) for i, r in enumerate(readings)]
    return F.when(text.rlike("[\u0080-ÿ]"), F.array_max(F.array(*ranked))["text"]).otherwise(text)
