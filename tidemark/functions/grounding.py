"""Claims held against their source: amounts at their scale, names, sentences that name what the source doesn't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import name_key

# Words of scale, what tells a valuation from a deal, and how far from the figure it counts.
SCALES = ((10**9, ("billion", "bn", "b", "מיליארד", "מיליארדי")), (10**6, ("million", "mn", "mm", "m", "מיליון", "מיליוני")), (10**3, ("thousand", "k", "אלף")))
VALUATION = r"(?i)valuation|valued\s+at|market\s+cap|market\s+value|worth\s+an\s+estimated|שווי"
BEFORE, AFTER = 60, 14
# What stands for no name, and the length of a text too short to claim from.
NO_NAME = ("לא צוין", "לא ידוע", "not specified", "unspecified", "n/a", "na", "unknown", "—", "-", "none")
THIN_CHARS = 80
# Candidates for names of organisations in a sentence, by script, and figures that a source must have.
LATIN_NAME = r"\b[A-Z][A-Za-z0-9]{1,}(?:[-\s][A-Z][A-Za-z0-9]{1,}){1,4}\b"
HEBREW_NAME = r"(?<![א-ת])[בלמוהשכ]?(?:אוניברסיטת|אוניברסיטה|מעבדות|מעבדת|חטיבת|מכון|משרד|רשות|זרוע)(?:\s+(?:[א-ת][א-ת'\"׳״]*|[A-Za-z][A-Za-z0-9]*|\([^)]{1,20}\))){1,3}"
MONEY = r"(?i)[$€₪]\s?\d[\d,.]*\s?(?:[MBK]\b)?|\b\d[\d,.]*\s?(?:מיליון|מיליארד|million|billion|USD|EUR)\b"
YEAR = r"\b(?:19|20)\d{2}\b"
COMPETITORS = r"(?i)(מתחרותיה|מתחרים(?:\s+שלה)?|מתחרה(?:\s+עיקרית)?|competitors?|rivals?)(\s+(?:כמו|כגון|including|such as|like)\s+)(.+?)(?=[.,;]|$)"
BETWEEN_NAMES = r"(?i),\s*|\s+ו-?\s*|\s+and\s+|\s*&\s*"
AFFILIATION = (
    r"(?i)(?:,\s*)?(?:חברה[\s-]?בת של|חברת[\s-]?בת של|בבעלות(?:\s+של)?|חטיבה של|חטיבת|זרוע של|נרכשה על ידי|חברה[\s-]?אם(?:\s+של)?"
    r"|\bsubsidiary of\b|\bowned by\b|\bdivision of\b|\bpart of\b)\s*([^,.()]{1,60}?)(?:\s*\(([^)]{1,20})\))?(?=[,.()]|$)"
)
# Numbers that a source may spell out (of two digits; smaller ones aren't checked).
SPELLED = {
    10: ("ten", "עשרה", "עשר"), 11: ("eleven", "אחד עשר", "אחת עשרה"), 12: ("twelve", "שנים עשר", "שתים עשרה"), 13: ("thirteen", "שלושה עשר", "שלוש עשרה"),
    14: ("fourteen", "ארבעה עשר", "ארבע עשרה"), 15: ("fifteen", "חמישה עשר", "חמש עשרה"), 16: ("sixteen", "שישה עשר", "שש עשרה"), 17: ("seventeen", "שבעה עשר", "שבע עשרה"),
    18: ("eighteen", "שמונה עשר", "שמונה עשרה"), 19: ("nineteen", "תשעה עשר", "תשע עשרה"), 20: ("twenty", "עשרים"),
}


def _digits(whole: Column) -> Column:
    """A pattern of a whole number with or without marks between its thousands, as no part of a longer number."""
    return F.concat(F.lit(r"(?<!\d)(?<!\d\.)"), F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", "[,.]?"), F.lit(r"(?!\d)(?!\.\d)"))


def grounded_amount(amount: Column, text: Column) -> Column:
    """(grounded, valuation, evidence) of an amount in a text; an amount that isn't positive, or a null or empty text, is grounded.

    A figure stands for the amount in the words of one scale ("3.1 billion", "US$3,1bn"), tried from billions down to thousands,
    or, of four digits or more, written out with or without marks between thousands. The first place found counts: where a
    valuation is spoken of up to 60 characters before it or 14 after it, the figure is no deal's. Only words of its own scale
    make a figure, so 10 million never stands for 10 billion. evidence is the place with 40 characters around it.
    """
    value, text = amount.cast("double"), F.coalesce(text, F.lit(""))
    places = []
    for scale, words in SCALES:
        after = rf"\s*(?:-|to|–)?\s*(?:{'|'.join(sorted(words, key=len, reverse=True))})\b"
        places.append(F.when((value / scale).between(0.01, 100_000), _once(_reduced(value / scale), lambda figure: _figure_at(text, figure, after))))  # noqa: B023
    whole = F.floor(value).cast("long").cast("string")
    written = F.struct(F.regexp_instr(text, _digits(whole)).alias("start"), F.length(F.regexp_substr(text, _digits(whole))).alias("n"))
    told = (value == F.floor(value)) & (value >= 1000) & F.contains(F.translate(text, ",.", ""), whole)
    places.append(_once(F.when(told, written), lambda w: F.when(w["start"] > 0, w)))
    # the place and length of the first match, of the first scale that has one
    idle = value.isNull() | (value <= 0) | (text == "")
    nothing = F.struct(F.lit(True).alias("grounded"), F.lit(False).alias("valuation"), F.lit("").alias("evidence"))
    return F.when(idle, nothing).otherwise(_once(F.coalesce(*places), lambda found: _judged(found, text)))


def _once(value: Column, body) -> Column:
    """body(value) with the value reckoned once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _reduced(value: Column) -> Column:
    return F.regexp_replace(F.format_string("%.4f", F.round(value, 4)), r"\.?0+$", "")


def _figure_at(text: Column, figure: Column, after: str) -> Column:
    """(start, n) of the first place of a figure with one of a scale's words behind it; null without one.

    Few texts hold a figure's digits at all, so that is seen first. Patterns that are the same for all rows are compiled once; a row's
    own is only needed where the figure stands behind others of its scale.
    """
    before = r"(?iU)(?=[\s\d$€£₪Uu])(?<![\d.,])(?:US\$|USD|\$|€|£|₪)?\s*"
    number = r"[0-9]+(?:[.,][0-9]+)?"
    numbers = F.regexp_extract_all(text, F.lit(rf"(?iU)(?=[0-9])(?<![\d.,])({number}){after}"), 1)
    nth = F.array_position(F.transform(numbers, lambda n: F.translate(n, ",", ".")), figure)
    place = lambda pattern: F.struct(F.regexp_instr(text, pattern).alias("start"), F.length(F.regexp_substr(text, pattern)).alias("n"))
    every, own = F.lit(before + number + after), F.concat(F.lit(before), F.replace(figure, F.lit("."), F.lit("[.,]")), F.lit(after))
    at = _once(nth, lambda i: F.when(i == 1, place(every)).when(i > 1, place(own)))
    return F.when(F.contains(text, figure) | F.contains(text, F.replace(figure, F.lit("."), F.lit(","))), at)


def _judged(found: Column, text: Column) -> Column:
    start, end = found["start"], found["start"] + found["n"]
    clip = lambda a, b: F.substring(text, F.greatest(a, F.lit(1)), b - F.greatest(a, F.lit(1)))
    valuation = clip(start - BEFORE, start).rlike(VALUATION) | clip(end, end + AFTER).rlike(VALUATION)
    evidence = F.coalesce(F.trim(clip(start - 40, end + 40)), F.lit(""))
    return F.struct(found.isNotNull().alias("grounded"), F.coalesce(valuation, F.lit(False)).alias("valuation"), evidence.alias("evidence"))


def no_placeholder(name: Column) -> Column:
    """The name, null where it is a word for none."""
    return F.when(~F.lower(F.trim(name)).isin(*NO_NAME), name)


def said(name: Column, corpus: Column, surfaces: Column) -> Column:
    """A name stands in a lower-cased corpus, or one of its other surfaces (null: none known) does; blank names do."""
    other = F.coalesce(F.exists(surfaces, lambda s: F.contains(corpus, F.lower(s))), F.lit(False))
    return F.coalesce(F.trim(name) == "", F.lit(True)) | F.contains(corpus, F.lower(name)) | other


def units(text: Column) -> Column:
    """Sentences as short prose has them: what stands between blanks after a full stop, exclamation or question mark."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda u: F.trim(u) != "")


def tidy(text: Column) -> Column:
    """Without what a cut leaves: blanks before marks, doubled commas, marks at the head, runs of blanks."""
    steps = ((r"\s+([.,:;!?])", "$1"), (r",\s*,", ","), (r",\s*\.", "."), (r"^[,\s]+", ""), (r"[ \t]{2,}", " "))
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def joined(parts: Column) -> Column:
    return tidy(F.array_join(F.transform(parts, F.trim), " "))


def name_candidates(text: Column) -> Column:
    """Names of organisations that a sentence may hold: two to five capitalised words outside parentheses, and Hebrew institutions."""
    open_text = F.regexp_replace(text, r"\([^)]*\)", "()")
    return F.array_distinct(F.concat(F.regexp_extract_all(open_text, F.lit(LATIN_NAME), 0), F.transform(F.regexp_extract_all(text, F.lit(HEBREW_NAME), 0), F.trim)))


def _all_words(name: Column, corpus: Column) -> Column:
    words = F.filter(F.split(name, r"[-\s]+"), lambda w: F.length(w) >= 3)
    return (F.size(words) >= 2) & F.forall(words, lambda w: F.contains(corpus, F.lower(w)))


def known_of(name: Column, known: Column) -> Column:
    """The dictionary's entry of a name in an array of (key, country, surfaces); null if it has none."""
    return F.get(F.filter(known, lambda k: k["key"] == name_key(name)), F.lit(0))


def name_grounded(name: Column, corpus: Column, known: Column) -> Column:
    """A name stands in a lower-cased corpus: literally, by another surface of its entry, or word by word.

    Word by word only Latin names of two words or more (of three letters or more) count, the entry's surfaces as well; a country
    must stand by one of its surfaces. Blank names are grounded.
    """
    hebrew = lambda s: s.rlike("[א-ת]")
    entry = known_of(name, known)
    by_entry = F.exists(entry["surfaces"], lambda s: F.contains(corpus, F.lower(s)) | (~entry["country"] & ~hebrew(s) & _all_words(s, corpus)))
    otherwise = ~hebrew(name) & _all_words(name, corpus)
    return F.coalesce(F.trim(name) == "", F.lit(True)) | F.contains(corpus, F.lower(name)) | F.when(entry.isNotNull(), by_entry).otherwise(otherwise)


def named_units(parts: Column, corpus: Column, known: Column) -> Column:
    """Sentences all of whose candidates for names are grounded."""
    return F.filter(parts, lambda u: F.forall(name_candidates(u), lambda c: name_grounded(c, corpus, known)))


def figure_grounded(figure: Column, corpus: Column) -> Column:
    """A figure's digits stand in the corpus as a number of their own, or spelled out; one digit alone isn't checked."""
    digits = F.regexp_replace(figure, r"\D", "")
    words = F.create_map(*(F.lit(x) for n, w in SPELLED.items() for x in (str(n), rf"(?iU)\b(?:{'|'.join(w)})\b")))
    spelled = F.coalesce(F.regexp_like(corpus, F.try_element_at(words, digits)), F.lit(False))
    return (F.length(digits) < 2) | F.regexp_like(corpus, _digits(digits)) | spelled


def figured_units(parts: Column, corpus: Column) -> Column:
    """Sentences all of whose sums of money and years are grounded."""
    figures = lambda u: F.concat(F.regexp_extract_all(u, F.lit(MONEY), 0), F.regexp_extract_all(u, F.lit(YEAR), 0))
    return F.filter(parts, lambda u: F.forall(figures(u), lambda f: figure_grounded(f, corpus)))


def without_false_rivals(text: Column, corpus: Column, known: Column) -> Column:
    """Lists of competitors keep the names that are grounded; a list that keeps none goes with what introduces it."""

    def trimmed(found: Column) -> Column:
        names = F.filter(F.transform(F.split(F.regexp_extract(found, COMPETITORS, 3), BETWEEN_NAMES), F.trim), lambda n: n != "")
        kept = F.filter(names, lambda n: name_grounded(n, corpus, known))
        told = F.concat(F.regexp_extract(found, COMPETITORS, 1), F.regexp_extract(found, COMPETITORS, 2), F.array_join(kept, ", "))
        return F.when(F.size(kept) == F.size(names), found).when(F.size(kept) == 0, "").otherwise(told)

    lists = F.regexp_extract_all(text, F.lit(COMPETITORS), 0)
    return F.aggregate(lists, text, lambda t, found: F.replace(t, found, trimmed(found)))


def without_false_owners(unit: Column, sentences: Column, known: Column, child: Column) -> Column:
    """A sentence without clauses of ownership that no one sentence of the source bears out.

    Owner and owned must be grounded in the same sentence; the owned is the last candidate for a name before the clause, else
    `child`; without either the clause stays.
    """

    def kept(text: Column, clause: Column) -> Column:
        parents = F.filter(F.array(F.trim(F.regexp_extract(clause, AFFILIATION, 1)), F.trim(F.regexp_extract(clause, AFFILIATION, 2))), lambda p: p != "")
        before = F.split_part(text, clause, F.lit(1))
        owned = F.coalesce(F.get(F.reverse(name_candidates(before)), F.lit(0)), child)
        borne = F.exists(sentences, lambda s: name_grounded(owned, F.lower(s), known) & F.exists(parents, lambda p: name_grounded(p, F.lower(s), known)))
        return owned.isNull() | borne | (F.size(parents) == 0)

    clauses = F.regexp_extract_all(unit, F.lit(AFFILIATION), 0)
    return tidy(F.aggregate(clauses, unit, lambda t, clause: F.when(kept(unit, clause), t).otherwise(F.replace(t, clause, F.lit("")))))
