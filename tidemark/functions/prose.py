"""What sentences of reports and feedback say: claims, fillers, kinds of events, products, layers, punctuation of Hebrew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import HEBREW_MONTHS
from .gates import any_of, has_word, host, within_domains
from .keys import name_key

# Signs of a checkable sentence.
CURRENCIES, CAPITALISED = r"[$€₪£]|USD|ILS|EUR|GBP", r"(?U)\b[A-Z][A-Za-z0-9.&\-]+\b"
ENGLISH_MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
)
FACTUAL_VERBS = ("זכתה", "חתמה", "רכשה", "הודיעה", "השיקה", "נבחרה", "קיבלה", "סיפקה", "נחתם", "הוענק")
# Phrases that say nothing.
FILLERS = (
    "יש לציין כי", "יש לציין ש", "יש לציין", "חשוב להדגיש כי", "חשוב להדגיש ש", "חשוב להדגיש", "בהקשר זה", "ראוי לציין כי",
    "ראוי לציין", "יש לזכור כי", "יש לזכור", "כפי שניתן לראות", "כפי שצוין לעיל", "כאמור לעיל", "יצוין כי", "נציין כי",
    "מן הראוי לציין", "בהתייחס לכך", "במסגרת זו", "ניתן לומר כי", "ניתן לציין כי", "באופן כללי ניתן לומר",
)
# Words that open a section by leaning on another.
CONNECTIVES = ("במקביל לכך", "מקביל לכך", "בנוסף לכך", "בנוסף", "כמו כן", "יתרה מכך", "לצד זאת")
# What backs a strong claim, strong words with what stands for them, and words that carry nothing.
QUANTITY = r"(?U)\d|%|\bאחוז(ים)?\b|\bמיליון\b|\bמיליארד\b|\bאלף\b|\bפי\s+\d|\bלעומת\s+(ה)?ממוצע\b"
STRONG = (
    (r"ניכר(ת|ים)?\s+התעצמות(\s+דרמטית)?\s+ב", "נרשמו דיווחים על "), (r"ניכר(ת|ים)?\s*", ""), (r"זינוק\s*", ""), (r"דרמטי(ת|ים)?\s*", ""),
    (r"משמעותי(ת|ים)?\s*", ""), (r"תאוצה\s*", ""), (r"עלייה\s+חדה\s*", "עלייה "), (r"קפיצת\s+מדרגה\s*", ""), (r"מצביע(ה)?\s+בבירור\s+על\s*", "קשור ל"),
    (r"מסמ[נן](ה|ת|ים|ות)?\s*", ""), (r"התעצמות\s*", ""), (r"הולכת\s+וגוברת\s*", ""), (r"מגמה\s*", ""), (r"יוצא(ת)?\s+דופן\s*", ""),
    (r"היסטורי(ת|ים)?\s*", ""), (r"ענק(ית|ים)?\s*", ""), (r"בולט(ת|ים|ות)?\s*", ""), (r"בהיקפים\s+גדולים\s*", ""), (r"חסר(ת|י)?\s+תקדים\s*", ""),
)
EMPTY_WORDS = ("החודש", "השבוע", "כי", "על", "עם", "גם", "עוד", "כן", "זה", "זו", "אלה", "של", "אשר", "הוא", "היא", "אל", "ב", "ל")
LEAST_TOKENS = 3
# Words of deals, and the kinds of events that are deals by themselves.
DEAL_WORDS = (
    "acquire", "acquires", "acquired", "acquisition", "acquisitions", "merger", "mergers", "merge", "buyout", "buyouts", "stake",
    "funding round", "investment", "joint venture",
)
HEBREW_DEAL_WORDS, DEAL_KINDS = ("רכישה", "רכישת", "מיזוג", "השקעה", "גיוס", "שותפות"), ("m_and_a", "acquisition", "investment", "partnership")
# Vocabulary by which the kind of an event is told.
ACQUISITION = (
    r"(?iU)\bacqui(?:re|res|red|ring|sition)\w*\b|\bmerger\b|\bmerge[sd]?\b|\btakeover\b|\bbuyout\b|\bto\s+buy\b"
    r"|רכיש[הת]|רכש[הו]|נרכש[הו]?|מיזוג|השתלטות"
)
PARTNERSHIP = (
    r"(?iU)\bpartner(?:ship)?s?\b|\bteaming\b|\bjoint\s+(?:venture|offer|bid)\b|\bcollaborat\w*\b|\bco-market\w*\b|\bworking\s+together\b"
    r"|שיתוף\s+פעולה|שותפ(?:ות|ה)"
)
INVESTMENT = (
    r"(?iU)\bfunding\s+round\b|\bfinancing\s+round\b|\braised\b|\binvestment\s+round\b|\bequity\s+round\b|\bfundrais\w*\b"
    r"|גיוס\s+הון|סבב\s+גיוס"
)
RESULTS = (
    r"(?iU)\bbacklog\b|\bearnings\b|\bquarterly\s+results\b|\bnet\s+profit\b|\brevenue\b|\bbeats\s+analysts\b|\border\s+book\b"
    r"|מלאי\s+הזמנות|רבעון|רווח\s+נקי|תוצאות\s+כספיות|דיווח(?:ה)?\s+על\s+שיא"
)
APPOINTMENT = (
    r"(?iU)\bappoint(?:s|ed|ment)?\b|\bnamed\s+as\b|\bchosen\s+to\s+(?:lead|head)\b|\bto\s+head\b|\bnew\s+(?:CEO|president|chairman)\b"
    r"|מינוי|מונ[התה]|נבחר\s+ל|ראש\s+הפעילות|ראש\s+פעילות|יכהן\s+כ"
)
# What readers ask for.
SHORTER, LONGER = r"(?U)יותר\s*קצר|קצר\s*יותר", r"(?U)יותר\s*ארוך|ארוך\s*יותר"
WATCH, IRRELEVANT = r"(?U)להוסיף\s+מעקב\s+אחרי\s+(.+?)(?:[.,\n]|$)", r"(?U)לא\s+רלוונטי\s*:\s*(.+?)(?:[.,\n]|$)"
# Signs of a data sheet, catalogues, and the length from which an alias stands by itself.
SHEET_WORDS = ("datasheet", "data-sheet", "data sheet", "brochure", "spec sheet", "specsheet", "fact sheet")
CATALOGUES = ("instro.com", "army-technology.com", "naval-technology.com", "airforce-technology.com", "defense-update.com")
LONG_ALIAS = 8
_HEBREW = r"\x{590}-\x{5FF}\x{FB1D}-\x{FB4F}"


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return any_of(F.contains(text, F.lit(w)) for w in words)


def _longest_first(phrases: tuple[str, ...]) -> str:
    return "|".join(rf"\Q{p}\E" for p in sorted(phrases, key=lambda p: (-len(p), p)))


def _swap(text: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def factual(sentence: Column) -> Column:
    """Whether a sentence says something checkable: a digit, a currency, a capitalised Latin word, a month or a verb of fact; null does not."""
    s = F.coalesce(sentence, F.lit(""))
    return s.rlike(r"(?U)\d") | s.rlike(CURRENCIES) | s.rlike(CAPITALISED) | _holds(s, HEBREW_MONTHS + ENGLISH_MONTHS + FACTUAL_VERBS)


def without_filler(text: Column) -> Column:
    """(text, removed): fillers in order of place taken out, longer ones first, and the blanks and marks they leave; else as it is."""
    pattern = _longest_first(FILLERS)
    removed = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
    marks = ((r" {2,}", " "), (r"^\s*[,:;]+\s*", ""), (r"\s+([.,:;)\]])", "$1"), (r"([.,:;])\1+", "$1"), (r"^\s+|\s+$", ""))
    return F.struct(F.when(F.size(removed) > 0, _swap(text, (pattern, " "), *marks)).otherwise(text).alias("text"), removed.alias("removed"))


def without_connective(text: Column) -> Column:
    """One connective taken from the start, and its comma; a text that is nothing else stays."""
    rest = F.regexp_replace(text, rf"^\s*(?:{_longest_first(CONNECTIVES)})(?![א-ת])(?:\s*,)?\s*", "")
    return F.when(rest == "", text).otherwise(rest)


def backed_claim(text: Column) -> Column:
    """A strong claim without a quantity loses its strong words, and becomes null if less than three words of content remain."""
    weaker = _swap(text, *STRONG, (r"\s{2,}", " "), (r"^[ ,.\-]+|[ ,.\-]+$", ""))
    words = F.regexp_extract_all(F.regexp_replace(weaker, r"\[\d+\]", ""), F.lit(r"(?U)[א-ת]{2,}|[A-Za-z]{2,}|\d+"), 0)
    content = F.size(F.filter(words, lambda w: ~w.isin(*EMPTY_WORDS)))
    strong = text.rlike("|".join(p for p, _ in STRONG)) & ~text.rlike(QUANTITY)
    return F.when(strong, F.when(content >= LEAST_TOKENS, weaker)).otherwise(text)


def deal_signal(text: Column, kinds: Column) -> Column:
    """Words of a deal in the text, or one of the kinds is a deal's."""
    kind = F.coalesce(F.arrays_overlap(kinds, F.array(*map(F.lit, DEAL_KINDS))), F.lit(False))
    return kind | has_word(text, *DEAL_WORDS) | _holds(F.coalesce(text, F.lit("")), HEBREW_DEAL_WORDS)


def event_kind(kind: Column, text: Column) -> Column:
    """(kind, evidence): an acquisition without its vocabulary becomes what its text tells; results are told from regulation and other.

    The evidence is the match with 30 characters around it; null where the kind stays.
    """
    t = F.coalesce(text, F.lit(""))

    def near(pattern: str) -> Column:
        start, length = F.regexp_instr(t, F.lit(pattern)), F.length(F.regexp_extract(t, pattern, 0))
        first = F.greatest(start - 30, F.lit(1))
        return F.trim(F.substring(t, first, start + length + 30 - first))

    other = (("partnership", PARTNERSHIP), ("investment", INVESTMENT), ("appointment", APPOINTMENT))
    unfounded, results = (kind == "m_and_a") & ~t.rlike(ACQUISITION), kind.isin("regulation", "other") & t.rlike(RESULTS)
    told, found = F.lit(None).cast("string"), F.lit("none of the vocabularies")
    for name, pattern in reversed(other):
        told, found = F.when(t.rlike(pattern), name).otherwise(told), F.when(t.rlike(pattern), near(pattern)).otherwise(found)
    new = F.when(unfounded, F.coalesce(told, F.lit("other"))).when(results, "financial_results").otherwise(kind)
    return F.struct(new.alias("kind"), F.when(unfounded, found).when(results, near(RESULTS)).alias("evidence"))


def wishes(text: Column) -> Column:
    """(length, add_watchlist, not_relevant) that a reader's free text asks for; null where it doesn't."""
    t = F.coalesce(text, F.lit(""))
    asked = lambda pattern: F.nullif(F.trim(F.regexp_extract(t, pattern, 1)), F.lit(""))
    length = F.when(t.rlike(SHORTER), "shorter").when(t.rlike(LONGER), "longer")
    return F.struct(length.alias("length"), asked(WATCH).alias("add_watchlist"), asked(IRRELEVANT).alias("not_relevant"))


def names_product(text: Column, product: str, vendor: str | None, aliases: tuple[str, ...] = ()) -> Column:
    """The product's name or an alias of eight characters stands in the text, or a shorter alias and the vendor's name."""
    full = tuple(n for n in (product, *(a for a in aliases if len(a) >= LONG_ALIAS)) if n.strip())
    short = tuple(a for a in aliases if a.strip() and len(a) < LONG_ALIAS)
    by_name = has_word(text, *full) if full else F.lit(False)
    return by_name | (has_word(text, *short) & has_word(text, vendor) if vendor and short else F.lit(False))


def patent_reason(assignees: Column, title: Column, text: Column, product: str, vendor: str | None, aliases: tuple[str, ...] = ()) -> Column:
    """(reason, found): `assignee` with the first one whose name holds, or is held by, the vendor's or an alias; else `product` with
    the product's name, if title or text has it; null where neither holds or there is no assignee at all."""
    names = [n for n in (vendor, *aliases) if n and n.strip()]
    known = F.filter(F.array(*(name_key(F.lit(n)) for n in names)).cast("array<string>"), lambda n: n != "")
    same = lambda a, n: (a != "") & (F.contains(a, n) | F.contains(n, a))
    owner = F.get(F.filter(assignees, lambda a: F.exists(known, lambda n: same(name_key(a), n))), F.lit(0))
    told = has_word(F.concat_ws(" ", title, text), product) if product.strip() else F.lit(False)
    reason = F.when(owner.isNotNull(), F.struct(F.lit("assignee").alias("reason"), owner.alias("found")))
    return F.when(F.size(assignees) > 0, reason.when(told, F.struct(F.lit("product").alias("reason"), F.lit(product).alias("found"))))


def layers(hebrew: Column, english: Column, defs: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> Column:
    """Keys of the layers {key: (Hebrew substrings, English words)} that a text belongs to, in their order."""
    he = F.coalesce(hebrew, F.lit(""))
    hit = {k: _holds(he, a) | (has_word(english, *b) if b else F.lit(False)) for k, (a, b) in defs.items()}
    return F.array_compact(F.array(*(F.when(c, k) for k, c in hit.items())).cast("array<string>"))


def patent_layers(codes: Column, title: Column, abstract: Column, hints: dict[str, tuple[str, ...]], defs: dict) -> Column:
    """Keys of the layers whose code prefixes {key: prefixes} one of the codes has; without any, the layers of title and abstract."""
    begins = lambda prefix: F.exists(codes, lambda c: c.startswith(prefix))
    own = {k: any_of(map(begins, some)) for k, some in hints.items()}
    by_code = F.array_compact(F.array(*(F.when(c, k) for k, c in own.items())).cast("array<string>"))
    return F.when(F.size(by_code) > 0, by_code).otherwise(layers(F.lit(None), F.concat_ws(" ", title, abstract), defs))


def sheet_order(url: Column, title: Column, vendor_domain: str | None) -> Column:
    """(rank, off_vendor, off_catalogue), least first: PDF data sheets, other PDFs, other data sheets, the rest."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))
    path = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^(?:[^/?#]*//[^/?#]*)?([^?#]*)", 1)
    pdf, sheet, site = path.endswith(".pdf"), _holds(hay, SHEET_WORDS), F.regexp_replace(host(url), r"^www\.", "")
    rank = F.when(pdf & sheet, 0).when(pdf, 1).when(sheet, 2).otherwise(3)
    off = lambda names: (~within_domains(site, names)).cast("int") if names else F.lit(1)
    return F.struct(rank.alias("rank"), off((vendor_domain,) if vendor_domain else ()).alias("off_vendor"), off(CATALOGUES).alias("off_catalogue"))


def hebrew_marks(text: Column) -> Column:
    """Quotes, blanks and signs of Hebrew prose set right; a second time changes nothing. Backslashes before quotes and isolates go,
    doubled quotes become one, quotes within and apostrophes after Hebrew become its own marks, no blank stays before a closing mark
    that follows a bracket or quote, a percent sign follows its number, and a prefix's hyphen touches what it binds."""
    return _swap(
        text, (r"""\\(["'])""", "$1"), (r"[\x{2066}-\x{2069}]", ""), (r'"{2,}', '"'), (rf'(?<=[{_HEBREW}])"(?=[{_HEBREW}])', "״"),
        (rf"(?<=[{_HEBREW}])'", "\u05F3"), (r"""([\])"])\s+([.,;:!?])""", "$1$2"), (r"%\s*(\d+(?:\.\d+)?)", "$1%"), (r"([בכלמשוה]-)\s+(?=[0-9A-Za-z])", "$1"),
    )


def hebrew_names(text: Column, variants: dict[str, tuple[str, ...]]) -> Column:
    """Variants {name: variants} replaced by the name, longer ones first, also after a one-letter prefix; not within longer words,
    addresses or <bdi> spans."""
    rules = [(v, name) for name, some in variants.items() for v in some if v != name]
    swaps = [(rf"(?<![א-ת])([ובלמשהכ]?)\Q{v}\E(?![א-ת])", "$1" + n) for v, n in sorted(rules, key=lambda r: (-len(r[0]), r[0]))]
    kept = r"(?is)<bdi[^>]*>.*?</bdi>|https?://\S+"
    spans = F.regexp_extract_all(text, F.lit(kept), 0)
    return F.array_join(F.transform(F.split(text, kept, -1), lambda p, i: F.concat(_swap(p, *swaps), F.coalesce(F.get(spans, i), F.lit("")))), "")


def verbatim(value: Column, text: Column) -> Column:
    """The value if the text tells it, plainly or with its thousands or its point as commas; else null. Four decimals count."""
    x = value.cast("double")
    whole = x == F.floor(x)
    plain = F.when(whole, F.format_string("%.0f", x)).otherwise(F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", ""))
    other = F.when(whole, F.format_number(x, 0)).otherwise(F.translate(plain, ".", ","))
    return F.when(F.contains(text, plain) | F.contains(text, other), value)


def search_key(provider: Column, query: Column, lang: Column, categories: Column, since: Column, engines: Column) -> Column:
    """One key for searches that differ in case, blanks and the order of engines only; nulls count as empty."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    plain = F.trim(F.regexp_replace(low(query), r"\s+", " "))
    names = F.array_sort(F.transform(F.coalesce(engines, F.array().cast("array<string>")), low))
    return F.sha2(F.to_json(F.array(F.coalesce(provider, F.lit("")), plain, low(lang), F.coalesce(categories, F.lit("general")), F.coalesce(since, F.lit("")), F.array_join(names, ","))), 256)
