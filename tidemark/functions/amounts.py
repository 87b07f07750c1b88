"""Amounts and days as texts tell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of magnitude, and the amount from which one is taken as told in full.
MAGNITUDES = (
    ("billion", 1e9), ("bn", 1e9), ("b", 1e9), ("million", 1e6), ("mn", 1e6), ("mm", 1e6), ("m", 1e6), ("thousand", 1e3), ("k", 1e3),
    ("מיליארד", 1e9), ("מיליון", 1e6), ("אלף", 1e3), ("מיליארדי", 1e9), ("מיליוני", 1e6),
)
FULL = 100_000.0
# Names of months, January first.
HEBREW_MONTHS = ("ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט", "ספטמבר", "אוקטובר", "נובמבר", "דצמבר")
ENGLISH_MONTHS = (
    ("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"),
    ("august", "aug"), ("september", "sep", "sept"), ("october", "oct"), ("november", "nov"), ("december", "dec"),
)


def scaled_amount(amount: Column, text: Column) -> Column:
    """(amount, word): an amount below 100,000 times the word of magnitude that follows the same number in the text; else as it is."""
    x = amount.cast("double")
    whole = x == F.floor(x)
    digits = F.when(whole, F.format_string("%.0f", x)).otherwise(F.regexp_replace(F.format_string("%.4f", x), r"0+$", ""))
    other = F.when(whole, F.format_number(x, 0)).otherwise(F.translate(digits, ".", ","))
    words = "|".join(w for w, _ in MAGNITUDES)

    def word_after(number: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iU)(?<![\d.,])(?:US\$|USD|\$|€|£)?\s*\Q"), number, F.lit(rf"\E\s*(?:-|to|–)?\s*({words})\b"))
        return F.nullif(F.lower(F.call_function("regexp_extract", F.coalesce(text, F.lit("")), pattern, F.lit(1))), F.lit(""))

    word = F.when((x > 0) & (x < FULL), F.coalesce(word_after(digits), word_after(other)))
    times = F.try_element_at(F.create_map(*(F.lit(y) for pair in MAGNITUDES for y in pair)), word)
    return F.struct(F.coalesce(F.round(x * times, 2), x).alias("amount"), word.alias("word"))


def deal_date(told: Column) -> Column:
    """yyyy-MM-dd or yyyy-MM of a day told as either, as d/m/yyyy, or by a Hebrew or English month and a year; else null."""
    t = F.trim(F.coalesce(told, F.lit("")))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    iso, month, slash = r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{4})-(\d{2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    day_of = lambda y, m, d: F.date_format(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")
    hebrew, english = r"([א-ת]+)\s+(\d{4})", r"([A-Za-z]+)\.?\s+(\d{4})"
    by_hebrew = F.try_element_at(F.create_map(*(F.lit(x) for i, w in enumerate(HEBREW_MONTHS, 1) for x in (w, f"{i:02d}"))), part(hebrew, 1))
    names = [(w, f"{i:02d}") for i, ws in enumerate(ENGLISH_MONTHS, 1) for w in ws]
    by_english = F.try_element_at(F.create_map(*(F.lit(x) for pair in names for x in pair)), F.lower(part(english, 1)))
    named = F.coalesce(F.concat(part(hebrew, 2), F.lit("-"), by_hebrew), F.concat(part(english, 2), F.lit("-"), by_english))
    return (
        F.when(t.rlike(iso), day_of(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(month), F.when(part(month, 2).cast("int").between(1, 12), t))
        .when(t.rlike(slash), day_of(part(slash, 3), part(slash, 2), part(slash, 1)))
        .otherwise(named)
    )
