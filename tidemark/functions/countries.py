"""Countries: codes of free-text names, and the codes of names that a text mentions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "other"
# Names and short forms in lower case by code.
NAMES = {
    "US": ("us", "usa", "u.s", "u.s.a", "united states", "united states of america", 'ארה"ב', "ארצות הברית"),
    "IL": ("israel", "ישראל", "il"), "GB": ("uk", "u.k", "united kingdom", "great britain", "gb", "britain", "בריטניה"),
    "EU": ("eu", "european union"), "NATO": ("nato",), "UN": ("un", "united nations"),
    "DE": ("germany", "deutschland", "de", "גרמניה"), "FR": ("france", "fr", "צרפת"), "IT": ("italy", "it", "איטליה"),
    "TR": ("turkey", "türkiye", "turkiye", "tr", "טורקיה", "תורכיה"), "KR": ("south korea", "korea, south", "republic of korea", "kr", "דרום קוריאה"),
    "KP": ("north korea", "kp", "צפון קוריאה"), "JP": ("japan", "jp", "יפן"), "CN": ("china", "prc", "cn", "סין"), "IN": ("india", "in", "הודו"),
    "RU": ("russia", "russian federation", "ru", "רוסיה"), "UA": ("ukraine", "ua", "אוקראינה"), "PL": ("poland", "pl", "פולין"), "ES": ("spain", "es", "ספרד"),
    "NL": ("netherlands", "holland", "nl", "הולנד"), "SE": ("sweden", "se", "שוודיה"), "NO": ("norway", "no", "נורווגיה"), "FI": ("finland", "fi", "פינלנד"),
    "CA": ("canada", "ca", "קנדה"), "AU": ("australia", "au", "אוסטרליה"), "SA": ("saudi arabia", "sa", "ערב הסעודית"),
    "AE": ("uae", "united arab emirates", "ae", "איחוד האמירויות"), "SG": ("singapore", "sg", "סינגפור"), "TW": ("taiwan", "tw", "טייוואן"),
    "BR": ("brazil", "br", "ברזיל"), "GR": ("greece", "gr", "יוון"),
}


def _codes() -> Column:
    return F.create_map(*(F.lit(x) for code, names in NAMES.items() for name in names for x in (name, code)))


def code(raw: Column) -> Column:
    """The code of a name in any case; two letters that are no known name stand for themselves, all else is `other`; never null."""
    key = F.regexp_replace(F.lower(F.trim(raw)), r"\.+$", "")
    return F.coalesce(F.try_element_at(_codes(), key), F.when(key.rlike("^[a-z]{2}$"), F.upper(key)), F.lit(OTHER))


def mentions(text: Column) -> Column:
    """The different codes of the names of three letters or more in a text, in order of their first places: one scan."""
    names = sorted((n for some in NAMES.values() for n in some if len(n) >= 3), key=lambda n: (-len(n), n))
    escaped = "|".join(n.replace(".", r"\.") for n in names)
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?U)(?<!\w)({escaped})(?!\w)"), 1)
    return F.array_distinct(F.transform(found, lambda n: F.try_element_at(_codes(), n)))
