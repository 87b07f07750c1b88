"""Addresses: identity, host, dates in paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = "utm_[^=&]*|fbclid|gclid|gclsrc|mc_cid|mc_eid|igshid|ref|ref_src|spm|yclid|msclkid"


def identity(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, no slash at the path's end."""
    bare = F.regexp_replace(url, "#.*$", "")
    head, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    site, path = F.lower(F.regexp_extract(head, "^([^/]*//[^/]*)", 1)), F.regexp_replace(F.regexp_extract(head, "^[^/]*//[^/]*(/.*)?$", 1), "/+$", "")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^(?:{TRACKING})(?:=|$)")), "&")
    return F.concat(site, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def registrable_host(url: Column) -> Column:
    """Host without user, port and a leading www."""
    host = F.regexp_extract(F.lower(url), r"^[^/]*//(?:[^/@]*@)?([^/:?#]*)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def date_in_path(url: Column, last_year: int) -> Column:
    """A date told by the path: /Y/M/D, Y-M-D, YYYYMMDD, or /Y/M for its first day; null if it is none."""
    path = F.regexp_extract(url, r"^[^/]*//[^/]*([^?#]*)", 1)
    made = None
    for pattern in (r"/((?:19|20)\d\d)/(\d{1,2})/(\d{1,2})(?:/|$)", r"(?:^|[^0-9])((?:19|20)\d\d)-(\d\d)-(\d\d)(?:[^0-9]|$)", r"(?:^|[^0-9])((?:19|20)\d\d)(\d\d)(\d\d)(?:[^0-9]|$)", r"/((?:19|20)\d\d)/(\d\d)(?:[/-]|$)()"):
        part = lambda i, p=pattern: F.regexp_extract(path, p, i)
        day = F.when(part(3) == "", "1").otherwise(part(3))
        found = F.when(part(1) != "", F.try_to_timestamp(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))
        found = F.when(F.year(found).between(1990, last_year), found)
        made = found if made is None else F.coalesce(made, found)
    return made
