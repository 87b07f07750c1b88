"""JSON texts of any depth: their strings changed in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string of JSON with the colon that makes it a name of a field, or what stands between strings.
TOKEN = r'"(?:[^"\\]|\\.)*"(?:\s*:)?|[^"]+'


def map_strings(json: Column, change: Callable[[Column], Column]) -> Column:
    """The JSON text with every string in it, at any depth, as `change` gives it; names of fields, numbers, null and all else stay
    as they are written, white space too.

    One pass: strings are cut out, read, changed and written anew, and the pieces are put together; nothing is parsed as a
    whole, so depth and mixed arrays cost nothing. A string that `change` makes null becomes null. A null text stays null; what is
    no JSON is changed only where it has strings between quotes.
    """
    read = lambda s: F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0))

    def write(s: Column) -> Column:
        told = F.to_json(F.array(s))
        return F.when(s.isNull(), F.lit("null")).otherwise(F.substring(told, F.lit(2), F.length(told) - 2))

    def piece(p: Column) -> Column:
        leaf = F.startswith(p, F.lit('"')) & F.endswith(p, F.lit('"')) & (F.length(p) >= 2)
        return F.when(leaf, F.coalesce(write(change(read(p))), p)).otherwise(p)

    return F.when(json.isNotNull(), F.array_join(F.transform(F.regexp_extract_all(json, F.lit(TOKEN), 0), piece), ""))


def strings(json: Column) -> Column:
    """All strings of a JSON text that are no names of fields, in order."""
    found = F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(TOKEN), 0)
    leaves = F.filter(found, lambda p: F.startswith(p, F.lit('"')) & F.endswith(p, F.lit('"')) & (F.length(p) >= 2))
    return F.transform(leaves, lambda s: F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0)))
