"""Text put into rows by their ids, so that a rule's branches all have rows; the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def planted(text: str, by: str, phrases: tuple[str, ...]) -> Column:
    """The text (null: empty) and behind it the phrase of the row's number."""
    return F.concat(F.coalesce(F.col(text), F.lit("")), F.element_at(F.array(*map(F.lit, phrases)), (F.col(by) % len(phrases)).cast("int") + 1))


def planted_sql(text: str, by: str, phrases: tuple[str, ...]) -> str:
    return f"(coalesce({text}, '') || [{', '.join(map(quoted, phrases))}][{by} % {len(phrases)} + 1])"
