"""Tables as files for people: flat CSV, calendars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cell(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.array_join(column.cast("array<string>"), "; ")
    return F.to_json(column) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else column


def flat(df: DataFrame) -> DataFrame:
    """df in plain columns: a struct's fields as column_field, arrays of plain values joined by `; ` without nulls, all else nested as JSON."""
    columns = []
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            columns += [_cell(F.col(f.name)[g.name], g.dataType).alias(f"{f.name}_{g.name}") for g in f.dataType]
        else:
            columns.append(_cell(F.col(f.name), f.dataType).alias(f.name))
    return df.select(*columns)


def to_csv(df: DataFrame, path: str) -> None:
    """Writes df, made flat, with a header; quotes within quotes are doubled. The tasks write; the folder is replaced."""
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# Days of a conference that get an entry of their own, and what it is called.
REMINDERS = {"registration_opens": "פתיחת הרשמה", "early_bird_deadline": "מועד אחרון Early Bird", "cfp_deadline": "מועד אחרון Call for Papers"}
CONFERENCE = "כנס: "
#: Bytes of a line of a calendar.
LINE_BYTES = 75


def calendar_entries(conferences: DataFrame, domain: str = "calendar.invalid") -> DataFrame:
    """(uid, summary, start, end, location, url): an entry for each conference with a first day, and one for each of its reminders.

    conferences: id, name, start_date, end_date, city, location, registration_url, url and the days of REMINDERS. The last day is the
    first where there is none; ends are the day after. A conference without a first day has no entry, nor have its reminders.
    """
    name, place = F.coalesce("name", F.lit("")), F.coalesce(F.nullif("city", F.lit("")), F.nullif("location", F.lit("")))
    uid = F.concat(F.lit("conf-"), F.col("id").cast("string"))
    first = F.to_date("start_date")
    entry = lambda u, summary, start, end, url: F.struct(F.concat(u, F.lit(f"@{domain}")).alias("uid"), summary.alias("summary"), start.alias("start"), F.date_add(end, 1).alias("end"), place.alias("location"), url.alias("url"))
    main = entry(uid, F.concat(F.lit(CONFERENCE), name), first, F.coalesce(F.to_date("end_date"), first), F.coalesce(F.nullif("registration_url", F.lit("")), F.nullif("url", F.lit(""))))
    due = [
        F.when(F.col(c).isNotNull(), entry(F.concat(uid, F.lit(f"-{c}")), F.concat(F.lit(CONFERENCE), name, F.lit(f" — {label}")), F.to_date(c), F.to_date(c), F.lit(None).cast("string")))
        for c, label in REMINDERS.items()
    ]
    return conferences.where(first.isNotNull()).select(F.explode(F.array_compact(F.array(main, *due))).alias("e")).select("e.*")


def folded(line: str, most: int = LINE_BYTES) -> list[str]:
    """A line as lines of at most `most` bytes of UTF-8, all but the first with a blank in front; no character is cut."""
    out, now, size = [], "", 0
    for c in line:
        n = len(c.encode())
        if size + n > most:
            out.append(now)
            now, size = " ", 1
        now, size = now + c, size + n
    return [*out, now]


def to_ical(entries: DataFrame, path: str, product: str = "-//tidemark//calendar//") -> None:
    """Writes entries (see calendar_entries) as calendars, one for each task's file; the folder is replaced. Nothing comes to the driver."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), r"([\\;,])", r"\\$1"), r"\r\n|\r|\n", r"\\n")
    line = lambda name, value: F.concat(F.lit(f"{name}:"), value)
    day = lambda c: F.date_format(c, "yyyyMMdd")
    lines = F.array_compact(F.array(
        F.lit("BEGIN:VEVENT"), line("UID", escaped("uid")), line("SUMMARY", escaped("summary")), line("DTSTART;VALUE=DATE", day("start")), line("DTEND;VALUE=DATE", day("end")),
        line("LOCATION", escaped("location")), line("URL", F.col("url")), F.lit("END:VEVENT"),
    ))

    def calendar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = False
        for batch in batches:
            out = [] if told else ["BEGIN:VCALENDAR", f"PRODID:{product}", "VERSION:2.0", "CALSCALE:GREGORIAN"]
            told = told or batch.num_rows > 0
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"value": out + [x for some in batch.column(0).to_pylist() for line in some for x in folded(line)]})
        if told:
            yield pa.RecordBatch.from_pydict({"value": ["END:VCALENDAR"]})

    entries.select(lines.alias("lines")).mapInArrow(calendar, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)
