"""Calendars written by the tasks and read back."""

import datetime as dt
import glob
import re

from tidemark.sources import exports

SCHEMA = "id int, name string, start_date string, end_date date, city string, location string, registration_url string, url string, registration_opens date, early_bird_deadline date, cfp_deadline date"
DAY = dt.date(2026, 5, 1)


def read(path):
    """The entries of all files, each a whole calendar, by uid."""
    out = {}
    for name in glob.glob(f"{path}/part-*"):
        data = open(name, "rb").read()
        if not data:
            continue
        lines = data.split(b"\r\n")
        assert lines[-1] == b"" and all(len(x) <= 75 for x in lines)
        text = re.sub("\r\n[ ]", "", data.decode())
        assert text.startswith("BEGIN:VCALENDAR\r\n") and text.endswith("END:VCALENDAR\r\n") and text.count("BEGIN:VCALENDAR") == 1
        for block in re.findall("BEGIN:VEVENT\r\n(.*?)END:VEVENT", text, re.S):
            fields = dict(x.split(":", 1) for x in block.strip().split("\r\n"))
            out[fields.pop("UID")] = fields
    return out


def test_calendar(spark, tmp_path):
    rows = [
        (1, "Optics, Lasers; more\nof it \\ here", "2026-05-01", dt.date(2026, 5, 3), "Berlin", "x", "", "http://a.org/?q=1,2", DAY, None, DAY), (2, "שלום " * 40, "2026-05-01T10:00:00", None, None, None, None, None, None, None, None),
        (3, "no day", None, None, None, None, None, None, DAY, DAY, DAY), (4, None, "2026-12-31", None, "", "Hall", "http://r", "http://u", None, DAY, None), (5, "😀" * 60, "2026-05-01", None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    exports.to_ical(exports.calendar_entries(df), str(tmp_path / "c"))
    got = read(tmp_path / "c")
    assert set(got) == {f"conf-{x}@calendar.invalid" for x in ("1", "1-registration_opens", "1-cfp_deadline", "2", "4", "4-early_bird_deadline", "5")}
    assert got["conf-1@calendar.invalid"] == {
        "SUMMARY": "כנס: Optics\\, Lasers\\; more\\nof it \\\\ here", "DTSTART;VALUE=DATE": "20260501", "DTEND;VALUE=DATE": "20260504", "LOCATION": "Berlin", "URL": "http://a.org/?q=1,2",
    }
    assert got["conf-2@calendar.invalid"]["SUMMARY"] == "כנס: " + "שלום " * 40 and got["conf-5@calendar.invalid"]["SUMMARY"] == "כנס: " + "😀" * 60
    assert got["conf-4@calendar.invalid"]["DTEND;VALUE=DATE"] == "20270101" and got["conf-4@calendar.invalid"]["URL"] == "http://r"
    assert got["conf-4-early_bird_deadline@calendar.invalid"]["LOCATION"] == "Hall" and "URL" not in got["conf-4-early_bird_deadline@calendar.invalid"]
    exports.to_ical(exports.calendar_entries(df.where("false")), str(tmp_path / "none"))
    assert read(tmp_path / "none") == {}
