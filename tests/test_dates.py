from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gazette import schemas
from gazette.functions import dates
from gazette.functions.text import decode_entities
from gazette.sources import months
from gazette.sources.config import local_frame


def evaluate(spark, expression, rows, fields):
    """Values of an expression over rows, in order, with one job."""
    frame = local_frame(spark, [(i, *row) for i, row in enumerate(rows)], schemas.struct(f"i int, {fields}"))
    return [row.v for row in frame.selectExpr("i", f"{expression} AS v").orderBy("i").collect()]


def at(*parts):
    return dt.datetime(*parts)


def test_market_dates(spark):
    cases = [
        (("Aug 14", "8:00am", 2026), at(2026, 8, 14, 12)), (("Aug 14", "4:00pm", 2026), at(2026, 8, 14, 20)),
        (("Aug 14", "Tentative", 2026), at(2026, 8, 14, 4)), (("Aug 14", "All Day", 2026), at(2026, 8, 14, 4)),
        (("Aug 14", None, 2026), at(2026, 8, 14, 4)), (("Aug 14", "12:00am", 2026), at(2026, 8, 14, 4)),
        (("Aug 14", "12:00pm", 2026), at(2026, 8, 14, 16)), (("Jan 15", "8:00am", 2027), at(2027, 1, 15, 13)),
        (("Aug 14", "13:00pm", 2026), None), (("Feb 30", "8:00am", 2026), None), (("Foo 2", "", 2026), at(2026, 1, 2, 5)),
        ((None, "8:00am", 2026), None),
    ]
    got = evaluate(spark, dates.market_date_to_utc("d", "t", "y"), [case for case, _ in cases], "d string, t string, y int")
    assert got == [want for _, want in cases]


def test_dotted_dates(spark):
    got = evaluate(spark, dates.dotted_date_to_utc("d"), [("2026.08.14",), ("2026.12.18 (deadline)",), ("2026.02.30",), ("x",)], "d string")
    assert got == [at(2026, 8, 14, 6), at(2026, 12, 18, 7), None, None]


def test_french_dates(spark):
    rows = [("IPC 14 août à 8h45",), ("x 3 DÉCEMBRE à 12h",), ("x 2 janvier à 8h45",), ("x 14 brumaire à 8h",), ("x 31 novembre à 8h",)]
    got = evaluate(spark, dates.french_date_to_utc("d", dates.french_month("d"), dt.date(2026, 8, 1)), rows, "d string")
    assert got == [at(2026, 8, 14, 6, 45), at(2026, 12, 3, 11), at(2027, 1, 2, 7, 45), None, None]


def test_ics_starts(spark):
    rows = [
        ("20260814T100000", "Europe/Rome", "Europe/Madrid", 9), ("20260814T100000", None, "Europe/Madrid", 9),
        ("20260814T100000Z", None, "Europe/Madrid", 9), ("20261214", None, "Europe/Madrid", 9),
        ("20260329T023000", "Europe/Rome", "UTC", 9), ("20261025T023000", "Europe/Rome", "UTC", 9), ("2026", None, "UTC", 9),
    ]
    got = evaluate(spark, dates.ics_start_to_utc("v", "z", "s", "h"), rows, "v string, z string, s string, h int")
    assert got == [
        at(2026, 8, 14, 8), at(2026, 8, 14, 8), at(2026, 8, 14, 10), at(2026, 12, 14, 8),
        at(2026, 3, 29, 1, 30), at(2026, 10, 25, 0, 30), None,
    ]


def test_iso_dates(spark):
    cases = [
        ("2026-08-14T11:00:00Z", at(2026, 8, 14, 11)), ("2026-08-14T11:00:00.25+01:00", at(2026, 8, 14, 10, 0, 0, 250000)),
        ("2026-08-14", at(2026, 8, 14)), ("20260814T110000", at(2026, 8, 14, 11)), ("2026-13-01", None), ("soon", None),
        ("2026-08-14T11:00-0530", at(2026, 8, 14, 16, 30)),
    ]
    got = evaluate(spark, dates.parse_iso_date("d", keep_fraction=True), [(text,) for text, _ in cases], "d string")
    assert got == [want for _, want in cases]


def test_title_dates(spark):
    cases = [
        ("IPC 21 Julio 26", at(2026, 7, 21)), ("3 mai 2025", at(2025, 5, 3)), ("31 febrero 26", None),
        ("7 MÄRZ. 2026", at(2026, 3, 7)), ("1 january 2026 and 2 enero 2025", at(2025, 1, 2)),
        ("30 febrero 26, 4 march 2026", at(2026, 3, 4)), ("5 août2026", at(2026, 8, 5)), ("no date", None),
        ("1 enero 99 2 enero 98", at(2099, 1, 1)), ("3&nbsp;mayo&nbsp;2026", at(2026, 5, 3)),
    ]
    frame = local_frame(spark, [(i, text) for i, (text, _) in enumerate(cases)], schemas.struct("i int, title string"))
    frame = frame.withColumn("published", F.lit(None).cast("timestamp"))
    got = [row.published for row in dates.with_title_date(decode_entities(frame, "title"), "title", "published").orderBy("i").collect()]
    assert got == [want for _, want in cases]


def test_month_lists(spark):
    def facets(as_of, backfill=False):
        return [row.facet for row in months.month_pages(spark, as_of, backfill).orderBy("month").collect()]

    assert facets(dt.date(2026, 12, 31)) == ["nov.2026", "dec.2026", "jan.2027", "feb.2027", "mar.2027"]
    assert facets(dt.date(2026, 8, 2), backfill=True) == [f"{month}.2026" for month in ("jun", "jul", "aug", "sep", "oct", "nov")]
    assert facets(dt.date(2027, 1, 2), backfill=True)[0] == "jun.2026" and len(facets(dt.date(2027, 1, 2), backfill=True)) == 11
    assert facets(dt.date(2026, 1, 2), backfill=True) == facets(dt.date(2026, 1, 2))
