from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from gazette import schemas
from gazette.functions.keys import calendar_uid
from gazette.sources import html_calendars
from gazette.sources.config import DESTATIS_TOPICS, local_frame
from gazette.sources.ics import unescape
from gazette.sources.months import month_pages
from gazette.sources.registry import collect, collect_market

AS_OF = dt.datetime(2026, 8, 1, 7)

ICS = "\r\n".join([
    "BEGIN:VCALENDAR", "BEGIN:VEVENT", "DTSTART;TZID=Europe/Rome:20260814T100000", "SUMMARY:Prices\\, final and a lon",
    " g title", "DESCRIPTION:Reference period: July 2026\\, more", "URL:https://it.example/1", "BEGIN:VALARM",
    "DESCRIPTION:alarm", "TRIGGER:-PT5M", "END:VALARM", "END:VEVENT",
    "BEGIN:VEVENT", "DTSTART;VALUE=DATE:20261214", "SUMMARY:Date only", "DESCRIPTION:Periodo di riferimento: giugno 2026", "END:VEVENT",
    "BEGIN:VEVENT", "DTSTART:20260814T100000Z", "SUMMARY:Zulu", "DESCRIPTION:Reference period: July\\nOther", "END:VEVENT",
    "BEGIN:VEVENT", "DTSTART;TZID=Nowhere/Land:20260814T100000", "SUMMARY:Odd zone", "END:VEVENT",
    "BEGIN:VEVENT", "SUMMARY:No start", "END:VEVENT", "BEGIN:VEVENT", "DTSTART:20260814T100000", "SUMMARY:", "END:VEVENT",
    "END:VCALENDAR",
])
EVENT = """<div class="row c-result--event-preview x"><h3 class="c-result__heading"> Consumer <b>prices</b>12</h3>
<div class="c-result-meta__item"> <strong>Reporting period:</strong> July 2026</div>
<div class="c-result-meta__item"><strong>Date of issue:</strong> 2026.08.14 <a>ICS/iCal</a></div></div>"""
EVENTS = f"""<html><body>{EVENT}{EVENT}
<div class="c-result--event-preview"><h3 class="c-result__heading">No date</h3></div>
<div class="c-result--event-preview"><div class="c-result-meta__item">Date of issue: 2026.08.15</div></div></body></html>"""
EMBARGO = """<table><tr><th>Titre</th><th>Date</th></tr>
<tr><td>INDICATEURS CONJONCTURELS Indice des prix</td><td>14 août&nbsp;à 8h45</td></tr>
<tr><td><p>Emploi salarié 3 décembre à 12h</p></td></tr>
<tr><td>Climat des affaires</td><td>2 janvier à 8h45</td></tr>
<tr><td>Bad month</td><td>2 brumaire à 8h45</td></tr><tr><td>Bad day here</td><td>31 novembre à 8h45</td></tr>
<tr><td>IPC</td><td>14 août à 8h45</td></tr></table>"""
COLLECTION = """{"link": {"item": [
 {"label": " CPM01 Prices ", "updated": "2026-07-20T11:00:00Z", "href": "https://cso.example/CPM01"},
 {"label": "CPM01 Prices", "updated": "2026-07-20T11:00:00Z", "href": "https://cso.example/again"},
 {"label": "Relative", "updated": "2026-07-21T11:00:00Z", "href": "/x"}, {"label": "", "updated": "2026-07-20T11:00:00Z"},
 {"label": "Bad stamp", "updated": "yesterday"}, {"label": "Old", "updated": "2026-05-01T11:00:00Z"}]}}"""


def market_row(day="", time="", currency="EUR", icon="icon--ff-impact-red", event="CPI", actual="", forecast="", previous=""):
    span = f'<span class="icon {icon}"></span>' if icon else ""
    return (f'<tr class="calendar__row"><td class="calendar__cell calendar__date">{day}</td><td class="calendar__cell calendar__time">{time}</td>'
            f'<td class="calendar__cell calendar__currency">{currency}</td><td class="calendar__cell calendar__impact">{span}</td>'
            f'<td class="calendar__cell calendar__event"><span>{event}</span></td><td class="calendar__cell calendar__actual">{actual}</td>'
            f'<td class="calendar__cell calendar__forecast">{forecast}</td><td class="calendar__cell calendar__previous">{previous}</td></tr>')


MARKET = '<table class="calendar__table">' + "".join([
    market_row(event="Before any date"),
    market_row("<span>Fri <span>Aug 14</span></span>", "8:00am", actual="0.3%", forecast=" 0.2% ", previous="&nbsp;"),
    market_row(time="9:30am", currency="USD", event="Not ours"),
    market_row(time="Tentative", icon="icon--ff-impact-ora icon--ff-impact-zzz", event="ECB &amp; rate"),
    market_row("Sat <span>Aug 15</span>", "All Day", icon="", event="Holiday"),
    market_row(time="13:00pm", event="Bad time"), "<tr><td>no cells</td></tr>",
]) + "</table>"


def landing(spark, *bodies):
    rows = [(source, facet, AS_OF, 1, body) for source, facet, body in bodies]
    return local_frame(spark, rows, schemas.LANDING_CALENDAR)


def test_office_calendars(spark):
    bodies = [
        ("istat", "", ICS), ("destatis", DESTATIS_TOPICS[1], EVENT.replace("July", "June")), ("destatis", DESTATIS_TOPICS[0], EVENTS),
        ("insee", "", EMBARGO), ("cso", "", COLLECTION), ("cso", "", "not json"),
    ]
    rows = collect(landing(spark, *bodies), AS_OF).collect()
    good = {row.title: row for row in rows if row.fault is None}
    faults = sorted((row.source, row.fault) for row in rows if row.fault)

    assert good["Prices, final and a long title"].release_dt == dt.datetime(2026, 8, 14, 8)
    assert good["Prices, final and a long title"].reference_period == "July 2026"
    assert good["Prices, final and a long title"].url == "https://it.example/1"
    assert good["Date only"].release_dt == dt.datetime(2026, 12, 14, 9)
    assert good["Date only"].reference_period == "giugno 2026"
    assert good["Zulu"].release_dt == dt.datetime(2026, 8, 14, 10) and good["Zulu"].reference_period is None
    assert good["Odd zone"].release_dt == dt.datetime(2026, 8, 14, 8)

    assert good["Consumerprices"].release_dt == dt.datetime(2026, 8, 14, 6)
    assert good["Consumerprices"].reference_period == "July 2026"
    assert [row.title for row in rows if row.source == "destatis" and row.fault is None] == ["Consumerprices"]

    assert good["Indice des prix"].release_dt == dt.datetime(2026, 8, 14, 6, 45)
    assert good["Emploi salarié"].release_dt == dt.datetime(2026, 12, 3, 11)
    assert good["Climat des affaires"].release_dt == dt.datetime(2027, 1, 2, 7, 45)

    assert good["CPM01 Prices"].url == "https://cso.example/CPM01" and good["Relative"].url is None
    assert "Old" not in good
    row = good["CPM01 Prices"]
    assert row.source_uid == hashlib.sha256(b"cso|CPM01 Prices|2026-07-20T11:00:00+00:00").hexdigest()
    assert faults == sorted([
        ("istat", "no_start"), ("istat", "no_title"), ("destatis", "no_start"), ("destatis", "no_title"),
        ("insee", "no_start"), ("insee", "unknown_month"), ("insee", "bad_date"), ("insee", "short_title"),
        ("cso", "no_title"), ("cso", "bad_date"), ("cso", "body_not_parsed"),
    ])


def test_market_pages(spark):
    pages = landing(spark, ("forexfactory", "aug.2026", MARKET), ("forexfactory", "jan.2020", MARKET))
    rows = sorted(collect_market(pages, month_pages(spark, AS_OF.date())).collect(), key=lambda row: row.item_pos)
    assert [(row.title, row.release_dt, row.impact, row.fault) for row in rows] == [
        ("Before any date", None, "high", "no_start"),
        ("CPI", dt.datetime(2026, 8, 14, 12), "high", None),
        ("ECB & rate", dt.datetime(2026, 8, 14, 4), "medium", None),
        ("Holiday", dt.datetime(2026, 8, 15, 4), "low", None),
        ("Bad time", None, "high", "bad_date"),
    ]
    assert (rows[1].actual, rows[1].forecast, rows[1].previous, rows[1].release_dt_orig) == ("0.3%", "0.2%", None, "8:00am")
    assert all(row.currency == "EUR" for row in rows)


def test_calendar_uid(spark):
    frame = local_frame(spark, [("a", "t", dt.datetime(2026, 8, 14, 10, 0, 0, 5)), ("a", None, AS_OF)],
                        schemas.struct("s string, t string, d timestamp"))
    first, second = [row.u for row in frame.select(calendar_uid(F.col("s"), F.col("t"), F.col("d")).alias("u")).collect()]
    assert first == hashlib.sha256(b"a|t|2026-08-14T10:00:00.000005+00:00").hexdigest() and second is None


def test_bodies_are_split_once(spark):
    """The pieces were counted by a second split, which found the table and all its tags again."""
    text = html_calendars._after_tags("html", html_calendars.CELL_TAG, html_calendars.CELL_END)
    assert text.count("html") == 1
    rows = spark.createDataFrame([("a<td>1</td>x<TH b>2</th><td>3",), ("no tags",), ("",), (None,)], "html string").selectExpr(f"{text} AS cells")
    assert [row.cells for row in rows.collect()] == [["1", "2", "3"], [], [], None]


def test_escapes_are_undone_from_left_to_right(spark):
    values = ["a\\, b\\; c\\nd\\Ne", "\\\\n \\\\\\n \\\\, \\x \\", "\\\\\\\\N\\,\\n", "plain", None]
    rows = spark.createDataFrame([(one,) for one in values], "v string").select(unescape(F.col("v")).alias("v"))
    assert [row.v for row in rows.collect()] == ["a, b; c\nd\ne", "\\n \\\n \\, \\x \\", "\\\\N,\n", "plain", None]
