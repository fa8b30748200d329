"""Stamps out of feed, title and calendar text, as SQL expressions.

Functions take and return SQL text over column names. Local wall-clock times become UTC through ``convert_timezone``,
which takes the zone per row. Impossible dates give null, so the caller can quarantine the row.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from dateutil import parser as dateparser
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.sqltext import group, lookup, number, raw
from gazette.functions.text import SPACE

# Month names by language, January first.
MONTHS = {
    "es": ["enero", "febrero", "marzo", "abril", "mayo", "junio",
           "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"],
    "de": ["januar", "februar", "märz", "april", "mai", "juni",
           "juli", "august", "september", "oktober", "november", "dezember"],
    "it": ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno",
           "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"],
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin",
           "juillet", "août", "septembre", "octobre", "novembre", "décembre"],
    "en": ["january", "february", "march", "april", "may", "june",
           "july", "august", "september", "october", "november", "december"],
}
SHORT_MONTHS = {
    "Jan": 1, "Feb": 2, "Mar": 3, "Apr": 4, "May": 5, "Jun": 6,
    "Jul": 7, "Aug": 8, "Sep": 9, "Oct": 10, "Nov": 11, "Dec": 12,
}
# Hours east of UTC for the zone names that mail dates use.
MAIL_ZONES = {
    "ut": 0, "utc": 0, "gmt": 0, "z": 0, "ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5,
    "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "met": 1, "mest": 2, "cet": 1, "cest": 2,
}

MAIL_DATE = (
    r"(?i)^\s*(?:[a-z]+\.?,?\s+)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*\.?[\s-]+(\d{4}|\d{2})"
    r"(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([+-]\d{2}:?\d{2}|[a-z]+)?)?(?:\s*\(.*\))?\s*$"
)
ISO_DATE = (
    r"(?i)^\s*(\d{4})(?:-?(\d{2})(?:-?(\d{2}))?)?"
    r"(?:[t ]\s*(\d{2}):?(\d{2})(?::?(\d{2})([.,]\d+)?)?\s*(z|[+-]\d{2}(?::?\d{2})?)?)?\s*$"
)


def as_utc(naive: str, minutes_east: str = "0") -> str:
    """A wall clock so many minutes east of UTC as an instant."""
    return f"CAST({naive} - make_dt_interval(0, 0, {minutes_east}) AS TIMESTAMP)"


def zoned_to_utc(naive: str, tz: str) -> str:
    """Wall clock in ``tz`` to an instant; the earlier reading of a repeated hour."""
    return f"CAST(convert_timezone({tz}, 'UTC', {naive}) AS TIMESTAMP)"


def wall_clock(year: str, month: str, day: str, hour: str = "0", minute: str = "0", second: str = "0") -> str:
    return f"try_make_timestamp_ntz({year}, {month}, {day}, {hour}, {minute}, {second})"


def offset_minutes(zone: str) -> str:
    """Offset text (``+0200``, ``-05:30``, ``+02``) to minutes east; null for anything else."""
    digits = f"translate({zone}, ':', '')"
    minutes = f"try_cast(substr({digits}, 2, 2) AS INT) * 60 + coalesce(try_cast(substr({digits}, 4, 2) AS INT), 0)"
    return f"CASE left({zone}, 1) WHEN '+' THEN {minutes} WHEN '-' THEN -({minutes}) END"


def parse_mail_date(text: str) -> str:
    """``Mon, 30 Jun 2025 10:00:00 +0200`` and its short forms; two-digit years below 90 are in this century."""
    digits = number(text, MAIL_DATE, 3)
    year = f"CASE WHEN {digits} < 90 THEN {digits} + 2000 WHEN {digits} < 100 THEN {digits} + 1900 ELSE {digits} END"
    month = lookup(SHORT_MONTHS, f"initcap({group(text, MAIL_DATE, 2)})")
    zone = f"lower({group(text, MAIL_DATE, 7)})"
    east = f"coalesce({offset_minutes(zone)}, {lookup(MAIL_ZONES, zone)} * 60, 0)"
    hour, minute, second = (number(text, MAIL_DATE, i, 0) for i in (4, 5, 6))
    return as_utc(wall_clock(year, month, number(text, MAIL_DATE, 1), hour, minute, second), east)


def parse_iso_date(text: str, keep_fraction: bool = False) -> str:
    """ISO date or date-time, basic or extended; no zone means UTC."""
    zone = group(text, ISO_DATE, 8)
    second = number(text, ISO_DATE, 6, 0)
    if keep_fraction:
        fraction = f"translate({group(text, ISO_DATE, 7)}, ',', '.')"
        second = f"{second} + coalesce(try_cast('0' || {fraction} AS DECIMAL(8, 6)), 0)"
    month, day = (number(text, ISO_DATE, i, 1) for i in (2, 3))
    hour, minute = (number(text, ISO_DATE, i, 0) for i in (4, 5))
    naive = wall_clock(number(text, ISO_DATE, 1), month, day, hour, minute, second)
    return as_utc(naive, f"coalesce({offset_minutes(zone)}, 0)")


@F.pandas_udf(T.StringType())
def _free_date(first: pd.Series, second: pd.Series, third: pd.Series, day: pd.Series) -> pd.Series:
    """First of three texts that reads as a date; missing parts come from ``day``, no zone means UTC."""

    def read(texts, default):
        for text in texts:
            if not text:
                continue
            try:
                stamp = dateparser.parse(text, default=default)
                stamp = stamp.replace(tzinfo=dt.UTC) if stamp.tzinfo is None else stamp.astimezone(dt.UTC)
            except (ValueError, OverflowError):
                continue
            return stamp.strftime("%Y-%m-%d %H:%M:%S.%f")
        return None

    return pd.Series([
        read(texts, dt.datetime.fromisoformat(default)) if default else None
        for *texts, default in zip(first, second, third, day)
    ], dtype=object)


def with_publication_stamp(rows: DataFrame, published: str, updated: str, created: str, day: str, name: str) -> DataFrame:
    """Add a stamp: standard formats of the first two fields, then free text of all three where that gave nothing.

    Separate projections, so that each parse is planned and run once. ``day`` fills what free text leaves open.
    """
    formats = ", ".join(parse(field) for field in (published, updated) for parse in (parse_mail_date, parse_iso_date))
    some = f"coalesce(nullif({published}, ''), nullif({updated}, ''), nullif({created}, ''))"
    standard = rows.selectExpr("*", f"coalesce({formats}) AS {name}")
    marked = standard.selectExpr(
        "*", f"CASE WHEN {name} IS NULL AND {some} IS NOT NULL THEN date_format({day}, 'yyyy-MM-dd') END AS _day"
    )
    texts = [F.expr(f"CASE WHEN _day IS NOT NULL THEN {field} END") for field in (published, updated, created)]
    free = marked.withColumn("_free", _free_date(*texts, F.col("_day")))
    kept = [column for column in rows.columns if column != name]
    return free.selectExpr(*[f"`{column}`" for column in kept], f"coalesce({name}, try_cast(_free AS TIMESTAMP)) AS {name}")


def _title_months() -> dict[str, tuple[int, int]]:
    """Name to (search rank, month number); a name two languages share keeps its first rank."""
    ranked: dict[str, tuple[int, int]] = {}
    for names in MONTHS.values():
        for month, name in enumerate(names, 1):
            ranked.setdefault(name, (len(ranked), month))
    return ranked


TITLE_MONTHS = _title_months()
# The look-ahead leaves the year free to be the day of an overlapping next hit.
TITLE_DATE = rf"(?iu)([0-9]{{1,2}}){SPACE}*({'|'.join(TITLE_MONTHS)})\.?{SPACE}*(?=([0-9]{{2,4}}))"


def title_date_hits(title: str) -> str:
    """All day-month-year hits of a decoded title as an array of (rank, pos, stamp)."""
    day, name, year = (f"regexp_extract_all({title}, {raw(TITLE_DATE)}, {i})" for i in (1, 2, 3))
    month = lookup({name: month for name, (_, month) in TITLE_MONTHS.items()}, "lower(hit.name)")
    rank = lookup({name: rank for name, (rank, _) in TITLE_MONTHS.items()}, "lower(hit.name)")
    full_year = "try_cast(hit.year AS INT) + if(try_cast(hit.year AS INT) < 100, 2000, 0)"
    stamp = wall_clock(full_year, month, "try_cast(hit.day AS INT)")
    hits = f"zip_with({day}, zip_with({name}, {year}, (n, y) -> struct(n AS name, y AS year)), (d, ny) -> " \
        "struct(d AS day, ny.name AS name, ny.year AS year))"
    return f"transform({hits}, (hit, pos) -> struct({rank} AS rank, pos AS pos, {stamp} AS stamp))"


def best_title_date(hits: str) -> str:
    """The first hit of each month name counts; the lowest rank whose date exists wins.

    Keep it in a projection after :func:`title_date_hits`, so the hits are computed once.
    """
    firsts = f"filter({hits}, h -> NOT exists({hits}, o -> o.rank = h.rank AND o.pos < h.pos) AND h.stamp IS NOT NULL)"
    return f"CAST(array_min({firsts}).stamp AS TIMESTAMP)"


def with_title_date(rows: DataFrame, title: str, name: str) -> DataFrame:
    """Fill ``name`` from a date inside ``title``, entities already decoded, on the rows where it is null."""
    undated = rows.selectExpr("*", f"CASE WHEN {name} IS NULL THEN {title} END AS _undated")
    hits = undated.selectExpr("*", f"{title_date_hits('_undated')} AS _hits")
    return hits.selectExpr(
        *[f"`{column}`" for column in rows.columns if column != name], f"coalesce({name}, {best_title_date('_hits')}) AS {name}"
    )


ICS_STAMP = r"^\d{8}(?:T\d{4}(?:\d{2})?Z?)?$"


def ics_start_to_utc(value: str, tzid: str, source_tz: str, default_hour: str) -> str:
    """ICS start: UTC when it ends in Z, else its own zone, else the source's zone; a bare date gets the default hour."""
    def digits(start: int, length: int = 2, default: str = "NULL") -> str:
        return f"coalesce(try_cast(substr({value}, {start}, {length}) AS INT), {default})"

    timed = f"substr({value}, 9, 1) = 'T'"
    hour = f"if({timed}, {digits(10)}, {default_hour})"
    naive = wall_clock(digits(1, 4), digits(5), digits(7), hour, digits(12, default="0"), digits(14, default="0"))
    zone = f"CASE WHEN {value} LIKE '%Z' THEN 'UTC' WHEN {timed} THEN coalesce({tzid}, {source_tz}) ELSE {source_tz} END"
    return f"if({value} RLIKE {raw(ICS_STAMP)}, {zoned_to_utc(naive, zone)}, NULL)"


DOTTED_DATE = r"(\d{4})\.(\d{2})\.(\d{2})"


def dotted_date_to_utc(text: str, tz: str = "Europe/Berlin", hour: int = 8) -> str:
    """``2026.08.14 (…)`` at a fixed local hour."""
    return zoned_to_utc(wall_clock(*(number(text, DOTTED_DATE, i) for i in (1, 2, 3)), str(hour)), f"'{tz}'")


DAY_AND_MONTH = rf"(\d{{1,2}}){SPACE}+(\p{{L}}+){SPACE}+à{SPACE}+"
FRENCH_DATE = rf"(?iu){DAY_AND_MONTH}(\d+)h(\d{{0,2}})"


def french_month(text: str) -> str:
    names = {name: month for month, name in enumerate(MONTHS["fr"], 1)}
    return lookup(names, f"lower({group(text, FRENCH_DATE, 2)})")


def french_date_to_utc(text: str, month: str, as_of: dt.date, tz: str = "Europe/Paris") -> str:
    """``14 août à 8h45`` and its month: no year in the text, so a month before the current one means next year."""
    year = f"if({month} < {as_of.month}, {as_of.year + 1}, {as_of.year})"
    hour, minute = number(text, FRENCH_DATE, 3), number(text, FRENCH_DATE, 4, 0)
    return zoned_to_utc(wall_clock(year, month, number(text, FRENCH_DATE, 1), hour, minute), f"'{tz}'")


SHORT_DATE = r"([A-Z][a-z]{2})\s+(\d+)"
CLOCK = r"(?i)^(\d+):(\d+)\s*(am|pm)"


def market_date_to_utc(day_text: str, time_text: str, year: str, tz: str = "America/New_York") -> str:
    """``Aug 14`` and ``8:00am`` in New York; any other time text is midnight, an unknown month name is January."""
    month = f"coalesce({lookup(SHORT_MONTHS, group(day_text, SHORT_DATE, 1))}, 1)"
    clock = f"coalesce({time_text}, '')"
    hour, half = number(clock, CLOCK, 1), f"lower({group(clock, CLOCK, 3)})"
    hour = f"CASE WHEN {half} = 'pm' AND {hour} <> 12 THEN {hour} + 12 WHEN {half} = 'am' AND {hour} = 12 THEN 0 " \
        f"WHEN {half} = '' THEN 0 ELSE {hour} END"
    minute = f"if({half} = '', 0, {number(clock, CLOCK, 2)})"
    return zoned_to_utc(wall_clock(year, month, number(day_text, SHORT_DATE, 2), hour, minute), f"'{tz}'")
