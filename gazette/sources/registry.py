"""Calendar collectors by source code: landing bodies to release rows.

A collector is a function ``(landing, as_of) -> rows`` with the columns of the landing (without the body) plus
``item_pos, title, release_dt, reference_period, url, fault, raw``. The key is added here, once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions.display import MARKET_SOURCE
from gazette.functions.keys import calendar_uid
from gazette.operators.dedup import first_writer
from gazette.sources import config
from gazette.sources.cso import is_recent, parse_cso
from gazette.sources.html_calendars import parse_embargo_table, parse_event_list, parse_market_pages
from gazette.sources.ics import parse_ics

Collector = Callable[[DataFrame, dt.datetime], DataFrame]
COLLECTORS: dict[tuple[str, ...], Collector] = {}
RUN = ["source", "seen_at", "batch_ord"]


def collector(*codes: str) -> Callable[[Collector], Collector]:
    """Register a collector for one or more source codes."""

    def register(parse: Collector) -> Collector:
        COLLECTORS[codes] = parse
        return parse

    return register


def first_of_run(rows: DataFrame, order: list) -> DataFrame:
    """Within one run a (title, time) counts once. Faulty rows all pass: each is a group of its own."""
    own = F.when(F.col("fault").isNotNull(), F.struct("facet", "item_pos"))
    return first_writer(rows.withColumn("_own", own), [*RUN, "title", "release_dt", "_own"], order).drop("_own")


@collector(*[code for code, _, _ in config.ICS_SOURCES])
def ics_calendars(landing: DataFrame, as_of: dt.datetime) -> DataFrame:
    return parse_ics(landing, config.calendar_sources(landing.sparkSession))


@collector("destatis")
def event_list(landing: DataFrame, as_of: dt.datetime) -> DataFrame:
    facet = F.array_position(F.array(*[F.lit(topic) for topic in config.DESTATIS_TOPICS]), F.col("facet"))
    return first_of_run(parse_event_list(landing), [facet, "facet", "item_pos"])


@collector("insee")
def embargo_table(landing: DataFrame, as_of: dt.datetime) -> DataFrame:
    return parse_embargo_table(landing, as_of.date()).drop("year_inferred")


@collector("cso")
def json_collection(landing: DataFrame, as_of: dt.datetime) -> DataFrame:
    rows = parse_cso(landing).where(F.col("fault").isNotNull() | is_recent("release_dt", as_of))
    return first_of_run(rows, ["item_pos"])


def collect(landing: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows of all registered office calendars. Each branch prunes a landing partitioned by source to its own bodies."""
    branches = [parse(landing.where(F.col("source").isin(list(codes))), as_of) for codes, parse in COLLECTORS.items()]
    rows = reduce(lambda left, right: left.unionByName(right), branches)
    return rows.withColumn("source_uid", calendar_uid(F.col("source"), F.col("title"), F.col("release_dt")))


def collect_market(landing: DataFrame, months: DataFrame | None = None, currency: str = "EUR") -> DataFrame:
    """Rows of the market calendar's month pages: all that landed, or those of ``months``, as ``month_pages`` and ``named_month`` list them."""
    pages = landing.where(F.col("source") == MARKET_SOURCE)
    if months is not None:
        pages = pages.join(months.select("facet"), "facet", "left_semi")
    year = F.regexp_extract("facet", r"(\d{4})", 1).cast("int")
    rows = parse_market_pages(pages.withColumn("year", year), [*RUN, "facet"], "year", currency).drop("year")
    return rows.withColumn("source_uid", calendar_uid(F.col("source"), F.col("title"), F.col("release_dt")))
