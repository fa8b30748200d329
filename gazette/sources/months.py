"""Month lists of the market calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKBACK_MONTHS, LOOKAHEAD_MONTHS = 1, 3
BACKFILL_START = dt.date(2026, 6, 1)


def month_sequence(first: Column, last: Column) -> Column:
    """First days of all months from ``first`` to ``last``; empty when they are the wrong way round."""
    first, last = F.trunc(first, "month"), F.trunc(last, "month")
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return F.when(first <= last, months).otherwise(F.array().cast("array<date>"))


def routine_months(as_of: Column) -> Column:
    return month_sequence(F.add_months(as_of, -LOOKBACK_MONTHS), F.add_months(as_of, LOOKAHEAD_MONTHS))


def backfill_months(as_of: Column) -> Column:
    return month_sequence(F.lit(BACKFILL_START), as_of)


def page_key(month: Column) -> Column:
    """``aug.2026``: how a month page is named."""
    return F.lower(F.date_format(month, "MMM.yyyy"))


def month_pages(spark: SparkSession, as_of: dt.date, backfill: bool = False) -> DataFrame:
    """Month pages to read: the routine window, on a backfill also every month since the start."""
    day = F.lit(as_of)
    months = F.array_union(backfill_months(day), routine_months(day)) if backfill else routine_months(day)
    return spark.range(1).select(F.explode(months).alias("month")).select("month", page_key(F.col("month")).alias("facet"))


def named_month(spark: SparkSession, day: dt.date) -> DataFrame:
    """The page of the month that ``day`` lies in."""
    month = F.trunc(F.lit(day), "month")
    return spark.range(1).select(month.alias("month"), page_key(month).alias("facet"))
