"""Filtered, sorted and counted searches."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.display import MARKET_SOURCE, source_name
from gazette.schemas import MONTH, UNDATED

RAW_FIELDS = ("publisher",)
PROCESSED_FIELDS = ("publisher", "topic", "country", "sentiment")
ALL = "all"


@dataclass(frozen=True)
class SearchSpec:
    """What a results page asks for. Unknown filter fields are ignored; ``"all"`` and empty lists filter nothing."""

    filters: dict[str, str | Sequence[str] | None] = field(default_factory=dict)
    date_from: dt.datetime | None = None
    date_to: dt.datetime | None = None
    inclusive_to: bool = False
    limit: int = 100


def parse_day(text: str | None) -> dt.datetime | None:
    """Date-picker text; bad text means no bound."""
    try:
        return dt.datetime.strptime(text or "", "%Y-%m-%d")
    except ValueError:
        return None


def _bound(rows: DataFrame, name: str, value: dt.datetime) -> Column:
    return F.lit(value).cast(rows.schema[name].dataType)


def date_range(rows: DataFrame, stamp: str, date_from: dt.datetime | None, date_to: dt.datetime | None, inclusive_to: bool) -> DataFrame:
    """Range on a stamp; each side optional. Nulls match no bound. The range reaches the Parquet scan.

    ``inclusive_to`` takes the whole named day in, otherwise the day of ``date_to`` is out. A table laid out by month
    is pruned to the folders of the range.
    """
    by_month = stamp == "published" and MONTH in rows.columns
    if date_from:
        rows = rows.where(F.col(stamp) >= _bound(rows, stamp, date_from))
        rows = rows.where((F.col(MONTH) >= f"{date_from:%Y-%m}") & (F.col(MONTH) != UNDATED)) if by_month else rows
    if date_to:
        end = date_to.replace(hour=0, minute=0, second=0, microsecond=0)
        end = end + dt.timedelta(days=1) if inclusive_to else end
        rows = rows.where(F.col(stamp) < _bound(rows, stamp, end))
        rows = rows.where(F.col(MONTH) <= f"{end:%Y-%m}") if by_month else rows
    return rows


def matching(rows: DataFrame, spec: SearchSpec, fields: Sequence[str], stamp: str = "published") -> DataFrame:
    """Rows a spec selects: OR inside a field, AND across fields."""
    for name, value in spec.filters.items():
        if name not in fields or not value or value == ALL:
            continue
        rows = rows.where(F.col(name) == value if isinstance(value, str) else F.col(name).isin(list(value)))
    return date_range(rows, stamp, spec.date_from, spec.date_to, spec.inclusive_to)


def newest(rows: DataFrame, limit: int, key: str = "url_hash", stamp: str = "published") -> DataFrame:
    """Newest first, undated last, the key as tie-breaker."""
    return rows.orderBy(F.col(stamp).desc_nulls_last(), F.col(key)).limit(limit)


def search(rows: DataFrame, spec: SearchSpec, fields: Sequence[str], key: str = "url_hash") -> DataFrame:
    return newest(matching(rows, spec, fields), spec.limit, key)


def count_matching(rows: DataFrame, spec: SearchSpec, fields: Sequence[str]) -> DataFrame:
    """Number of matching rows, whatever the limit."""
    return matching(rows, spec, fields).agg(F.count("*").alias("total"))


def missing_field(rows: DataFrame, name: str, limit: int = 500, key: str = "url_hash", stamp: str = "published") -> DataFrame:
    return newest(rows.where(F.col(name).isNull()), limit, key, stamp)


def publishers_present(rows: DataFrame, column: str = "publisher") -> DataFrame:
    return rows.select(column).distinct()


def calendar_view(nso: DataFrame, market: DataFrame) -> DataFrame:
    """Both calendars as one: columns one side lacks are null."""
    return nso.withColumn("is_ff", F.lit(False)).unionByName(
        market.withColumn("source", F.lit(MARKET_SOURCE)).withColumn("is_ff", F.lit(True)), allowMissingColumns=True
    )


def default_calendar_range(
    as_of: dt.date, date_from: str | None = None, date_to: str | None = None, q: str | None = None
) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Bounds of a calendar search: the current month when nothing is asked; a text search without a start begins with
    the previous month."""
    start, end = parse_day(date_from), parse_day(date_to)
    first = dt.datetime(as_of.year, as_of.month, 1)
    if not (date_from or date_to or q):
        return first, first.replace(day=calendar.monthrange(as_of.year, as_of.month)[1])
    if not date_from and q:
        start = (first - dt.timedelta(days=1)).replace(day=1)
    return start, end


def title_matches(title: Column, q: str, mode: str = "regex") -> Column:
    """Case-insensitive: ``q`` as a pattern, or as plain text with ``mode="literal"``."""
    if mode == "literal":
        return F.contains(F.lower(title), F.lower(F.lit(q)))
    return title.rlike(f"(?iu){q}")


def matching_calendar(
    view: DataFrame, source: str | None = None, date_from: dt.datetime | None = None, date_to: dt.datetime | None = None,
    q: str | None = None, mode: str = "regex",
) -> DataFrame:
    """Calendar predicate; the day of ``date_to`` is included."""
    if source and source != ALL:
        view = view.where(F.col("source") == source)
    view = date_range(view, "release_dt", date_from, date_to, inclusive_to=True)
    return view.where(title_matches(F.col("title"), q, mode)) if q else view


def search_calendar(view: DataFrame, limit: int = 500, **filters) -> DataFrame:
    """Oldest first; at equal times office rows come before market rows."""
    return matching_calendar(view, **filters).orderBy("release_dt", "is_ff", "source_uid").limit(limit)


def calendar_sources_present(view: DataFrame) -> DataFrame:
    """Sources with their display names, by code, the market source last."""
    codes = view.select(F.col("source").alias("code"), "is_ff").distinct()
    return codes.select("code", source_name("code").alias("name"), "is_ff").orderBy("is_ff", "code")


def filter_definitions(domains: DataFrame) -> DataFrame:
    """One row per closed-domain field with its choices in order."""
    choices = F.array_sort(F.collect_list(F.struct("ord", "choice")))
    return domains.groupBy("field").agg(F.transform(choices, lambda one: one["choice"]).alias("choices"))
