"""Result pages of a table that is laid out by month: newest months are read first, and no more of them than a page needs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.operators.search import SearchSpec, matching, newest
from gazette.schemas import MONTH, UNDATED
from gazette.sources import files

#: Where a page ended: the last row's stamp (None for an undated one) and key.
Cursor = tuple[dt.datetime | None, str | int]


def months_of(spark: SparkSession, path: str) -> list[str]:
    """Months of a table, newest first, undated rows last."""
    names = [one.removeprefix(f"{MONTH}=") for one in files.children(spark, path) if one.startswith(f"{MONTH}=")]
    return sorted((one for one in names if one != UNDATED), reverse=True) + [one for one in names if one == UNDATED]


def asked_months(months: Sequence[str], spec: SearchSpec, after: Cursor | None) -> list[str]:
    """Months that can hold rows of the page: inside the range of dates, and not before the cursor's month."""
    first = f"{spec.date_from:%Y-%m}" if spec.date_from else ""
    last = f"{spec.date_to:%Y-%m}" if spec.date_to else UNDATED
    dated = [one for one in months if one != UNDATED and first <= one <= last]
    if after is not None:
        dated = [] if after[0] is None else [one for one in dated if one <= f"{after[0]:%Y-%m}"]
    undated = [] if spec.date_from or spec.date_to else [one for one in months if one == UNDATED]
    return dated + undated


def behind(rows: DataFrame, after: Cursor, key: str, stamp: str) -> DataFrame:
    """Rows that come after the cursor: older ones, at its stamp those of larger keys, undated ones last."""
    at, last = after
    if at is None:
        return rows.where(F.col(stamp).isNull() & (F.col(key) > last))
    bound = F.lit(at).cast(rows.schema[stamp].dataType)
    return rows.where(F.col(stamp).isNull() | (F.col(stamp) < bound) | ((F.col(stamp) == bound) & (F.col(key) > last)))


def newest_page(
    spark: SparkSession, path: str, schema: T.StructType, spec: SearchSpec, fields: Sequence[str], after: Cursor | None = None,
    key: str = "url_hash", stamp: str = "published",
) -> DataFrame:
    """The ``spec.limit`` newest matching rows after a cursor; the months that are not needed are not read.

    Months are taken one, two, four at a time, while fewer rows than the page holds are found in them.
    """
    months, taken, found, step = asked_months(months_of(spark, path), spec, after), [], 0, 1

    def rows(some: list[str]) -> DataFrame:
        folders = [f"{path}/{MONTH}={one}" for one in some]
        table = spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)
        hits = matching(table, spec, fields, stamp)
        return hits if after is None else behind(hits, after, key, stamp)

    while months and found < spec.limit:
        some, months = months[:step], months[step:]
        found += rows(some).limit(spec.limit - found).count()
        taken, step = taken + some, step * 2
    if not taken:
        return spark.createDataFrame([], schema)
    return newest(rows(taken), spec.limit, key, stamp)


def cursor_of(page: DataFrame, key: str = "url_hash", stamp: str = "published") -> Cursor | None:
    """Where a page ended; None for an empty one."""
    last = page.orderBy(F.col(stamp).asc_nulls_first(), F.col(key).desc()).select(stamp, key).first()
    return None if last is None else (last[0], last[1])
