"""Counts from a rollup by month, kept up by the runs.

A run adds one row for each month and combination of filter fields that it wrote, in a folder of its own: a run that is
repeated replaces its rows. A count over a range of dates adds whole months from the rollup and counts the rows of the months
that the range cuts, which are pruned by folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.operators.search import SearchSpec, count_matching, matching
from gazette.schemas import MONTH, UNDATED


def rollup_schema(fields: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in (MONTH, *fields)] + [T.StructField("n", T.LongType())])


def rollup_of(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows counted by month and filter fields; a folded rollup is that of its own rows."""
    n = F.sum("n") if "n" in rows.columns else F.count("*")
    return rows.groupBy(MONTH, *fields).agg(n.alias("n"))


def cut_months(spec: SearchSpec) -> list[str]:
    """Months of which the range takes a part."""
    found = set()
    if spec.date_from and spec.date_from != dt.datetime(spec.date_from.year, spec.date_from.month, 1):
        found.add(f"{spec.date_from:%Y-%m}")
    if spec.date_to:
        end = spec.date_to.replace(hour=0, minute=0, second=0, microsecond=0) + dt.timedelta(days=int(spec.inclusive_to))
        if end.day != 1:
            found.add(f"{end:%Y-%m}")
    return sorted(found)


def whole_months(rollup: DataFrame, spec: SearchSpec) -> DataFrame:
    """Rollup rows of the months that lie in the range with all their days."""
    rows = rollup.where(~F.col(MONTH).isin(cut_months(spec)))
    if spec.date_from:
        rows = rows.where((F.col(MONTH) >= f"{spec.date_from:%Y-%m}") & (F.col(MONTH) != UNDATED))
    if spec.date_to:
        end = spec.date_to.replace(hour=0, minute=0, second=0, microsecond=0) + dt.timedelta(days=int(spec.inclusive_to))
        rows = rows.where((F.col(MONTH) < f"{end:%Y-%m}") & (F.col(MONTH) != UNDATED))
    return rows


def count_by_rollup(rows: DataFrame, rollup: DataFrame, spec: SearchSpec, fields: Sequence[str]) -> DataFrame:
    """Number of matching rows: ``total``."""
    counted = matching(whole_months(rollup, spec), SearchSpec(spec.filters), fields).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    cut = cut_months(spec)
    if not cut:
        return counted
    edges = count_matching(rows.where(F.col(MONTH).isin(cut)), spec, fields)
    return counted.unionByName(edges).agg(F.sum("total").alias("total"))
