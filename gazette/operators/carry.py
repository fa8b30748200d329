"""Carry the last seen value down the rows of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, page: str | list[str], order: str, value: str, chunk: int | None = 100_000) -> DataFrame:
    """Replace nulls of ``value`` by the last value before them, by ``order`` inside each ``page``.

    ``order`` is an integer position. A page is cut into runs of ``chunk`` positions, so even a page that holds most
    of the table is filled by many tasks: inside a run by a window, and across runs by the last value of each earlier
    run, which is one narrow row per run. ``chunk=None`` skips the cut, for pages bounded by one landing body.
    """
    page = [page] if isinstance(page, str) else list(page)
    if chunk is None:
        whole = Window.partitionBy(*page).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(value, F.last(value, ignorenulls=True).over(whole))
    run = F.floor(F.col(order) / F.lit(chunk)).alias("_run")
    cut = rows.select("*", run)
    inside = Window.partitionBy(*page, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumn("_value", F.last(value, ignorenulls=True).over(inside))
    lasts = cut.groupBy(*page, "_run").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(*page).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*page, "_run", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    keys = [*page, "_run"]
    joined = filled.join(carried, keys, "left")
    return joined.select(
        *[F.coalesce("_value", "_carried").alias(value) if name == value else F.col(name) for name in rows.columns]
    )
