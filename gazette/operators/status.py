"""Run status, counts per source and status text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.display import status_icon


def run_status(errors: Column) -> Column:
    return F.when(errors == 0, "ok").otherwise("partial")


def status_details(count: Column, errors: Column, what: str, who: str) -> Column:
    """``5 new releases``, with ``, 2 agency errors`` when there were errors."""
    return F.concat(
        count.cast("string"), F.lit(f" {what}"),
        F.when(errors > 0, F.concat(F.lit(", "), errors.cast("string"), F.lit(f" {who} errors"))).otherwise(""),
    )


def latest_status(log: DataFrame) -> DataFrame:
    """Last run per pipeline."""
    last = F.max_by(F.struct("status", "details"), F.struct("last_run", "status", "details"))
    grouped = log.groupBy("key").agg(F.max("last_run").alias("last_run"), last.alias("_last"))
    return grouped.select("key", "last_run", "_last.status", "_last.details")


def status_view(latest: DataFrame, keys: DataFrame) -> DataFrame:
    """What a page shows for each pipeline: ``never`` until the first run."""
    joined = keys.join(latest, "key", "left")
    run = F.date_format("last_run", "yyyy-MM-dd HH:mm 'UTC'")
    status = F.coalesce("status", F.when(F.col("last_run").isNull(), "never").otherwise(""))
    return joined.select(
        "key", F.coalesce(run, F.lit("never")).alias("last_run_text"), status.alias("status"),
        F.coalesce("details", F.lit("")).alias("details"), status_icon(status).alias("icon"),
    )


def written_per_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows per configured source, 0 for a source without any."""
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    return sources.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("bigint").alias("written"))


def entry_counts(rows: DataFrame, outer: str = "publisher", inner: str = "feed_label") -> DataFrame:
    """Entries per feed, per agency (null feed) and in all (both null)."""
    return rows.rollup(outer, inner).agg(F.count("*").alias("entries"))


def attempt_totals(chosen: DataFrame) -> DataFrame:
    """Attempted, processed and failed rows of a cycle."""
    return chosen.agg(
        F.count("*").alias("attempted"), F.count_if(F.col("fault").isNull()).alias("processed"),
        F.count_if(F.col("fault").isNotNull()).alias("failed"),
    )


