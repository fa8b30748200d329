"""Calendar collection: landing bodies to the change logs and their views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette import schemas
from gazette.functions.display import MARKET_SOURCE, SOURCE_NAMES
from gazette.operators.search import calendar_view
from gazette.operators.status import written_per_source
from gazette.operators.upsert import latest
from gazette.plans.ingest import mark
from gazette.sources.config import local_frame
from gazette.sources.registry import COLLECTORS, collect, collect_market
from gazette.sources.tables import Store, content_name, quarantine, stage, write_run


def calendar_state(log: DataFrame, payload: Sequence[str], sticky: Sequence[str] = ()) -> DataFrame:
    """Latest row per calendar key, grouped by all the key is made of, so that filters on these columns are pushed to the log."""
    return latest(log, schemas.CALENDAR_KEY, [name for name in payload if name not in schemas.CALENDAR_KEY], sticky)


def nso_releases(store: Store) -> DataFrame:
    return calendar_state(store.nso_log(), schemas.NSO_PAYLOAD)


def ff_releases(store: Store) -> DataFrame:
    return calendar_state(store.ff_log(), schemas.FF_PAYLOAD, schemas.FF_STICKY)


def unified(store: Store) -> DataFrame:
    return calendar_view(nso_releases(store), ff_releases(store))


def is_first_run(store: Store) -> bool:
    """Whether the list of month pages to fetch should be the wide one (``month_pages(backfill=True)``)."""
    return store.nso_log().isEmpty() and store.ff_log().isEmpty()


def fingerprint(landing: DataFrame) -> str:
    """Name of a landing's content."""
    return content_name(landing, "source", "facet", "seen_at", "batch_ord", "body")


def unregistered(landing: DataFrame) -> DataFrame:
    """Bodies of sources that no collector reads, as faulty rows."""
    known = [code for codes in COLLECTORS for code in codes] + [MARKET_SOURCE]
    strangers = landing.where(~F.coalesce(F.col("source").isin(known), F.lit(False)))
    return strangers.select("source", "seen_at", F.lit("unknown_source").alias("fault"), F.col("body").alias("raw"))


def collect_once(landing: DataFrame, store: Store, run: str, as_of: dt.datetime, months: DataFrame | None = None) -> DataFrame:
    """Parse calendar bodies, append them to the logs and record the run; returns written rows per source.

    All month pages that landed are read, or those of ``months`` (``facet``) alone. Within a body the position orders the writes of
    a key, which become one log row. The run's folders are named by the content too: a run never replaces the rows of
    other bodies, whatever its name, and the same bodies replace themselves.
    """
    run = f"{run}-{fingerprint(landing)}"
    nso = stage(collect(landing, as_of), store, "nso", run)
    ff = stage(collect_market(landing, months), store, "ff", run)
    faulty = [frame.select("source", "seen_at", "fault", "raw") for frame in (nso, ff)]
    rejects = faulty[0].unionByName(faulty[1]).unionByName(unregistered(landing))
    quarantine(rejects, store, F.col("source"), F.col("seen_at"), "calendar", run)
    logs = (("nso_log", nso, schemas.NSO_LOG, schemas.NSO_PAYLOAD, ()), ("ff_log", ff, schemas.FF_LOG, schemas.FF_PAYLOAD, schemas.FF_STICKY))
    for name, rows, schema, payload, sticky in logs:
        last = latest(rows.where("fault is null"), ["source_uid", "seen_at", "batch_ord"], payload, sticky, ["item_pos"])
        write_run(last.select(*schema.names), store.path(name), run, ["release_dt"])
    good = nso.where("fault is null").select("source").unionByName(ff.where("fault is null").select("source"))
    sources = local_frame(store.spark, [(code,) for code in SOURCE_NAMES], schemas.CALENDAR_SOURCES[:1])
    counts = written_per_source(good, sources)
    unread = rejects.where(F.col("fault") == "body_not_parsed").select("source").distinct()
    total = counts.join(unread.withColumn("unread", F.lit(1)), "source", "left").agg(
        F.sum("written").alias("written"), F.count("unread").alias("errors")
    )
    mark(store, "calendar", total, "written", "releases", "collector", run, as_of)
    return counts
