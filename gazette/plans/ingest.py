"""Feed ingest: landing bodies to new press releases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators.status import run_status, status_details
from gazette.schemas import LANDING_FEED, POLL, PRESS_RELEASES
from gazette.sources.feeds import parse_feeds
from gazette.sources.files import finished
from gazette.sources.keyindex import KEY, RUN
from gazette.sources.tables import Store, append_releases, content_name, quarantine, stage, write_run


def body_digest() -> Column:
    """Which body of which feed."""
    return F.sha2(F.concat(F.coalesce("feed_url", F.lit("")), F.lit("\0"), F.coalesce("body", F.lit("")), F.when(F.col("body").isNull(), "null").otherwise("")), 256)


def ingest(landing: DataFrame, feeds: DataFrame, store: Store, run: str, run_ts: dt.datetime) -> DataFrame:
    """Parse a batch of landing bodies, append what is new and record the run.

    Returns one row: entries, inserted, skipped, errors. Feeds answer every poll with their whole list: a body that was read before
    is not parsed again, and its entries count as skipped. The parsed batch is staged, so the other bodies are parsed once
    and a lost executor costs a re-read, not a re-parse. The run's folders are named by its content: a stream that starts with a new
    checkpoint adds to those of earlier ones. A run that was finished before changes nothing.
    """
    run = f"{run}-{content_name(landing, *LANDING_FEED.names)}"
    if finished(store.spark, f"{store.path('polls')}/run={run}"):
        done = store.spark.read.parquet(f"{store.path('polls')}/run={run}")
        return done.select("entries", F.lit(0).cast("bigint").alias("inserted"), F.col("entries").alias("skipped"), "errors")
    bodies = stage(landing.select("feed_url", "fetched_at", "batch_id", body_digest().alias("digest")), store, "bodies", run)
    known = stage(store.bodies().matching(bodies, "digest").where(F.col(RUN) != run).groupBy(F.col(KEY).alias("digest")).agg(
        F.max("entries").alias("entries"), F.max("unread").alias("unread")), store, "known_bodies", run)
    changed = landing.withColumn("digest", body_digest()).join(known.select("digest"), "digest", "left_anti")
    parsed = stage(parse_feeds(changed.drop("digest"), feeds), store, "entries", run)
    quarantine(parsed, store, F.col("feed_url"), F.col("fetched_at"), "feeds", run)
    good = parsed.where("fault is null").select(*PRESS_RELEASES.names)
    fresh = store.release_keys().insert(
        good, "url_hash", "ingest_seq", run, lambda: store.press_releases(), lambda rows, name: stage(rows, store, name, run),
        lambda rows: append_releases(rows, store.path("press_releases")),
    )
    unchanged = bodies.join(known, "digest")
    summary = stage(ingest_summary(parsed, fresh, unchanged), store, "summary", run)
    mark(store, "press_releases", summary, "inserted", "new releases", "agency", run, run_ts)
    store.bodies().add(read_bodies(bodies.join(known, "digest", "left_anti"), parsed), "digest", run)
    none = [F.lit(0).cast("bigint").alias(name) for name in POLL.names[1:]]
    parts = [
        summary.select(*none[:2], "entries", "inserted", "skipped", "errors"),
        bodies.agg(F.count("*").alias("bodies")).select("bodies", *none[1:]), unchanged.agg(F.count("*").alias("unchanged")).select(none[0], "unchanged", *none[2:]),
    ]
    poll = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.sum(name).alias(name) for name in POLL.names[1:]])
    poll = poll.select(F.lit(run_ts).cast("timestamp_ntz").alias("polled"), *POLL.names[1:])
    write_run(poll, store.path("polls"), run)
    return summary


def agency() -> Column:
    return F.coalesce(F.col("ingest_seq.agency_ord").cast("string"), F.col("feed_url"))


def unread() -> Column:
    """The agency of a body that could not be parsed."""
    return F.when(F.col("fault").isin("feed_not_parsed", "unknown_feed"), agency())


def read_bodies(bodies: DataFrame, parsed: DataFrame) -> DataFrame:
    """What each new body gave, for the ledger: entries belong to the body of their feed, capture and batch.

    Bodies of unknown feeds are left out, as the feed list may change, and so are two bodies that a capture gives for one feed.
    """
    place = ["feed_url", "fetched_at", "batch_id"]
    gave = parsed.withColumn("batch_id", F.col("ingest_seq.batch_id")).groupBy(*place).agg(
        F.count_if(F.col("fault").isNull()).alias("entries"), F.max(unread()).alias("unread"), F.count_if(F.col("fault") == "unknown_feed").alias("strange"))
    alone = bodies.groupBy(*place).agg(F.max("digest").alias("digest"), F.min("digest").alias("_least")).where("digest = _least")
    joined = alone.join(gave.toDF(*(f"_{name}" for name in place), "entries", "unread", "strange"), [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in place], "left")
    known = joined.where("coalesce(strange, 0) = 0").select("digest", F.coalesce("entries", F.lit(0)).alias("entries"), "unread")
    return known.groupBy("digest").agg(F.max("entries").alias("entries"), F.max("unread").alias("unread"))


def ingest_summary(parsed: DataFrame, fresh: DataFrame, unchanged: DataFrame | None = None) -> DataFrame:
    """Exact counts; ``errors`` are agencies with a body that could not be read. Bodies that are ``unchanged`` count with what they gave."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = [
        parsed.select(F.when(F.col("fault").isNull(), one).otherwise(none).alias("entries"), unread().alias("unread"), none.alias("fresh")),
        fresh.select(none.alias("entries"), F.lit(None).cast("string").alias("unread"), one.alias("fresh")),
    ]
    if unchanged is not None:
        sides.append(unchanged.select("entries", "unread", none.alias("fresh")))
    every = sides[0]
    for side in sides[1:]:
        every = every.unionByName(side)
    counts = every.agg(F.coalesce(F.sum("entries"), none).alias("entries"), F.coalesce(F.sum("fresh"), none).alias("inserted"), F.countDistinct("unread").alias("errors"))
    return counts.select("entries", "inserted", (F.col("entries") - F.col("inserted")).alias("skipped"), "errors")


def mark(
    store: Store, key: str, summary: DataFrame, count: str, what: str, who: str, run: str, run_ts: dt.datetime
) -> None:
    """Append the run's status row."""
    row = summary.select(
        F.lit(key).alias("key"), F.lit(run_ts).cast("timestamp_ntz").alias("last_run"),
        run_status(F.col("errors")).alias("status"),
        status_details(F.col(count), F.col("errors"), what, who).alias("details"),
    )
    write_run(row, store.path("status"), f"{key}-{run}")
