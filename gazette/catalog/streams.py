"""Stream and stored-table queries: they write to the shared working folder and read the result back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gazette.catalog.base import RELEASES_SQL, query, releases, table
from gazette.catalog.bodies import (
    FIRST_ENTRIES_SQL, ICS_DT_SQL, ICS_EVENT, LINES_SQL, MARKET_ROW, MARKET_SQL, document_pages, feed_landing, write_bodies,
)
from gazette.catalog.calendars import STATUS_SQL, status_log
from gazette.catalog.enrichment import PROMPT_SQL, TAGGED_SQL
from gazette.operators import enrich, search
from gazette.plans import collect
from gazette.schemas import LANDING_CALENDAR, PRESS_RELEASES
from gazette.session import prepare, work_dir
from gazette.sources import config
from gazette.sources.files import CODEC
from gazette.sources.tables import Store, append_releases, read, with_month
from gazette.streaming import jobs


def table_stream(spark, sf_dir, name):
    """A driver table as a file stream; the braces make it a glob, which may be one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


@query(f"""WITH {RELEASES_SQL} SELECT url_hash, min(doc_id) AS doc_id, arg_min(publisher, doc_id) AS publisher FROM releases GROUP BY url_hash""")
def stream_dedup(spark, sf_dir):
    prepare(spark)
    folder = work_dir(spark, "stream-dedup")
    source = table_stream(spark, sf_dir, "documents").selectExpr("sha2(text, 256) AS url_hash", "doc_id", "source AS publisher")
    jobs.dedup_stream(source, f"{folder}/table", "url_hash", "doc_id", f"{folder}/checkpoint").awaitTermination()
    return read(spark, f"{folder}/table", source.schema)


@query(f"WITH {STATUS_SQL} SELECT key, last_run, status, details FROM latest")
def stream_status(spark, sf_dir):
    prepare(spark)
    folder = work_dir(spark, "stream-status")
    staged = f"{folder}/log"
    status_log(spark, sf_dir).write.parquet(staged)
    latest = jobs.latest_stream(jobs.file_stream(spark, staged, status_log(spark, sf_dir).schema), "key", "last_run", ["status", "details"])

    def sink(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    jobs.start(latest.writeStream.outputMode("update").foreachBatch(sink), f"{folder}/checkpoint", None).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    newest = out.groupBy("key").agg(F.max_by(F.struct("last_run", "status", "details"), "batch").alias("row"))
    return newest.select("key", "row.*")


@query(f"WITH {FIRST_ENTRIES_SQL} SELECT url_hash, url, title, publisher, published FROM firsts")
def stream_ingest(spark, sf_dir):
    """Landing bodies through the ingest stream in several batches: each entry is stored once."""
    prepare(spark)
    folder = work_dir(spark, "stream-ingest")
    store = Store(spark, f"{folder}/store", digits=1)
    feed_landing(spark, sf_dir).write.parquet(f"{folder}/landing", compression=CODEC)
    jobs.ingest_stream(
        spark, f"{folder}/landing", lambda: config.load_feeds(spark), store, f"{folder}/checkpoint",
        clock=lambda: dt.datetime(2024, 12, 31, 12),
    ).awaitTermination()
    return store.press_releases().selectExpr("url_hash", "url", "title", "publisher", "CAST(published AS TIMESTAMP_NTZ) AS published")


@query(f"""WITH {RELEASES_SQL} SELECT doc_id, publisher, published FROM releases WHERE published >= TIMESTAMP '2024-03-05'
    AND published < TIMESTAMP '2024-04-10' ORDER BY published DESC NULLS LAST, doc_id LIMIT 200""")
def stored_month_search(spark, sf_dir):
    """Releases written by month and searched: the range prunes folders as well as row groups."""
    path = f"{work_dir(spark, 'stored')}/releases"
    rows = releases(spark, sf_dir).drop("text", "title")
    append_releases(rows, path, "doc_id")
    spec = search.SearchSpec(date_from=dt.datetime(2024, 3, 5), date_to=dt.datetime(2024, 4, 10), limit=200)
    stored = read(spark, path, with_month(rows.schema))
    return search.search(stored, spec, search.RAW_FIELDS, "doc_id").select("doc_id", "publisher", "published")


@query(f"""WITH {RELEASES_SQL}, {PROMPT_SQL}, {TAGGED_SQL} SELECT sha256('https://x.example/' || doc_id) AS url_hash, publisher, language,
    processing_model, topic, country, sentiment, title_en, key_figures, published FROM extracted JOIN releases USING (doc_id)""")
def stream_enrich(spark, sf_dir):
    """Stored releases through the enrichment stream: page text, prompt, offline extractor, validation, assembly."""
    prepare(spark)
    folder = work_dir(spark, "stream-enrich")
    store = Store(spark, f"{folder}/store", digits=1)
    rows = releases(spark, sf_dir).selectExpr(
        "sha2(concat('https://x.example/', doc_id), 256) AS url_hash", "concat('https://x.example/', doc_id) AS url", "title",
        "concat(language, ' summary') AS summary", "publisher", "publisher AS publisher_full", "language AS feed_label", "language",
        "CAST(published AS TIMESTAMP) AS published", "timestamp'2024-12-31 12:00:00' AS fetched_at", "array(language) AS tags",
        "named_struct('batch_id', doc_id, 'agency_ord', 0, 'feed_ord', 0, 'entry_pos', 0) AS ingest_seq",
    )
    append_releases(rows.select(*PRESS_RELEASES.names), store.path("press_releases"))
    document_pages(spark, sf_dir).write.parquet(f"{folder}/pages")
    jobs.enrich_stream(
        spark, store, lambda: spark.read.parquet(f"{folder}/pages"), enrich.keyword_tagger, f"{folder}/checkpoint",
        clock=lambda: dt.datetime(2024, 12, 31, 12),
    ).awaitTermination()
    return store.processed().selectExpr(
        "url_hash", "publisher", "language", "processing_model", "topic", "country", "sentiment", "title_en", "key_figures",
        "CAST(published AS TIMESTAMP_NTZ) AS published",
    )


@query(f"""WITH {LINES_SQL}, office AS (SELECT 'istat' AS source, trim(line) AS title, {ICS_DT_SQL} AS release_dt, NULL AS impact FROM lines),
    market AS (SELECT 'forexfactory' AS source, title, release_dt, arg_max(impact, (doc_id, item_pos)) AS impact,
    arg_max(actual, (doc_id, item_pos)) FILTER (WHERE actual IS NOT NULL) AS actual
    FROM ({MARKET_SQL}) GROUP BY title, release_dt)
    SELECT DISTINCT source, title, release_dt, impact, NULL AS actual FROM office
    UNION ALL SELECT source, title, release_dt, impact, actual FROM market""")
def stream_collect(spark, sf_dir):
    """Calendar bodies through the collection stream: parse, change logs, both upserts, one calendar."""
    prepare(spark)
    folder = work_dir(spark, "stream-collect")
    store = Store(spark, f"{folder}/store", digits=1)
    ics = write_bodies(spark, sf_dir, ICS_EVENT, "BEGIN:VCALENDAR\r\n", "END:VCALENDAR\r\n").selectExpr("doc_id", "'istat' AS source", "'' AS facet", "body")
    pages = write_bodies(spark, sf_dir, MARKET_ROW, '<table class="calendar__table">', "</table>").selectExpr(
        "doc_id", "'forexfactory' AS source", "'jun.2024' AS facet", "body")
    landing = ics.unionByName(pages).selectExpr(
        "source", "facet", "timestamp'2024-06-01 07:00:00' AS seen_at", "doc_id AS batch_ord", "body")
    landing.select(*LANDING_CALENDAR.names).write.partitionBy("source").parquet(f"{folder}/landing", compression=CODEC)
    jobs.collect_stream(
        spark, f"{folder}/landing", store, f"{folder}/checkpoint", clock=lambda: dt.datetime(2024, 6, 1, 7)
    ).awaitTermination()
    return collect.unified(store).selectExpr("source", "title", "CAST(release_dt AS TIMESTAMP_NTZ) AS release_dt", "impact", "actual")
