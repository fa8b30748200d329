from __future__ import annotations

import datetime as dt

import test_calendars as calendars
import test_feeds as feeds
from pyspark.sql import functions as F

from gazette import schemas
from gazette.operators import enrich as op
from gazette.operators import search, status
from gazette.plans import collect, enrich, ingest
from gazette.sources.config import load_feeds, load_preferences, local_frame
from gazette.sources.tables import Store
from gazette.streaming import jobs

NOW = dt.datetime(2025, 7, 16, 7)
ISTAT, ISTAT_2 = "https://www.istat.it/tema/prezzi/feed", "https://www.istat.it/tema/servizi/feed"


def landing(spark, *bodies, batch=1):
    return local_frame(spark, [(url, feeds.FETCHED, batch, body) for url, body in bodies], schemas.LANDING_FEED)


def item(n, title="t"):
    return f"<title>{title}</title><link>https://x/{n}</link><description>d{n}</description><pubDate>2025-07-{n:02d}</pubDate>"


def test_ingest_enrich_backfill(spark, store):
    first = landing(spark, (ISTAT, feeds.rss(item(1), item(1, "again"), item(2))), (ISTAT_2, feeds.rss(item(2, "other feed"), item(3))), ("https://nowhere", "x"))
    summary = ingest.ingest(first, load_feeds(spark), store, "r1", NOW).first()
    assert tuple(summary) == (5, 3, 2, 1)
    rows = {row.url: row for row in store.press_releases().collect()}
    assert len(rows) == 3 and rows["https://x/1"].title == "t" and rows["https://x/2"].feed_label == "Prices"
    assert {row.pub_month for row in rows.values()} == {"2025-07"}

    replay = ingest.ingest(first, load_feeds(spark), store, "r1", NOW).first()
    assert (replay.inserted, store.press_releases().count()) == (0, 3)
    second = ingest.ingest(landing(spark, (ISTAT, feeds.rss(item(3, "changed"), item(4))), batch=2), load_feeds(spark), store, "r2", NOW).first()
    assert tuple(second) == (2, 1, 1, 0)
    assert {row.url: row.title for row in store.press_releases().collect()}["https://x/3"] == "t"
    assert store.quarantine().count() == 1
    latest = status.latest_status(store.status_log()).first()
    assert latest.key == "press_releases" and store.status_log().count() == 2

    pages = local_frame(spark, [("https://x/1", "<html><body><nav>n</nav><p>Italian GDP rose 0.3%</p></body></html>")], schemas.LANDING_PAGE)
    totals = enrich.enrich(store, pages, op.keyword_tagger, "e1", NOW, limit=2).first()
    assert tuple(totals) == (2, 2, 0)
    totals = enrich.enrich(store, pages, op.keyword_tagger, "e2", NOW).first()
    assert tuple(totals) == (2, 2, 0)
    assert enrich.enrich(store, pages, op.keyword_tagger, "e3", NOW).first().attempted == 0
    done = {row.url: row for row in store.processed().collect()}
    assert len(done) == 4
    gdp = done["https://x/1"]
    assert (gdp.topic, gdp.country, gdp.sentiment, gdp.key_figures) == ("GDP", "Italy", "positive", "0.3%")
    assert (gdp.processing_model, gdp.processed_at, gdp.published) == ("offline/keywords", NOW, dt.datetime(2025, 7, 1))
    assert tuple(op.backlog(store.press_releases(), store.processed()).first()) == (4, 4, 0)

    found = search.search(store.processed(), search.SearchSpec({"topic": "GDP"}, dt.datetime(2025, 7, 1), dt.datetime(2025, 7, 31)), search.PROCESSED_FIELDS)
    assert [row.url for row in found.collect()] == ["https://x/1"]

    holes = store.processed().withColumn("title_en", F.when(F.col("url") == "https://x/1", F.col("title_en")))

    def translate(prompts):
        return prompts.select("url_hash", F.lit(0).alias("rank"), F.struct(F.lit(" T ").alias("title_en")).alias("answer"),
                              F.when(F.col("url_hash") == done["https://x/4"].url_hash, "failed").alias("error"))

    filled = {row.url: row for row in enrich.backfill_titles(holes, translate, NOW).collect()}
    assert [(filled[f"https://x/{n}"].title_en, filled[f"https://x/{n}"].updated_at) for n in (1, 2, 4)] == [("t", None), ("T", NOW), (None, None)]


def test_failed_answers_are_quarantined(spark, store):
    ingest.ingest(landing(spark, (ISTAT, feeds.rss(item(1), item(2)))), load_feeds(spark), store, "r1", NOW)
    hashes = {row.url: row.url_hash for row in store.press_releases().collect()}
    model = load_preferences(spark).orderBy("rank").first()
    bad = {"topic": "x", "country": "Italy", "sentiment": "neutral", "title_en": "t", "summary_en": "s", "key_figures": ""}
    answers = local_frame(spark, [(hashes["https://x/1"], model.provider, model.model, bad, None)], schemas.ANSWERS)
    extract = op.recorded_answers(answers, load_preferences(spark))
    pages = local_frame(spark, [], schemas.LANDING_PAGE)
    assert tuple(enrich.enrich(store, pages, extract, "e1", NOW).first()) == (2, 0, 2)
    assert sorted((row.reason, row.raw) for row in store.quarantine().collect()) == [
        ("domain:topic", "https://x/1"), ("no_answer", "https://x/2")]


def test_collect(spark, store):
    bodies = [("istat", "", calendars.ICS), ("forexfactory", "aug.2026", calendars.MARKET)]
    assert collect.is_first_run(store)
    counts = {row.source: row.written for row in collect.collect_once(calendars.landing(spark, *bodies), store, "c1", calendars.AS_OF).collect()}
    assert counts == {"istat": 4, "forexfactory": 3, "eurostat": 0, "ine": 0, "destatis": 0, "insee": 0, "cso": 0}
    assert not collect.is_first_run(store)
    before = sorted(map(str, collect.unified(store).collect()))
    collect.collect_once(calendars.landing(spark, *bodies), store, "c1", calendars.AS_OF)
    assert sorted(map(str, collect.unified(store).collect())) == before
    late = calendars.MARKET.replace("0.3%", "").replace("impact-red", "impact-yel")
    rows = [("forexfactory", "aug.2026", calendars.AS_OF + dt.timedelta(days=1), 2, late)]
    collect.collect_once(local_frame(spark, rows, schemas.LANDING_CALENDAR), store, "c2", calendars.AS_OF + dt.timedelta(days=1))
    cpi = collect.ff_releases(store).where("title = 'CPI'").first()
    assert (cpi.actual, cpi.forecast, cpi.impact, cpi.first_seen) == ("0.3%", "0.2%", "low", calendars.AS_OF)
    assert status.latest_status(store.status_log()).first().details == "3 releases"
    hits = search.search_calendar(collect.unified(store), q="cpi|zulu", date_from=dt.datetime(2026, 8, 1))
    assert [row.title for row in hits.collect()] == ["Zulu", "CPI"]


def test_streams(spark, store, tmp_path):
    folder = str(tmp_path / "landing")
    landing(spark, (ISTAT, feeds.rss(item(1), item(2)))).write.parquet(folder)

    def poll(checkpoint):
        jobs.ingest_stream(spark, folder, lambda: load_feeds(spark), store, str(tmp_path / checkpoint), max_files=1, clock=lambda: NOW).awaitTermination()

    poll("cp")
    landing(spark, (ISTAT_2, feeds.rss(item(2, "late"), item(3))), batch=2).write.mode("append").parquet(folder)
    poll("cp")
    assert {row.url: row.feed_label for row in store.press_releases().collect()} == {
        "https://x/1": "Prices", "https://x/2": "Prices", "https://x/3": "Services"}
    poll("lost-checkpoint")
    assert store.press_releases().count() == 3

    pages = local_frame(spark, [], schemas.LANDING_PAGE)
    jobs.enrich_stream(spark, store, lambda: pages, op.keyword_tagger, str(tmp_path / "cp2"), clock=lambda: NOW).awaitTermination()
    assert store.processed().count() == 3

    seen = []
    jobs.status_stream(spark, store, lambda rows, _: seen.extend(row.key for row in rows.collect()), str(tmp_path / "cp3")).awaitTermination()
    assert seen == ["press_releases"]


def test_calendar_stream(spark, store, tmp_path):
    folder = str(tmp_path / "landing")
    calendars.landing(spark, ("istat", "", calendars.ICS)).write.parquet(folder)
    jobs.collect_stream(spark, folder, store, str(tmp_path / "cp"), clock=lambda: calendars.AS_OF).awaitTermination()
    assert collect.nso_releases(store).count() == 4


def test_horizon_dedup(spark, tmp_path):
    rows = [("a", NOW), ("a", NOW), ("b", NOW)]
    schema = schemas.struct("k string, seen timestamp")
    local_frame(spark, rows, schema).write.parquet(str(tmp_path / "in"))
    source = jobs.horizon_dedup(jobs.file_stream(spark, str(tmp_path / "in"), schema), "k", "seen", "1 hour")
    jobs.start(source.writeStream.outputMode("append").foreachBatch(
        lambda batch, _: batch.write.mode("append").parquet(str(tmp_path / "out"))), str(tmp_path / "cp"), None).awaitTermination()
    assert sorted(row.k for row in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_store_root_is_shared_setting(spark):
    from gazette.session import work_dir

    assert work_dir(spark, "x") != work_dir(spark, "x")
    assert Store(spark, "/a/").path("t") == "/a/t"


def stranger(spark, body):
    return local_frame(spark, [("bogus", "", NOW, 1, body)], schemas.LANDING_CALENDAR)


def test_collect_quarantines_unknown_sources_and_keeps_other_bodies(spark, store):
    first, second = stranger(spark, "first"), stranger(spark, "second")
    assert collect.fingerprint(first.union(second)) == collect.fingerprint(second.union(first))
    for bodies in (first, second, first):
        collect.collect_once(bodies, store, "same", calendars.AS_OF)
    assert sorted((row.raw, row.reason) for row in store.quarantine().collect()) == [("first", "unknown_source"), ("second", "unknown_source")]


def test_collect_adds_under_one_run_name_and_takes_large_batch_numbers(spark, store):
    for title, batch in (("Zulu", 1_700_000_000_000), ("Yankee", 1_700_000_000_001)):
        rows = [("istat", "", calendars.AS_OF, batch, calendars.ICS.replace("Zulu", title))]
        collect.collect_once(local_frame(spark, rows, schemas.LANDING_CALENDAR), store, "same", calendars.AS_OF)
    assert {"Zulu", "Yankee"} <= {row.title for row in collect.nso_releases(store).collect()}


def test_failed_rows_are_tried_again(spark, store, tmp_path):
    ingest.ingest(landing(spark, (ISTAT, feeds.rss(item(1), item(2), item(3)))), load_feeds(spark), store, "r", NOW)
    pages = local_frame(spark, [("https://x/1", "<p>old"), ("https://x/1", "<p>older")], schemas.LANDING_PAGE)
    seen = str(tmp_path / "prompts")

    def broken(prompts):
        prompts.write.mode("append").parquet(seen)
        return op.keyword_tagger(prompts).withColumn("error", F.lit("down"))

    def run(extract, checkpoint):
        jobs.enrich_stream(spark, store, lambda: pages, extract, str(tmp_path / checkpoint), clock=lambda: NOW).awaitTermination()

    run(broken, "cp")
    assert store.processed().count() == 0 and store.retry().count() == 3
    assert spark.read.parquet(seen).count() == 3
    run(op.keyword_tagger, "cp")
    assert store.processed().count() == 3 and store.retry().count() == 3
    run(op.keyword_tagger, "cp")
    assert store.processed().count() == 3


def test_calendar_search_reaches_the_log(spark, store, capsys):
    ics = "BEGIN:VEVENT\r\nSUMMARY:GDP\r\nDTSTART:20260814T080000Z\r\nEND:VEVENT\r\n"
    bodies = local_frame(spark, [("istat", "", NOW, 1, ics), ("istat", "", NOW, 2, ics)], schemas.LANDING_CALENDAR)
    collect.collect_once(bodies, store, "r", NOW)
    view = collect.nso_releases(store)
    assert view.count() == 1
    view.where("release_dt >= timestamp'2026-08-01' AND source = 'istat'").explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(release_dt" in pushed and "EqualTo(source,istat)" in pushed
