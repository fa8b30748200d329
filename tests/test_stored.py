"""Indexes, ledgers, generations and the other mechanisms of stored tables, their failures and their plans."""

from __future__ import annotations

import datetime as dt
import random
import re
import threading
import time
from pathlib import Path

import pandas as pd
import pytest
import test_feeds as feeds
from pyspark.sql import functions as F
from test_jobs import ISTAT, ISTAT_2, NOW, item, landing

from gazette import schemas
from gazette.operators import attempts, enrich as op, pages, rollup, search, templates, trigrams, upsert
from gazette.plans import enrich, ingest
from gazette.plans.logs import close_logs, maintain
from gazette.schemas import MONTH
from gazette.sources import files
from gazette.sources.config import load_feeds, local_frame
from gazette.sources.generations import Generations
from gazette.sources.keyindex import KEY, KeyIndex, prefix_of
from gazette.sources.tables import Store, append_releases, content_name, read, with_month, write_run
from gazette.streaming import jobs

PAIRS = schemas.struct("k string, at int")


def staging(spark, folder):
    return lambda rows, name: spark.read.schema(rows.schema).parquet(write_run(rows, f"{folder}/stage", f"{name}-{random.random()}"))


def test_key_index_reads_the_folders_of_the_batch(spark, tmp_path, capsys):
    index = KeyIndex(spark, str(tmp_path / "keys"), digits=2)
    index.add(local_frame(spark, [(f"key {i}", i) for i in range(500)], PAIRS), "k", "old")
    assert len(index.folders()) > 150
    batch = local_frame(spark, [("key 7", 1), ("new", 2), (None, 3)], PAIRS)
    assert sorted((row.k, row.at) for row in index.absent(batch, "k").where("k IS NOT NULL").collect()) == [("new", 2)]
    index.matching(batch, "k").explain("formatted")
    wanted = {row[0] for row in batch.select(prefix_of(F.col("k"), 2)).collect()}
    read_folders = set(re.findall(r"prefix=([0-9a-f]{2})", capsys.readouterr().out))
    assert read_folders and read_folders <= wanted


def test_rows_of_a_first_poll_are_written_once_and_digests_small(spark, tmp_path):
    index, target = KeyIndex(spark, str(tmp_path / "keys"), digits=1), str(tmp_path / "table")
    batch = spark.range(0, 20000, 1, 1).selectExpr("sha2(CAST(id AS STRING), 256) AS k", "id AS at")
    steps = []

    def staged(rows, name):
        steps.append(name)
        return staging(spark, tmp_path)(rows, name)

    insert = lambda run, rows: index.insert(rows, "k", "at", run, lambda: read(spark, target, batch.schema), staged, lambda some: some.write.mode("append").parquet(target))
    assert insert("r1", batch).count() == 20000 and "fresh" not in steps
    more = spark.range(15000, 25000, 1, 1).selectExpr("sha2(CAST(id AS STRING), 256) AS k", "id AS at")
    assert insert("r2", more).count() == 5000 and "fresh" in steps
    assert read(spark, target, batch.schema).select("k").distinct().count() == read(spark, target, batch.schema).count() == 25000
    folder = write_run(batch.select("k"), str(tmp_path / "run"), "r")
    assert sum(one.stat().st_size for one in Path(folder).glob("*.parquet")) < 45 * 20000


def test_insert_is_mended_by_the_repeated_run(spark, tmp_path):
    index, target = KeyIndex(spark, str(tmp_path / "keys"), digits=1), str(tmp_path / "table")
    stored = lambda: read(spark, target, PAIRS)
    append = lambda rows: rows.write.mode("append").parquet(target)
    batch = local_frame(spark, [("a", 2), ("a", 1), ("b", 1)], PAIRS)

    def broken(rows):
        raise RuntimeError("the executor is gone")

    with pytest.raises(RuntimeError):
        index.insert(batch, "k", "at", "r1", stored, staging(spark, tmp_path), broken)
    for run in ("r1", "r1", "r2"):
        index.insert(batch, "k", "at", run, stored, staging(spark, tmp_path), append)
    assert sorted(map(tuple, stored().collect())) == [("a", 1), ("b", 1)]
    index.compact()
    assert all(len([one for one in files.children(spark, f"{index.path}/prefix={p}") if one.endswith(".parquet")]) == 1 for p in index.folders())
    assert {row[KEY] for row in index.rows().collect()} == {"a", "b"}
    late = KeyIndex(spark, str(tmp_path / "late"), digits=1)
    late.insert(batch, "k", "at", "r9", stored, staging(spark, tmp_path), append)
    assert stored().count() == 2


def test_repolled_bodies_are_not_parsed_again(spark, store):
    first = landing(spark, (ISTAT, feeds.rss(item(1), item(2))), ("https://nowhere", feeds.rss(item(9))), (ISTAT_2, "no feed at all"))
    assert tuple(ingest.ingest(first, load_feeds(spark), store, "a", NOW).first()) == (2, 2, 0, 2)
    again = landing(spark, (ISTAT, feeds.rss(item(1), item(2))), ("https://nowhere", feeds.rss(item(9))), (ISTAT_2, "no feed at all"), (ISTAT_2, feeds.rss(item(3))), batch=2)
    assert tuple(ingest.ingest(again, load_feeds(spark), store, "b", NOW + dt.timedelta(minutes=5)).first()) == (3, 1, 2, 2)
    polls = sorted(map(tuple, store.polls().collect()))
    assert [row[1:] for row in polls] == [(3, 0, 2, 2, 0, 2), (4, 2, 3, 1, 2, 2)]
    # The unreadable body is in quarantine once, that of the unknown feed with every poll.
    assert sorted(row.reason for row in store.quarantine().collect()) == ["feed_not_parsed", "unknown_feed", "unknown_feed"]
    parsed = [spark.read.parquet(f"{store.path('stage/entries')}/{run}").count() for run in files.children(spark, store.path("stage/entries"))]
    assert sorted(parsed) == [2, 4]


def test_a_new_checkpoint_adds_to_quarantine_and_status(spark, store, tmp_path):
    for number in (1, 2):
        folder = str(tmp_path / f"landing{number}")
        landing(spark, (f"https://nowhere/{number}", "x"), batch=number).write.parquet(folder)
        jobs.ingest_stream(spark, folder, lambda: load_feeds(spark), store, str(tmp_path / f"cp{number}"), clock=lambda: NOW).awaitTermination()
    assert store.quarantine().count() == 2 and store.status_log().count() == 2


LOG = schemas.struct("k string, v string, seen_at timestamp, batch_ord bigint")


def log_rows(spark, *rows):
    return local_frame(spark, [(k, v, NOW + dt.timedelta(hours=n), n) for k, v, n in rows], LOG)


def fold(rows):
    return upsert.compact(rows, "k", ["v"])


def test_generations_lose_nothing_between_snapshot_and_marker(spark, tmp_path, monkeypatch):
    table = Generations(spark, str(tmp_path / "log"), LOG, schemas.FIRST_SEEN)
    assert table.rows().count() == 0 and table.close(fold) is None
    write_run(log_rows(spark, ("a", "1", 1), ("b", "1", 1)), table.path, "r1")
    write_run(log_rows(spark, ("a", "2", 2)), table.path, "r2")

    def state():
        return sorted((row.k, row.v, row.first_seen, row.updated_at) for row in upsert.latest(table.rows(), "k", ["v"]).collect())

    before = state()
    with monkeypatch.context() as patch:
        patch.setattr(Generations, "marker", lambda self, number: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            table.close(fold)
    assert files.exists(spark, table.snapshot(1)) and state() == before and table.closed() == []
    assert table.close(fold) == 1 and state() == before and table.rows().count() == 2
    assert table.close(fold) is None
    write_run(log_rows(spark, ("a", "3", 3), ("c", "1", 3)), table.path, "r3")
    write_run(log_rows(spark, ("a", "1", 1), ("b", "1", 1)), table.path, "r1")
    assert [(k, v) for k, v, *_ in state()] == [("a", "3"), ("b", "1"), ("c", "1")]
    assert table.rows().count() == 4 and table.vacuum() == 0
    after = state()
    assert table.close(fold) == 2 and state() == after
    assert table.vacuum() == 2 and state() == after and files.children(spark, table.path) == ["run=r3"]
    # A run that is not written to its end is not folded.
    log_rows(spark, ("d", "1", 4)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table.path}/run=half")
    assert table.close(fold) is None


def test_close_logs(spark, store):
    row = {"key": "calendar", "last_run": NOW, "status": "ok", "details": "d"}
    for run in ("a", "b"):
        write_run(local_frame(spark, [tuple(row.values())], schemas.STATUS), store.path("status"), run)
    assert close_logs(store) == {"nso_log": None, "ff_log": None, "status": 1}
    assert store.status_log().count() == 1


def test_maintain_changes_no_answer(spark, store):
    for number in (1, 2, 3):
        ingest.ingest(landing(spark, (ISTAT, feeds.rss(item(number), item(number + 1))), batch=number), load_feeds(spark), store, f"r{number}", NOW + dt.timedelta(hours=number))
        enrich.enrich(store, local_frame(spark, [], schemas.LANDING_PAGE), op.keyword_tagger, f"e{number}", NOW, limit=1)
        maintain(store, NOW)
    assert store.press_releases().count() == 4 and store.processed().count() == 3 and store.status_log().count() == 3
    assert ingest.ingest(landing(spark, (ISTAT, feeds.rss(item(2), item(4))), batch=9), load_feeds(spark), store, "r9", NOW).first().inserted == 0


def tries(spark, *rows):
    return local_frame(spark, [("u", provider, "m", NOW + dt.timedelta(minutes=at), error) for provider, at, error in rows], schemas.TRIES)


def test_delays_double_and_end(spark):
    policy = attempts.RetryPolicy(dt.timedelta(minutes=10), max_tries=4)

    def due(rows, minutes):
        row = attempts.release_state(rows, F.lit(NOW + dt.timedelta(minutes=minutes)).cast("timestamp"), policy).first()
        return row.due, row.given_up, row.waiting

    one = tries(spark, ("p", 0, "x"))
    assert due(one, 0) == (True, False, [])
    two = tries(spark, ("p", 0, "x"), ("p", 5, "x"))
    assert due(two, 14) == (False, False, ["p/m"]) and due(two, 15) == (True, False, [])
    three = tries(spark, ("p", 0, "x"), ("p", 5, "x"), ("p", 20, "y"))
    assert due(three, 39)[0] is False and due(three, 40)[0] is True
    folded = attempts.failures(three)
    assert due(folded, 39)[0] is False and due(folded.unionByName(tries(spark, ("p", 50, "z")), allowMissingColumns=True), 9999) == (False, True, ["p/m"])
    assert due(tries(spark, ("p", 0, "x"), ("p", 5, "x"), ("q", 5, "x")), 6) == (True, False, ["p/m"])


def test_a_row_that_fails_is_tried_once_in_a_start_and_given_up(spark, store, tmp_path):
    ingest.ingest(landing(spark, (ISTAT, feeds.rss(item(1)))), load_feeds(spark), store, "r", NOW)
    seen, no_pages = str(tmp_path / "prompts"), local_frame(spark, [], schemas.LANDING_PAGE)

    def broken(prompts):
        prompts.write.mode("append").parquet(seen)
        return op.keyword_tagger(prompts).withColumn("error", F.lit("down"))

    policy = attempts.RetryPolicy(dt.timedelta(hours=1), max_tries=3)
    for start, hours in enumerate((0, 0, 0, 2, 9)):
        landing_time = NOW + dt.timedelta(hours=hours)
        jobs.enrich_stream(spark, store, lambda: no_pages, broken, str(tmp_path / f"cp{start}"), clock=lambda t=landing_time: t, policy=policy).awaitTermination()
    assert spark.read.parquet(seen).count() == 3
    assert [row.reason for row in store.quarantine().orderBy("reason").collect()] == ["down", "down", "gave_up:down"]
    enrich.close_attempts(store, NOW, policy)
    assert store.retry().count() == 0 and store.attempts().rows().first().failures == 3


def test_paid_answers_survive(spark, store, tmp_path, monkeypatch):
    ingest.ingest(landing(spark, (ISTAT, feeds.rss(item(1), item(2)))), load_feeds(spark), store, "r", NOW)
    seen, no_pages = str(tmp_path / "prompts"), local_frame(spark, [], schemas.LANDING_PAGE)

    def paid(prompts):
        prompts.write.mode("append").parquet(seen)
        return op.keyword_tagger(prompts)

    with monkeypatch.context() as patch:
        patch.setattr(enrich.op, "choose_answers", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            enrich.enrich(store, no_pages, paid, "e", NOW)
    assert tuple(enrich.enrich(store, no_pages, paid, "e", NOW).first()) == (2, 2, 0)
    assert spark.read.parquet(seen).count() == 2 and store.processed().count() == 2


def test_drain_stores_and_ends(spark, store):
    fields = {"url_hash": None, "title": None, "title_en": None}
    rows = [(f"h{i}", "" if i == 4 else f"t{i}", "x" if i == 0 else None) for i in range(6)]
    frame = local_frame(spark, rows, schemas.struct("url_hash string, title string, title_en string"))
    whole = frame.select(*[F.col(f.name) if f.name in fields else F.lit(NOW if f.name == "published" else None).cast(f.dataType).alias(f.name) for f in schemas.PROCESSED.fields])
    append_releases(whole, store.path("processed"))

    def translate(prompts):
        return prompts.select("url_hash", F.lit(0).alias("rank"), F.struct(F.when(F.col("url_hash") == "h3", " ").otherwise(F.concat(F.lit(" T"), "url_hash")).alias("title_en")).alias("answer"),
                              F.when(F.col("url_hash") == "h2", "down").alias("error"))

    assert tuple(enrich.drain_titles(store, translate, "d1", NOW, batch_size=1).first())[:2] == (4, 2)
    later = NOW + dt.timedelta(days=1)
    assert tuple(enrich.drain_titles(store, translate, "d2", later).first())[:2] == (2, 0)
    state = {row.url_hash: (row.title_en, row.updated_at) for row in store.processed().collect()}
    assert state == {"h0": ("x", None), "h1": ("Th1", NOW), "h2": (None, None), "h3": (None, None), "h4": (None, None), "h5": ("Th5", NOW)}
    assert {row.url_hash for row in store.processed().where(f"{MONTH} = '2025-07' AND title_en = 'Th5'").collect()} == {"h5"}
    assert store.status_log().where("key = 'titles'").count() == 2
    assert tuple(enrich.drain_titles(store, lambda p: translate(p).withColumn("error", F.lit(None).cast("string")), "d3", later + dt.timedelta(days=1)).first())[:2] == (2, 1)
    assert {row.title_en for row in store.processed().collect()} == {"x", "Th1", "Th2", None, "Th5"}


def test_small_batches_of_a_drain_share_a_job(spark, store, monkeypatch):
    rows = local_frame(spark, [(f"h{i}", f"t{i}") for i in range(90)], schemas.struct("url_hash string, title string"))
    whole = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(NOW if f.name == "published" else None).cast(f.dataType).alias(f.name) for f in schemas.PROCESSED.fields])
    append_releases(whole, store.path("processed"))
    asked = []

    def translate(prompts):
        asked.append(prompts.count())
        return prompts.select("url_hash", F.lit(0).alias("rank"), F.struct(F.concat(F.lit("T"), "url_hash").alias("title_en")).alias("answer"), F.lit(None).cast("string").alias("error"))

    done = enrich.drain_titles(store, translate, "d", NOW, batch_size=1).first()
    assert (done.open, done.translated) == (90, 90) and done.batches > 5
    assert asked == [90]
    monkeypatch.setattr(enrich, "DRAIN_ROWS", 32)
    monkeypatch.setattr(enrich, "untitled", lambda processed: processed)
    assert enrich.drain_titles(store, translate, "again", NOW + dt.timedelta(days=1), batch_size=1).first().translated == 90
    assert sum(asked[1:]) == 90 and max(asked[1:]) <= 32
    assert {row.title_en for row in store.processed().collect()} == {f"Th{i}" for i in range(90)}


@pytest.mark.parametrize(("pattern", "expected"), [
    ("inflation", ["inflation"]), ("cons.* prices", ["cons", " prices"]), ("ab+c", ["ab", "c"]), ("abc?d", ["ab", "d"]), ("a{2}bcd", ["bcd"]), (r"3\.5", ["3.5"]),
    (r"\bgdp\b", ["gdp"]), ("x|inflation", []), ("(abc)?def", []), ("[ab]cde", ["cde"]), (r"[\]x]cde", []), (r"\x41bcd", []), ("^abc$", ["abc"]),
])
def test_literals(pattern, expected):
    assert trigrams.literals(pattern) == expected


def test_trigram_search_is_the_scan(spark, tmp_path):
    rng = random.Random(6)
    titles = ["Straße in ẞ", "ISTANBUL İstanbul ıstanbul", "ΟΔΟΣ ΟΔΟΣΑ οδος", "ſummer SUMMER", "ab", "", None, "K temperature", "10.3% up", "10x3% up"]
    titles += ["".join(rng.choices("abc .é", k=rng.randint(0, 12))) for _ in range(150)]
    frame = local_frame(spark, [(str(i), title) for i, title in enumerate(titles)], schemas.struct("url_hash string, title string")).withColumn(MONTH, F.lit("2025-01"))
    trigrams.append_postings(frame, str(tmp_path / "index"))
    index = spark.read.schema(f"trigram string, url_hash string, {MONTH} string").parquet(str(tmp_path / "index"))
    for q, mode in [("straße", "regex"), ("istanbul", "regex"), ("οδοσ", "regex"), ("summer", "regex"), ("abc", "regex"), ("a.c", "regex"), ("ab?c a", "regex"), ("abc|cab", "regex"),
                    ("k temp", "regex"), (r"10\.3%", "regex"), ("10.3%", "literal"), ("b. a", "literal"), ("nowhere", "regex")]:
        scan = {row.url_hash for row in frame.where(search.title_matches(F.col("title"), q, mode)).collect()}
        assert {row.url_hash for row in trigrams.search_titles(frame, index, q, mode).collect()} == scan, q


def test_pages_read_the_months_they_need(spark, tmp_path):
    schema = schemas.struct("url_hash string, published timestamp, publisher string")
    rng = random.Random(1)
    rows = [(f"k{i:03d}", None if i % 10 == 0 else dt.datetime(2024, 1 + i % 12, 1 + rng.randrange(27)), f"p{i % 3}") for i in range(300)]
    path = str(tmp_path / "table")
    append_releases(local_frame(spark, rows, schema), path)
    ordered = sorted(rows, key=lambda row: (row[1] is None, -(row[1] or dt.datetime(1970, 1, 1)).timestamp(), row[0]))
    for filters in ({}, {"publisher": "p1"}):
        expected = [row[0] for row in ordered if not filters or row[2] == "p1"]
        spec, cursor, found = search.SearchSpec(filters, limit=23), None, []
        while True:
            page = pages.newest_page(spark, path, with_month(schema), spec, ["publisher"], cursor)
            keys = [row.url_hash for row in page.collect()]
            if not found:
                assert {re.search(r"pub_month=([^/]+)", one)[1] for one in page.inputFiles()} <= {f"2024-{month:02d}" for month in range(6 if filters else 10, 13)}
            if not keys:
                break
            found += keys
            cursor = pages.cursor_of(page)
        assert found == expected
    spec = search.SearchSpec(date_from=dt.datetime(2024, 3, 10), date_to=dt.datetime(2024, 4, 5), limit=50)
    page = pages.newest_page(spark, path, with_month(schema), spec, [])
    assert [row.url_hash for row in page.collect()] == [row[0] for row in ordered if row[1] and spec.date_from <= row[1] < spec.date_to]
    assert pages.newest_page(spark, str(tmp_path / "none"), with_month(schema), spec, []).count() == 0


def test_rollup_counts(spark):
    schema = schemas.struct("url_hash string, published timestamp, topic string")
    rng = random.Random(3)
    rows = [(str(i), None if i % 9 == 0 else dt.datetime(2024, rng.randint(1, 12), rng.randint(1, 28), rng.randrange(24)), rng.choice("ab")) for i in range(400)]
    frame = local_frame(spark, rows, schema).withColumn(MONTH, F.coalesce(F.date_format("published", "yyyy-MM"), F.lit(schemas.UNDATED)))
    counts = rollup.rollup_of(frame, ["topic"])
    day = dt.datetime
    for spec in [search.SearchSpec(), search.SearchSpec({"topic": "a"}), search.SearchSpec({}, day(2024, 3, 1), day(2024, 6, 1)), search.SearchSpec({}, day(2024, 3, 2), None),
                 search.SearchSpec({"topic": "b"}, None, day(2024, 5, 30)), search.SearchSpec({}, day(2024, 5, 3), day(2024, 5, 9), True), search.SearchSpec({}, day(2024, 1, 1), day(2024, 5, 31), True)]:
        assert rollup.count_by_rollup(frame, counts, spec, ["topic"]).first().total == search.count_matching(frame, spec, ["topic"]).first().total, spec
    assert rollup.cut_months(search.SearchSpec({}, day(2024, 3, 1), day(2024, 5, 31), True)) == []


def test_template_text(spark):
    page = "<html><head><title>{0}</title><style>p {{}}</style></head><body><nav><a>Home</a> | <a>News</a></nav><p>own text {0}</p><p>Shared</p><script>x</script><footer>Imprint</footer></body></html>"
    rows = [(i, "big.example", page.format(i)) for i in range(8)] + [(20, "small.example", page.format(20)), (21, None, "<p>x"), (22, "big.example", None), (23, "big.example", "")]
    frame = local_frame(spark, rows, schemas.struct("page_id int, host string, html string"))
    found = {row.page_id: (row.own_text, row.n_template) for row in templates.own_text(frame).collect()}
    assert found[3] == ("3\nown text 3", 3) and found[20] == ("20\nHome | News\nown text 20\nShared\nImprint", 0)
    assert found[22] == found[23] == ("", 0) and found[21] == ("x", 0)


def test_model_calls_overlap_under_limits(spark):
    prompts = local_frame(spark, [(str(i), f"p{i}") for i in range(12)], schemas.struct("url_hash string, prompt string")).coalesce(1)

    source = [("a", "slow"), ("b", "fast")]
    gates = {"calls": 6, "per_provider": 3, "seconds": 1.0}

    def attempts_of(batches):
        # Locks do not travel: the worker makes its own.
        rows = op.cascade_rows(made(), source, **gates)
        for batch in batches:
            yield pd.DataFrame(rows(batch), columns=op.ATTEMPTS.names)

    def made():
        lock, active = threading.Lock(), []

        def call(prompt, provider, model):
            with lock:
                active.append(provider)
                most = active.count(provider)
            time.sleep(3 if (model, prompt) == ("slow", "p3") else 0.2)
            with lock:
                active.remove(provider)
            if model == "slow" and int(prompt[1:]) % 2:
                raise ValueError("no")
            return {"topic": str(most), "country": model, "sentiment": "", "title_en": prompt, "summary_en": "", "key_figures": ""}

        return call

    began = time.time()
    rows = prompts.withColumn("waiting", F.when(F.col("url_hash") == "5", F.array(F.lit("a/slow")))).mapInPandas(attempts_of, op.ATTEMPTS).collect()
    took = time.time() - began
    by_row = {}
    for row in rows:
        by_row.setdefault(int(row.url_hash), []).append((row["rank"], row.error, row.answer and row.answer.country))
    assert all(by_row[i] == [(0, None, "slow")] for i in range(0, 12, 2))
    assert by_row[1] == [(0, "ValueError: no", None), (1, None, "fast")] and by_row[5] == [(1, None, "fast")]
    assert by_row[3][0][1].startswith("TimeoutError") and by_row[3][1] == (1, None, "fast")
    peaks = {row.provider: max(int(one.answer.topic) for one in rows if one.answer and one.provider == row.provider) for row in rows if row.answer}
    assert 1 < peaks["a"] <= 3 and peaks["b"] <= 3 and took < 30


def test_change_feed(spark, tmp_path):
    schema, folder = schemas.STATUS, str(tmp_path / "log")
    batches = [[("a", 1, "ok", "1"), ("a", 2, "ok", "1"), ("b", 1, "ok", None)], [("a", 3, "ok", "1"), ("a", 4, "partial", "1"), ("b", 2, "ok", None)], [("a", 2, "old", "late"), ("a", 5, "ok", "1")]]
    for batch in batches:
        local_frame(spark, [(k, NOW + dt.timedelta(hours=at), s, d) for k, at, s, d in batch], schema).write.mode("append").parquet(folder)
        feed = jobs.changes_stream(jobs.file_stream(spark, folder, schema))
        jobs.start(feed.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"), None).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((row.key, (row.last_run - NOW).seconds // 3600, row.status) for row in out) == [("a", 1, "ok"), ("a", 4, "partial"), ("a", 5, "ok"), ("b", 1, "ok")]


def test_content_names(spark):
    one = landing(spark, (ISTAT, "a"), (ISTAT_2, "b"))
    other = landing(spark, (ISTAT_2, "b"), (ISTAT, "a"))
    names = schemas.LANDING_FEED.names
    assert content_name(one, *names) == content_name(other, *names) != content_name(landing(spark, (ISTAT, "a")), *names)
    assert Store(spark, "/a").release_keys().digits == 2
