"""Queries over stored tables that several runs have written: indexes, ledgers, generations, corrections, rollups."""

from __future__ import annotations

import datetime as dt
import tomllib

from pyspark.sql import functions as F

from gazette import schemas
from gazette.catalog.base import RELEASES_SQL, dealt, query, releases, table
from gazette.catalog.bodies import LINES_SQL, feed_landing
from gazette.catalog.calendars import NAMES_SQL, SOURCE_SQL, SOURCES, STATUS_SQL, VIEW_SQL, status_log, view
from gazette.functions import display
from gazette.functions.htmltext import url_host
from gazette.functions.sqltext import lookup
from gazette.operators import enrich as op
from gazette.operators import pages, rollup, search, status, templates, trigrams
from gazette.operators.attempts import RetryPolicy, failures
from gazette.plans import collect, enrich, ingest
from gazette.plans.logs import close_logs
from gazette.schemas import MONTH, PRESS_RELEASES, PROCESSED
from gazette.session import prepare, work_dir
from gazette.sources import config, months
from gazette.sources.files import CODEC
from gazette.sources.tables import Store, append_releases, month_of, read, with_month, write_run
from gazette.streaming import jobs

NOON = dt.datetime(2024, 12, 31, 12)
#: Whether a body was there before: feed, text, and the day that its stamps are made from.
BODY_SQL = "concat(substr(source, 4)::INT % 12, ' ', doc_id % 300, ' ', text)"


@query(f"""WITH {LINES_SQL}, bodies AS (SELECT doc_id, {BODY_SQL} AS body, len(string_split(text, chr(10))) AS entries FROM documents),
    old AS (SELECT DISTINCT body FROM bodies WHERE doc_id % 2 = 0), first_lines AS (SELECT DISTINCT line FROM lines WHERE doc_id % 2 = 0),
    polls AS (SELECT 1 AS poll, count(*) AS bodies, 0 AS unchanged, sum(entries) AS entries, (SELECT count(*) FROM first_lines) AS inserted FROM bodies WHERE doc_id % 2 = 0
    UNION ALL SELECT 2, count(*), count(*) FILTER (WHERE body IN (SELECT body FROM old)), sum(entries),
    (SELECT count(DISTINCT line) FROM lines) - (SELECT count(*) FROM first_lines) FROM bodies)
    SELECT poll, bodies, unchanged, CAST(entries AS BIGINT) AS entries, inserted, CAST(entries AS BIGINT) - inserted AS skipped, 0 AS errors,
    CASE poll WHEN 1 THEN 0 ELSE (SELECT count(*) FROM bodies WHERE body NOT IN (SELECT body FROM old)) END AS parsed_again FROM polls""")
def ingest_repoll(spark, sf_dir):
    """Two polls, the second with all that the first had and as much again: bodies that did not change are counted and not parsed."""
    prepare(spark)
    store = Store(spark, f"{work_dir(spark, 'repoll')}/store", digits=1)
    landing = feed_landing(spark, sf_dir)
    feeds = config.load_feeds(spark)
    ingest.ingest(landing.where("batch_id % 2 = 0"), feeds, store, "first", NOON)
    ingest.ingest(landing, feeds, store, "second", NOON + dt.timedelta(minutes=5))
    polls = store.polls().withColumn("poll", F.when(F.col("polled") == F.lit(NOON).cast("timestamp_ntz"), 1).otherwise(2))
    return polls.select("poll", *schemas.POLL.names[1:], F.when(F.col("poll") == 1, 0).otherwise(F.col("bodies") - F.col("unchanged")).alias("parsed_again"))


@query(f"""WITH {LINES_SQL}, firsts AS (SELECT line, min(doc_id % 2) AS start FROM lines GROUP BY line),
    runs AS (SELECT start, count(*) || ' new releases, 1 agency errors' AS details FROM firsts GROUP BY start)
    SELECT 2 AS quarantined, 2 AS runs, (SELECT count(*) FROM firsts) AS releases, string_agg(details, ';' ORDER BY details) AS details FROM runs""")
def stream_ingest_restart(spark, sf_dir):
    """The ingest stream, started again with a new checkpoint on a second landing: quarantine and status keep what the first start wrote."""
    prepare(spark)
    folder = work_dir(spark, "restart")
    store = Store(spark, f"{folder}/store", digits=1)
    landing = feed_landing(spark, sf_dir)
    for number in (0, 1):
        bad = config.local_frame(spark, [(f"https://nowhere.example/{number}", NOON, number, "no feed")], schemas.LANDING_FEED)
        landing.where(f"batch_id % 2 = {number}").unionByName(bad).write.parquet(f"{folder}/landing-{number}", compression=CODEC)
        jobs.ingest_stream(
            spark, f"{folder}/landing-{number}", lambda: config.load_feeds(spark), store, f"{folder}/checkpoint-{number}", clock=lambda n=number: NOON + dt.timedelta(hours=n),
        ).awaitTermination()
    counts = [
        store.quarantine().agg(F.count("*").cast("int").alias("quarantined")), store.press_releases().agg(F.count("*").alias("releases")),
        store.status_log().agg(F.count("*").cast("int").alias("runs"), F.array_join(F.array_sort(F.collect_set("details")), ";").alias("details")),
    ]
    one = counts[0].withColumn("one", F.lit(1))
    for other in counts[1:]:
        one = one.join(other.withColumn("one", F.lit(1)), "one")
    return one.select("quarantined", "runs", "releases", "details")


@query(f"""WITH rows AS (SELECT {SOURCE_SQL} AS source, event_type || ' ' || (user_id % 50) AS title, date_trunc('day', ts) AS release_dt,
    CASE WHEN value >= 30 THEN props END AS url, props, ts, event_id FROM events WHERE event_type <> 'purchase')
    SELECT source, title, release_dt, arg_max_null(url, (ts, event_id)) AS url, arg_max(props, (ts, event_id)) AS reference_period, min(ts) AS first_seen
    FROM rows WHERE release_dt >= TIMESTAMP '2024-01-05' AND release_dt < TIMESTAMP '2024-01-21' AND regexp_matches(title, '(?i)VIEW|click 1')
    GROUP BY source, title, release_dt ORDER BY release_dt, source, title LIMIT 500""")
def stored_calendar_search(spark, sf_dir):
    """Runs written, a generation closed, more runs, a second one closed and the old folders removed, a last run: then searched."""
    prepare(spark)
    store = Store(spark, f"{work_dir(spark, 'calendar')}/store", digits=1)
    rows = table(spark, sf_dir, "events").where("event_type <> 'purchase'").select(
        F.expr("concat_ws('|', event_type, user_id % 50, date_trunc('DAY', ts)) AS source_uid"), F.expr(f"{lookup(SOURCES, 'event_type')} AS source"),
        F.expr("concat(event_type, ' ', user_id % 50) AS title"), F.expr("CAST(date_trunc('DAY', ts) AS TIMESTAMP) AS release_dt"),
        F.expr("props AS reference_period"), F.expr("if(value >= 30, props, NULL) AS url"), F.expr("CAST(ts AS TIMESTAMP) AS seen_at"),
        F.expr("event_id AS batch_ord"), F.expr("event_id % 5 AS part"),
    )
    for part in range(5):
        write_run(rows.where(f"part = {part}").select(*schemas.NSO_LOG.names), store.path("nso_log"), f"run-{part}", ["release_dt"])
        if part in (1, 3):
            close_logs(store)
            store.nso().vacuum()
    hits = search.search_calendar(collect.unified(store), date_from=dt.datetime(2024, 1, 5), date_to=dt.datetime(2024, 1, 20), q="VIEW|click 1")
    return hits.selectExpr("source", "title", "CAST(release_dt AS TIMESTAMP_NTZ) AS release_dt", "url", "reference_period", "CAST(first_seen AS TIMESTAMP_NTZ) AS first_seen")


def processed_rows(spark, sf_dir):
    """Releases as processed rows whose English title is missing unless they are English; the key is the document's number."""
    known = {"url_hash": "CAST(doc_id AS STRING)", "url": "concat('https://x.example/', doc_id)", "title": "title", "publisher": "publisher", "language": "language",
             "published": "CAST(published AS TIMESTAMP)", "title_en": "if(language = 'en', title, NULL)", "topic": "'GDP'", "country": "'Italy'", "sentiment": "if(doc_id % 3 = 0, 'positive', 'neutral')"}
    return releases(spark, sf_dir).select(*[F.expr(known.get(field.name, "NULL")).cast(field.dataType).alias(field.name) for field in PROCESSED.fields])


def prefix_translator(prompts):
    """Stand-in translator; every seventh title fails, as a model may."""
    return prompts.selectExpr(
        "url_hash", "'p' AS provider", "'m' AS model", "0 AS rank",
        "named_struct('title_en', concat(' EN ', substr(prompt, 8), ' ')) AS answer", "if(CAST(url_hash AS BIGINT) % 7 = 0, 'failed', NULL) AS error",
    )


@query(f"""WITH {RELEASES_SQL}, open AS (SELECT count(*) FILTER (WHERE language <> 'en' AND trim(title) <> '') AS open,
    count(*) FILTER (WHERE language <> 'en' AND trim(title) <> '' AND doc_id % 7 <> 0) AS translated FROM releases)
    SELECT doc_id, CASE WHEN language = 'en' THEN title WHEN trim(title) <> '' AND doc_id % 7 <> 0 THEN trim('EN ' || title) END AS title_en,
    CASE WHEN language <> 'en' AND trim(title) <> '' AND doc_id % 7 <> 0 THEN TIMESTAMP '2024-06-01' END AS updated_at,
    open.open AS first_open, translated AS first_translated, open.open - translated AS second_open, 0 AS second_translated FROM releases, open""")
def stored_backfill(spark, sf_dir):
    """Missing titles of stored releases drained in batches, twice: the second drain finds the failed ones alone, and changes nothing."""
    prepare(spark)
    store = Store(spark, f"{work_dir(spark, 'backfill')}/store", digits=1)
    append_releases(processed_rows(spark, sf_dir), store.path("processed"))
    first = enrich.drain_titles(store, prefix_translator, "drain", dt.datetime(2024, 6, 1), batch_size=400).first()
    second = enrich.drain_titles(store, prefix_translator, "drain", dt.datetime(2024, 6, 2), batch_size=400).first()
    return store.processed().select(
        F.col("url_hash").cast("bigint").alias("doc_id"), "title_en", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        F.lit(first.open).alias("first_open"), F.lit(first.translated).alias("first_translated"),
        F.lit(second.open).alias("second_open"), F.lit(second.translated).alias("second_translated"),
    )


def release_rows(spark, sf_dir):
    """Releases in the form of the stored table; the key is the document's number."""
    return releases(spark, sf_dir).selectExpr(
        "CAST(doc_id AS STRING) AS url_hash", "concat('https://x.example/', doc_id) AS url", "title", "concat(language, ' summary') AS summary", "publisher",
        "publisher AS publisher_full", "language AS feed_label", "language", "CAST(published AS TIMESTAMP) AS published", "timestamp'2024-12-31 12:00:00' AS fetched_at",
        "array(language) AS tags", "named_struct('batch_id', doc_id, 'agency_ord', 0, 'feed_ord', 0, 'entry_pos', 0) AS ingest_seq",
    ).select(*PRESS_RELEASES.names)


MODELS = [("one", "small"), ("two", "large")]


def flaky(prompts):
    """Two models, each down for most releases; a model that is waiting is not asked, the second only after the first failed."""
    answer = "named_struct('topic', 'GDP', 'country', 'Italy', 'sentiment', 'neutral', 'title_en', 't', 'summary_en', 's', 'key_figures', '')"
    every = None
    for rank, ((provider, model), own) in enumerate(zip(MODELS, (3, 5))):
        asked = f"NOT array_contains(waiting, '{provider}/{model}')" + ("" if rank == 0 else " AND CAST(url_hash AS BIGINT) % 3 <> 0")
        rows = prompts.where(asked).selectExpr(
            "url_hash", f"'{provider}' AS provider", f"'{model}' AS model", f"{rank} AS rank",
            f"if(CAST(url_hash AS BIGINT) % {own} = 0, {answer}, NULL) AS answer", f"if(CAST(url_hash AS BIGINT) % {own} = 0, NULL, 'down') AS error")
        every = rows if every is None else every.unionByName(rows)
    return every


@query("""SELECT doc_id, doc_id % 3 = 0 OR doc_id % 5 = 0 AS processed, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 1 ELSE 6 END AS failures,
    CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 0 ELSE 3 END AS quarantined, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS given_up FROM documents""")
def enrich_retry(spark, sf_dir):
    """Enrichment with models that are down, at five times: the first retry at once, the next after an hour, then the last stop.

    The run at one o'clock finds nobody due, the one at three nobody who is not given up. Folding the ledger in between changes nothing.
    """
    prepare(spark)
    store = Store(spark, f"{work_dir(spark, 'retry')}/store", digits=1)
    append_releases(release_rows(spark, sf_dir), store.path("press_releases"))
    no_pages = config.local_frame(spark, [], schemas.LANDING_PAGE)
    policy = RetryPolicy(dt.timedelta(hours=1), max_tries=3)
    for minutes in (0, 30, 60, 120, 180):
        now = dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minutes)
        enrich.enrich(store, no_pages, flaky, "cycle", now, policy=policy)
        if minutes == 60:
            enrich.close_attempts(store, now, policy)
    tries = failures(store.attempts().rows()).groupBy("url_hash").agg(F.sum("failures").alias("failures"), F.min(F.col("failures") >= 3).alias("given_up"))
    faults = store.quarantine().groupBy(F.col("raw").alias("url")).agg(F.count("*").alias("quarantined"), F.max(F.col("reason").startswith("gave_up:")).alias("stopped"))
    rows = store.press_releases().select("url_hash", "url").join(store.processed().select("url_hash", F.lit(True).alias("processed")), "url_hash", "left").join(tries, "url_hash", "left").join(faults, "url", "left")
    return rows.select(
        F.col("url_hash").cast("bigint").alias("doc_id"), F.coalesce("processed", F.lit(False)).alias("processed"), F.coalesce("failures", F.lit(0)).alias("failures"),
        F.coalesce("quarantined", F.lit(0)).alias("quarantined"), (F.coalesce("given_up", F.lit(False)) & F.coalesce("stopped", F.lit(False))).alias("given_up"),
    )


@query("""SELECT 'some' AS run, least(count(*), 40) AS attempted, least(count(*), 40) AS processed, 0 AS failed FROM documents
    UNION ALL SELECT 'all', count(*) - least(count(*), 40), count(*) - least(count(*), 40), 0 FROM documents""")
def enrich_backlog(spark, sf_dir):
    """The oldest forty pending releases, and then all that are left in one run."""
    prepare(spark)
    store = Store(spark, f"{work_dir(spark, 'backlog')}/store", digits=1)
    append_releases(release_rows(spark, sf_dir), store.path("press_releases"))
    no_pages = config.local_frame(spark, [], schemas.LANDING_PAGE)
    totals = [enrich.enrich(store, no_pages, op.keyword_tagger, name, NOON, limit).select(F.lit(name).alias("run"), "*") for name, limit in (("some", 40), ("all", None))]
    return totals[0].unionByName(totals[1])


def offline_model(prompt: str, provider: str, model: str) -> dict:
    """A model that knows only prompts whose length its name's length divides."""
    if len(prompt) % len(model):
        raise ValueError("cannot say")
    return {"topic": "GDP", "country": "Italy", "sentiment": "neutral", "title_en": prompt[7:27], "summary_en": str(len(prompt)), "key_figures": ""}


def _preferred() -> list[tuple[str, str]]:
    with open(config.CONF / "models.toml", "rb") as file:
        return [(one["provider"], one["model"]) for one in tomllib.load(file)["cascades"]["default"]["entries"]]


CHOSEN_SQL = "CASE " + " ".join(f"WHEN n % {len(model)} = 0 THEN '{provider}/{model}'" for provider, model in _preferred()) + " END"
FIRST_SQL = "CASE " + " ".join(f"WHEN n % {len(model)} = 0 THEN {rank}" for rank, (_, model) in enumerate(_preferred())) + f" ELSE {len(_preferred())} END"


@query(f"""WITH prompts AS (SELECT doc_id, 'Title: ' || split_part(text, chr(10), 1) AS prompt, length('Title: ' || split_part(text, chr(10), 1)) AS n FROM documents)
    SELECT doc_id, {CHOSEN_SQL} AS model, CASE WHEN {CHOSEN_SQL} IS NOT NULL THEN substring(prompt, 8, 20) END AS title_en,
    CASE WHEN {CHOSEN_SQL} IS NOT NULL THEN CAST(n AS VARCHAR) END AS summary_en, {FIRST_SQL} AS failures,
    CASE WHEN {CHOSEN_SQL} IS NULL THEN 'ValueError: cannot say' END AS fault FROM prompts""")
def model_cascade(spark, sf_dir):
    """The configured preference list with an offline model behind each name, calls overlapping inside a batch."""
    preferences = [(row.provider, row.model) for row in config.load_preferences(spark).orderBy("rank").collect()]
    prompts = dealt(releases(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("url_hash"), op.title_prompt(F.col("title")).alias("prompt"))
    attempts = op.model_cascade(offline_model, preferences)(prompts)
    chosen = op.choose_answers(attempts, config.EXTRACTION_DOMAINS, config.EXTRACTION_TEXTS, F.count("error").cast("int").alias("failures"))
    return chosen.where("url_hash IS NOT NULL").select(
        F.col("url_hash").cast("bigint").alias("doc_id"), F.concat(F.col("chosen.provider"), F.lit("/"), F.col("chosen.model")).alias("model"),
        "chosen.answer.title_en", "chosen.answer.summary_en", "failures", "fault",
    )


TITLE_PATTERNS = {"regex": "(?:en)+ l[ae]", "plain": "ion de", "class": "th[aeiou]r on", "short": "e.", "literal": "a. "}


@query(f"""WITH {RELEASES_SQL} SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS search, doc_id FROM releases WHERE " + (f"contains(lower(title), '{q}')" if name == "literal" else f"regexp_matches(title, '(?i){q}')")
    + " AND published >= TIMESTAMP '2024-03-05' AND published < TIMESTAMP '2024-09-10'" for name, q in TITLE_PATTERNS.items()) + ")")
def indexed_title_search(spark, sf_dir):
    """Titles by pattern through the trigram index of the months asked for; patterns without a literal stretch by the scan."""
    folder = work_dir(spark, "trigrams")
    rows = releases(spark, sf_dir).select("doc_id", "title", "published")
    append_releases(rows, f"{folder}/releases", "doc_id")
    stored = read(spark, f"{folder}/releases", with_month(rows.schema))
    trigrams.append_postings(stored, f"{folder}/trigrams", "doc_id")
    index = spark.read.schema(f"trigram string, doc_id bigint, {MONTH} string").parquet(f"{folder}/trigrams")
    spec = search.SearchSpec(date_from=dt.datetime(2024, 3, 5), date_to=dt.datetime(2024, 9, 10))
    found = None
    for name, q in TITLE_PATTERNS.items():
        asked = index.where(F.col(MONTH).between("2024-03", "2024-09"))
        hits = trigrams.search_titles(search.matching(stored, spec, search.RAW_FIELDS), asked, q, "literal" if name == "literal" else "regex", "doc_id")
        hits = hits.select(F.lit(name).alias("search"), "doc_id")
        found = hits if found is None else found.unionByName(hits)
    return found


@query(f"""WITH {RELEASES_SQL}, ordered AS (SELECT doc_id, published, row_number() OVER (ORDER BY published DESC NULLS LAST, doc_id) AS n FROM releases
    WHERE publisher IN ('src1', 'src2', 'src3', 'src5', 'src7')) SELECT CAST((n - 1) // 60 + 1 AS INTEGER) AS page, doc_id, published FROM ordered WHERE n <= 180""")
def newest_pages(spark, sf_dir):
    """Three result pages, each from where the last one ended; months are read only until a page is full."""
    path = f"{work_dir(spark, 'pages')}/releases"
    rows = releases(spark, sf_dir).select("doc_id", "publisher", "published")
    append_releases(rows, path, "doc_id")
    spec = search.SearchSpec({"publisher": ["src1", "src2", "src3", "src5", "src7"]}, limit=60)
    found, cursor = None, None
    for number in (1, 2, 3):
        page = pages.newest_page(spark, path, with_month(rows.schema), spec, search.RAW_FIELDS, cursor, "doc_id")
        cursor = pages.cursor_of(page, "doc_id") or cursor
        page = page.select(F.lit(number).alias("page"), "doc_id", "published")
        found = page if found is None else found.unionByName(page)
    return found


COUNT_SPECS = {
    "all": search.SearchSpec(), "field": search.SearchSpec({"publisher": ["src1", "src4"], "sentiment": "positive"}),
    "cut": search.SearchSpec({"sentiment": "neutral"}, dt.datetime(2024, 2, 10), dt.datetime(2024, 8, 20)),
    "whole": search.SearchSpec({}, dt.datetime(2024, 2, 1), dt.datetime(2024, 7, 31), inclusive_to=True),
    "inside": search.SearchSpec({"publisher": "src2"}, dt.datetime(2024, 5, 3), dt.datetime(2024, 5, 20)),
}


@query(f"""WITH {RELEASES_SQL}, rows AS (SELECT publisher, published, CASE WHEN doc_id % 3 = 0 THEN 'positive' ELSE 'neutral' END AS sentiment FROM releases)
    SELECT 'all' AS search, count(*) AS total FROM rows UNION ALL SELECT 'field', count(*) FROM rows WHERE publisher IN ('src1', 'src4') AND sentiment = 'positive'
    UNION ALL SELECT 'cut', count(*) FROM rows WHERE sentiment = 'neutral' AND published >= TIMESTAMP '2024-02-10' AND published < TIMESTAMP '2024-08-20'
    UNION ALL SELECT 'whole', count(*) FROM rows WHERE published >= TIMESTAMP '2024-02-01' AND published < TIMESTAMP '2024-08-01'
    UNION ALL SELECT 'inside', count(*) FROM rows WHERE publisher = 'src2' AND published >= TIMESTAMP '2024-05-03' AND published < TIMESTAMP '2024-05-20'""")
def rollup_count(spark, sf_dir):
    """Counts after three runs, one of them repeated: whole months from the rollup, the months that a range cuts from the rows."""
    folder = work_dir(spark, "rollup")
    rows = processed_rows(spark, sf_dir)
    for run in (0, 1, 2, 1):
        some = rows.where(F.col("url_hash").cast("bigint") % 3 == run)
        dated = some.withColumn(MONTH, month_of(F.col("published")))
        write_run(rollup.rollup_of(dated, search.PROCESSED_FIELDS), f"{folder}/rollup", f"run-{run}")
    append_releases(rows, f"{folder}/processed")
    stored = read(spark, f"{folder}/processed", with_month(PROCESSED))
    counted = read(spark, f"{folder}/rollup", rollup.rollup_schema(search.PROCESSED_FIELDS))
    found = None
    for name, spec in COUNT_SPECS.items():
        one = rollup.count_by_rollup(stored, counted, spec, search.PROCESSED_FIELDS).select(F.lit(name).alias("search"), "total")
        found = one if found is None else found.unionByName(one)
    return found


BLOCKS_SQL = rf"""blocks AS (SELECT page_id, host, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS place FROM (
    SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS host, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(translate(html, chr(13) || chr(10), '  '), '{templates.UNSEEN}', ' ', 'g'), '{templates.BREAKS}', chr(10), 'g'), '{templates.TAGS}', ' ', 'g'),
    chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM pages))"""


@query(rf"""WITH {BLOCKS_SQL}, sizes AS (SELECT host, count(DISTINCT page_id) AS all_pages FROM blocks GROUP BY host),
    template AS (SELECT host, block FROM blocks JOIN sizes USING (host) GROUP BY host, block, all_pages HAVING count(DISTINCT page_id) >= 3 AND count(DISTINCT page_id) >= all_pages * 0.3),
    marked AS (SELECT b.*, t.block IS NOT NULL AS template FROM blocks b LEFT JOIN template t ON b.host = t.host AND b.block = t.block)
    SELECT page_id, coalesce(string_agg(block, chr(10) ORDER BY place) FILTER (NOT template), '') AS own_text, count(*) FILTER (template) AS n_template
    FROM pages LEFT JOIN marked USING (page_id) GROUP BY page_id""")
def page_text_by_host(spark, sf_dir):
    """What pages say besides the blocks that many pages of their host have."""
    rows = dealt(table(spark, sf_dir, "pages")).select("page_id", url_host(F.col("url")).alias("host"), "html")
    return templates.own_text(rows)


@query(f"""WITH {STATUS_SQL}, ordered AS (SELECT *, lag(status) OVER w AS old_status, lag(details) OVER w AS old_details, row_number() OVER w AS n FROM status
    WINDOW w AS (PARTITION BY key ORDER BY last_run, status, details))
    SELECT key, last_run, status, details FROM ordered WHERE n = 1 OR status <> old_status OR details <> old_details""")
def status_changes(spark, sf_dir):
    """The change feed over a status log that comes in three files: a row goes out only when a pipeline's status is another than before."""
    prepare(spark)
    folder = work_dir(spark, "changes")
    rows = status_log(spark, sf_dir)
    cuts = rows.selectExpr("percentile(unix_seconds(CAST(last_run AS TIMESTAMP)), array(0.33, 0.67)) AS cuts").first().cuts
    part = F.when(F.unix_seconds(F.col("last_run").cast("timestamp")) < cuts[0], 0).when(F.unix_seconds(F.col("last_run").cast("timestamp")) < cuts[1], 1).otherwise(2)
    for number in range(3):
        rows.where(part == number).write.mode("append").parquet(f"{folder}/log")
        feed = jobs.changes_stream(jobs.file_stream(spark, f"{folder}/log", rows.schema))
        writer = feed.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        jobs.start(writer, f"{folder}/checkpoint", None).awaitTermination()
    return spark.read.schema(feed.schema).parquet(f"{folder}/out")


@query("""SELECT doc_id, CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'domain:topic' WHEN lang NOT IN ('de', 'en', 'fr')
    THEN 'domain:country' ELSE 'ok' END AS verdict FROM documents""")
def user_domain_validation(spark, sf_dir):
    """Answers judged by the closed domains of a user's model file."""
    domains = config.load_domains(config.CONF / "example_model.py")
    answer = F.expr("named_struct('topic', source, 'country', lang)")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(op.answer_fault(answer, domains, []), F.lit("ok")).alias("verdict"))


@query("""SELECT count(*) AS attempted, count(*) FILTER (WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4')) AS processed,
    count(*) FILTER (WHERE source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4')) AS failed FROM documents""")
def attempt_totals(spark, sf_dir):
    topics = {"topic": config.load_domains(config.CONF / "example_model.py")["topic"]}
    answer = F.expr("named_struct('topic', source)")
    return status.attempt_totals(table(spark, sf_dir, "documents").select(op.answer_fault(answer, topics, []).alias("fault")))


def _agencies() -> list[tuple[str, str, int]]:
    with open(config.CONF / "feeds.toml", "rb") as file:
        return [(slug, one["name"], len(one["feeds"])) for slug, one in tomllib.load(file).items()]


FEED_NUMBERS = [slug for slug, _, feeds in _agencies() for _ in range(feeds)]
AGENCY_SQL = ", ".join(f"('{slug}', '{name.replace(chr(39), chr(39) * 2)}')" for slug, name, _ in _agencies())


@query(f"""SELECT slug, name, count(doc_id) AS documents FROM (VALUES {AGENCY_SQL}) a(slug, name)
    LEFT JOIN documents d ON [{', '.join(repr(slug) for slug in FEED_NUMBERS)}][substr(d.source, 4)::INT % 12 + 1] = slug GROUP BY slug, name""")
def publisher_list(spark, sf_dir):
    """The configured publishers with the number of documents that come from their feeds."""
    feeds = config.load_feeds(spark)
    rows = feeds.orderBy("agency_ord", "feed_ord").collect()
    numbered = config.local_frame(spark, [(row.publisher, feed) for feed, row in enumerate(rows)], schemas.struct("publisher string, feed int"))
    counts = table(spark, sf_dir, "documents").select((F.expr("CAST(substr(source, 4) AS INT)") % 12).alias("feed")).groupBy("feed").agg(F.count("*").alias("n"))
    found = numbered.join(counts, "feed").groupBy(F.col("publisher").alias("slug")).agg(F.sum("n").alias("n"))
    return config.publishers(feeds).join(found, "slug", "left").select("slug", "name", F.coalesce("n", F.lit(0)).alias("documents"))


MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


@query(f"""SELECT facet, count(*) AS bodies FROM (SELECT [{', '.join(repr(one) for one in MONTH_NAMES)}][doc_id % 12 + 1] || '.2026' AS facet FROM documents)
    WHERE substr(facet, 1, 3) IN ('jun', 'jul', 'aug', 'sep', 'oct', 'nov') GROUP BY facet""")
def month_backfill_pages(spark, sf_dir):
    """Landed month pages that a first run in August 2026 reads: every month since the start and the routine window."""
    wanted = months.month_pages(spark, dt.date(2026, 8, 14), backfill=True)
    facet = F.concat(F.element_at(F.array(*map(F.lit, MONTH_NAMES)), (F.col("doc_id") % 12 + 1).cast("int")), F.lit(".2026"))
    landed = table(spark, sf_dir, "documents").select(facet.alias("facet"))
    return landed.join(wanted.select("facet"), "facet", "left_semi").groupBy("facet").agg(F.count("*").alias("bodies"))


@query(f"""WITH {VIEW_SQL} SELECT source_uid, {NAMES_SQL.replace('code', 'source')} AS source_name, CASE WHEN release_dt < TIMESTAMP '2024-01-15 12:00:00' THEN url END AS link,
    is_ff AND (coalesce(actual, '') <> '' OR source_uid % 4 = 0 OR source_uid % 7 = 0) AS has_values FROM view""")
def calendar_cards(spark, sf_dir):
    """Calendar cards: link once released, and a line of values where there is an actual, a forecast or a previous one."""
    rows = view(spark, sf_dir).withColumns({"forecast": F.when(F.col("source_uid") % 4 == 0, "0.1%"), "previous": F.when(F.col("source_uid") % 7 == 0, "0.2%")})
    past = F.col("release_dt") < F.lit(dt.datetime(2024, 1, 15, 12)).cast("timestamp_ntz")
    return rows.select(
        "source_uid", display.source_name("source").alias("source_name"), display.card_link(past, F.col("url")).alias("link"),
        display.has_values(F.col("is_ff"), F.col("actual"), F.col("forecast"), F.col("previous")).alias("has_values"),
    )
