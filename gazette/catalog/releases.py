"""Dedup, backlog, search and count queries over releases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gazette.catalog.base import dealt, PROCESSED_SQL, RELEASES_SQL, processed, query, releases, table
from gazette.functions import display, text
from gazette.operators import dedup, enrich, search, status
from gazette.operators.search import SearchSpec

# Python's white space, as RE2 spells it.
SPACE_RE2 = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"""WITH {RELEASES_SQL} SELECT url_hash, min(doc_id) AS doc_id, arg_min(publisher, doc_id) AS publisher,
    arg_min(language, doc_id) AS language FROM releases GROUP BY url_hash""")
def dedup_first_writer(spark, sf_dir):
    rows = releases(spark, sf_dir).select("url_hash", "doc_id", "publisher", "language")
    return dedup.first_writer(rows, "url_hash", "doc_id")


@query(f"""WITH {RELEASES_SQL} SELECT url_hash, min(doc_id) AS doc_id, arg_min(publisher, doc_id) AS publisher FROM releases
    WHERE url_hash NOT IN (SELECT r.url_hash FROM releases r JOIN labels USING (doc_id)) GROUP BY url_hash""")
def insert_if_absent(spark, sf_dir):
    batch = releases(spark, sf_dir).select("url_hash", "doc_id", "publisher")
    return dedup.insert_if_absent(batch, processed(spark, sf_dir), "url_hash", "doc_id")


@query(f"""WITH {RELEASES_SQL}, known AS (SELECT DISTINCT r.url_hash FROM releases r JOIN labels USING (doc_id)),
    fresh AS (SELECT count(DISTINCT url_hash) AS n FROM releases WHERE url_hash NOT IN (SELECT url_hash FROM known))
    SELECT n AS inserted, (SELECT count(*) FROM releases) - n AS skipped FROM fresh""")
def insert_summary(spark, sf_dir):
    batch = releases(spark, sf_dir).select("url_hash")
    return dedup.insert_summary(batch, processed(spark, sf_dir), "url_hash")


@query(f"""WITH {RELEASES_SQL}, firsts AS (SELECT url_hash, arg_min(publisher, doc_id) AS publisher,
    arg_min(language, doc_id) AS feed_label FROM releases GROUP BY url_hash)
    SELECT publisher, feed_label, count(*) AS entries FROM firsts GROUP BY ROLLUP (publisher, feed_label)""")
def dedup_cross_feed_counts(spark, sf_dir):
    firsts = dedup_first_writer(spark, sf_dir).withColumnRenamed("language", "feed_label")
    return status.entry_counts(firsts)


@query(f"WITH {RELEASES_SQL} SELECT url_hash, count(*) AS n FROM releases GROUP BY url_hash HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return dedup.duplicate_keys(releases(spark, sf_dir), "url_hash")


@query(f"""WITH {RELEASES_SQL} SELECT doc_id, url_hash, publisher, language FROM releases
    ANTI JOIN labels USING (doc_id)""")
def pending_releases(spark, sf_dir):
    raw = releases(spark, sf_dir).select("doc_id", "url_hash", "publisher", "language")
    return enrich.pending(raw, table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH {RELEASES_SQL} SELECT doc_id, ingest_seq, publisher FROM (SELECT doc_id, doc_id AS ingest_seq, publisher FROM releases)
    ANTI JOIN labels USING (doc_id) ORDER BY ingest_seq LIMIT 50""")
def pending_batch(spark, sf_dir):
    raw = releases(spark, sf_dir).selectExpr("doc_id", "doc_id AS ingest_seq", "publisher")
    return enrich.first_pending(raw, table(spark, sf_dir, "labels"), 50, "doc_id")


@query("""SELECT count(*) AS raw, count(l.doc_id) AS processed, count(*) FILTER (WHERE l.doc_id IS NULL) AS pending
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def backlog_stats(spark, sf_dir):
    return enrich.backlog(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


RAW_SPEC = SearchSpec({"publisher": "src3"}, search.parse_day("2024-02-01"), search.parse_day("2024-09-30"))
WHOLE_DAY = SearchSpec({"publisher": "all"}, search.parse_day("2024-02-01"), search.parse_day("2024-02-10"), inclusive_to=True, limit=200)


@query(f"""WITH {RELEASES_SQL} SELECT doc_id, url_hash, publisher, published FROM releases WHERE publisher = 'src3'
    AND published >= TIMESTAMP '2024-02-01' AND published < TIMESTAMP '2024-09-30'
    ORDER BY published DESC NULLS LAST, doc_id LIMIT 100""")
def raw_search_topk(spark, sf_dir):
    rows = releases(spark, sf_dir).select("doc_id", "url_hash", "publisher", "published")
    return search.search(rows, RAW_SPEC, search.RAW_FIELDS, "doc_id")


@query(f"""WITH {RELEASES_SQL} SELECT count(*) AS total FROM releases WHERE publisher = 'src3'
    AND published >= TIMESTAMP '2024-02-01' AND published < TIMESTAMP '2024-09-30'""")
def raw_search_count(spark, sf_dir):
    return search.count_matching(releases(spark, sf_dir), RAW_SPEC, search.RAW_FIELDS)


@query(f"""WITH {RELEASES_SQL} SELECT doc_id, published FROM releases WHERE published >= TIMESTAMP '2024-02-01'
    AND published < TIMESTAMP '2024-02-11' ORDER BY published DESC NULLS LAST, doc_id LIMIT 200""")
def raw_search_whole_day(spark, sf_dir):
    return search.search(releases(spark, sf_dir).select("doc_id", "published"), WHOLE_DAY, search.RAW_FIELDS, "doc_id")


@query(f"""WITH {RELEASES_SQL} SELECT doc_id, published FROM releases
    ORDER BY published DESC NULLS LAST, doc_id LIMIT 100""")
def newest_releases(spark, sf_dir):
    return search.search(releases(spark, sf_dir).select("doc_id", "published"), SearchSpec(), search.RAW_FIELDS, "doc_id")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def order_range_topk(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").drop("o_orderpriority")
    spec = SearchSpec({"o_orderstatus": ["F", "O"]}, dt.datetime(1996, 1, 1), dt.datetime(1998, 1, 1))
    hits = search.matching(orders, spec, ["o_orderstatus"], "o_orderdate")
    return search.newest(hits, spec.limit, "o_orderkey", "o_orderdate")


PROCESSED_SPEC = SearchSpec({
    "publisher": ["src1", "src2", "src5", "src8"], "sentiment": "positive", "topic": [], "country": "all", "unknown": "x",
}, dt.datetime(2024, 1, 10))


@query(f"""WITH {PROCESSED_SQL} SELECT doc_id, publisher, topic, sentiment, published FROM processed
    WHERE publisher IN ('src1', 'src2', 'src5', 'src8') AND sentiment = 'positive' AND published >= TIMESTAMP '2024-01-10'
    ORDER BY published DESC NULLS LAST, doc_id LIMIT 100""")
def processed_search_multi(spark, sf_dir):
    rows = processed(spark, sf_dir).select("doc_id", "publisher", "topic", "sentiment", "published")
    return search.search(rows, PROCESSED_SPEC, search.PROCESSED_FIELDS, "doc_id")


@query(f"""WITH {PROCESSED_SQL} SELECT count(*) AS total FROM processed WHERE publisher IN ('src1', 'src2', 'src5', 'src8')
    AND sentiment = 'positive' AND published >= TIMESTAMP '2024-01-10'""")
def processed_search_count(spark, sf_dir):
    return search.count_matching(processed(spark, sf_dir), PROCESSED_SPEC, search.PROCESSED_FIELDS)


@query("""SELECT 'raw' AS kind, count(*) AS total FROM documents UNION ALL SELECT 'processed', count(*) FROM labels""")
def total_counts(spark, sf_dir):
    def total(kind, name):
        return table(spark, sf_dir, name).agg(F.lit(kind).alias("kind"), F.count("*").alias("total"))

    return total("raw", "documents").unionByName(total("processed", "labels"))


@query("SELECT DISTINCT source AS publisher FROM documents")
def publishers_distinct(spark, sf_dir):
    return search.publishers_present(table(spark, sf_dir, "documents").withColumnRenamed("source", "publisher"))


@query("""SELECT field, string_agg(choice, '|' ORDER BY choice) AS choices FROM (
    SELECT DISTINCT 'language' AS field, lang AS choice FROM documents UNION ALL
    SELECT DISTINCT 'event_type', event_type FROM events UNION ALL
    SELECT DISTINCT 'priority', o_orderpriority FROM orders) GROUP BY field""")
def filter_definitions(spark, sf_dir):
    fields = [("language", "documents", "lang"), ("event_type", "events", "event_type"), ("priority", "orders", "o_orderpriority")]
    domains = None
    for field, name, column in fields:
        choices = table(spark, sf_dir, name).select(F.lit(field).alias("field"), F.col(column).alias("choice")).distinct()
        domains = choices if domains is None else domains.unionByName(choices)
    definitions = search.filter_definitions(domains.withColumn("ord", F.lit(0)))
    return definitions.select("field", F.array_join("choices", "|").alias("choices"))


@query(rf"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(split_part(text, chr(10), 1), '{SPACE_RE2}', ' ', 'g')), ''), '(untitled)') AS title,
    trim(regexp_replace(text, '{SPACE_RE2}', ' ', 'g')) AS summary FROM documents""")
def clean_text(spark, sf_dir):
    rows = dealt(table(spark, sf_dir, "documents")).select(
        "doc_id", F.expr(r"split_part(text, '\n', 1) AS title"),
        text.first_nonblank(F.lit(None).cast("string"), F.col("text")).alias("summary"),
    )
    return text.clean_text(rows, "title", "summary").withColumn("title", text.title_or_placeholder(F.col("title")))


@query("""SELECT doc_id, CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || ' […]' ELSE text END AS page_text
    FROM documents""")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text")).alias("page_text"))


@query(f"""WITH {RELEASES_SQL} SELECT doc_id, publisher, coalesce(strftime(published, '%Y-%m-%d %H:%M'), '') AS published_text,
    substring(text, 1, 200) AS teaser, '#' AS link FROM releases""")
def raw_rows_view(spark, sf_dir):
    rows = releases(spark, sf_dir)
    return rows.select(
        "doc_id", display.publisher_label(F.lit(""), F.col("publisher")).alias("publisher"),
        display.stamp_text(F.col("published")).alias("published_text"), display.summary_teaser(F.col("text")).alias("teaser"),
        display.safe_link(F.concat(F.lit("ftp://"), "url_hash")).alias("link"),
    )


@query(f"""WITH {PROCESSED_SQL} SELECT doc_id, topic, CASE WHEN sentiment IN ('positive', 'neutral') THEN sentiment ELSE 'negative' END
    AS sentiment, CASE WHEN language <> 'en' THEN 'EN: ' || title END AS title_en,
    coalesce(strftime(published, '%Y-%m-%d %H:%M'), '') AS published_text FROM processed""")
def processed_cards_view(spark, sf_dir):
    rows = processed(spark, sf_dir)
    title_en = F.when(F.col("language") == "en", F.col("title")).otherwise(F.concat(F.lit("EN: "), "title"))
    return rows.select(
        "doc_id", "topic", display.sentiment_bucket(F.col("sentiment")).alias("sentiment"),
        display.translated_title(F.col("title"), title_en).alias("title_en"),
        display.stamp_text(F.col("published")).alias("published_text"),
    )


@query("""SELECT page_id, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN url ELSE '#' END AS link,
    CASE WHEN replace(url, 'http://', '//') LIKE 'http%' THEN url ELSE '#' END AS secure_link FROM pages""")
def link_flags(spark, sf_dir):
    secure = F.replace(F.col("url"), F.lit("http://"), F.lit("//"))
    return table(spark, sf_dir, "pages").select(
        "page_id", display.safe_link(F.col("url")).alias("link"), display.safe_link(secure).alias("secure_link")
    )
