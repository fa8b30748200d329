"""Parse jobs over bodies written from documents: one body per document, one item per line."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gazette.catalog.base import dealt, query, releases, table
from gazette.functions import dates, htmltext
from gazette.functions.sqltext import literal, lookup
from gazette.operators import search
from gazette.operators.dedup import first_writer
from gazette.sources import config
from gazette.sources.cso import parse_cso
from gazette.sources.feeds import normalise, parse_feeds, read_items
from gazette.sources.html_calendars import parse_embargo_table, parse_event_list, parse_market_pages
from gazette.sources.ics import parse_ics

FETCHED = "timestamp'2024-12-31 12:00:00'"
ESCAPED = "replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
# Stamp of a line: spread over days by document, one hour per line.
LINE_STAMP = "timestamp_ntz'2024-01-01' + make_dt_interval(CAST(doc_id % 300 AS INT), pos)"
LINE_STAMP_SQL = "TIMESTAMP '2024-01-01' + to_days((doc_id % 300)::INT) + to_hours(pos)"
LINES_SQL = """lines AS (SELECT doc_id, lang, source, n_chars, unnest(range(len(parts))) AS pos, unnest(parts) AS line
    FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents))"""
TITLE_SQL = r"coalesce(nullif(trim(regexp_replace(line, '\s+', ' ', 'g')), ''), '(untitled)')"


def write_bodies(spark, sf_dir, item, head, tail, separator=""):
    """Documents as bodies: ``item`` is SQL text over (doc_id, lang, pos, line)."""
    body = rf"concat({literal(head)}, array_join(transform(split(text, '\n'), (line, pos) -> {item}), {literal(separator)}), {literal(tail)})"
    return dealt(table(spark, sf_dir, "documents")).selectExpr("doc_id", "lang", "source", f"{body} AS body")


RSS_ITEM = f"""concat('<item><title>', {ESCAPED}, '</title><link>https://x.example/', doc_id, '?a=1&amp;pos=', pos, '</link>',
    '<description><![CDATA[  ', lang, '\\n  ', pos, ' ]]></description><pubDate>',
    date_format({LINE_STAMP}, 'EEE, dd MMM yyyy HH:mm:ss'), ' +0100</pubDate><category>', lang, '</category><category/></item>')"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS entry_pos, 'https://x.example/' || doc_id || '?a=1&pos=' || pos AS url, {TITLE_SQL} AS title,
    lang || ' ' || pos AS summary, {LINE_STAMP_SQL} - INTERVAL 1 HOUR AS published, lang AS tags FROM lines""")
def rss_parse(spark, sf_dir):
    bodies = write_bodies(spark, sf_dir, RSS_ITEM, '<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>', "</channel></rss>")
    return _entries(bodies)


def _entries(bodies):
    rows = normalise(read_items(bodies.withColumn("fetched_at", F.expr(FETCHED)))).where("fault IS NULL")
    return rows.selectExpr(
        "doc_id", "CAST(entry_pos AS BIGINT) AS entry_pos", "url", "title", "summary",
        "CAST(published AS TIMESTAMP_NTZ) AS published", "array_join(tags, '|') AS tags",
    )


LOOSE_ITEM = """concat('<item><title>', replace(line, '<', '&lt;'), '</title><link>https://x.example/', doc_id, '?a=1&pos=', pos,
    '</link><description>', lang, '&nbsp;&amp;&nbsp;', pos, '</description></item>')"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS entry_pos, 'https://x.example/' || doc_id || '?a=1&pos=' || pos AS url, {TITLE_SQL} AS title,
    lang || ' & ' || pos AS summary, NULL::TIMESTAMP AS published, '' AS tags FROM lines""")
def rss_repair(spark, sf_dir):
    """Stray ampersands and a body that breaks off: each item is read by itself."""
    return _entries(write_bodies(spark, sf_dir, LOOSE_ITEM, "<rss><channel>", "<item><title>cut off"))


ATOM_ENTRY = f"""concat('<entry><title type="html">', {ESCAPED}, '</title><link rel="self" href="https://self.example/"/><link href="https://x.example/',
    doc_id, '/', pos, '"/><id>urn:', pos, '</id><updated>', date_format({LINE_STAMP}, "yyyy-MM-dd'T'HH:mm:ss"), 'Z</updated><summary>', lang,
    '</summary><category term="', lang, '"/></entry>')"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS entry_pos, 'https://x.example/' || doc_id || '/' || pos AS url, {TITLE_SQL} AS title,
    lang AS summary, {LINE_STAMP_SQL} AS published, lang AS tags FROM lines""")
def atom_parse(spark, sf_dir):
    head = '<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><link rel="alternate" href="https://x.example"/>'
    return _entries(write_bodies(spark, sf_dir, ATOM_ENTRY, head, "</feed>"))


def feed_landing(spark, sf_dir):
    """RSS bodies as a landing table: the number in the source name picks one of the configured feeds."""
    item = f"""concat('<item><title>', {ESCAPED}, '</title><link>https://x.example/', sha2(line, 256), '</link><pubDate>',
        date_format({LINE_STAMP}, 'dd MMM yyyy HH:mm:ss'), ' GMT</pubDate></item>')"""
    bodies = write_bodies(spark, sf_dir, item, "<rss><channel>", "</channel></rss>")
    urls = ", ".join(literal(row.feed_url) for row in config.load_feeds(spark).orderBy("agency_ord", "feed_ord").collect())
    return bodies.selectExpr(
        f"element_at(array({urls}), CAST(substr(source, 4) AS INT) % 12 + 1) AS feed_url",
        f"{FETCHED} AS fetched_at", "doc_id AS batch_id", "body",
    )


FEED_CODES = ["eurostat", *["istat"] * 6, "ine", "insee", "insee", "destatis", "cso"]
FIRST_ENTRIES_SQL = f"""{LINES_SQL}, entries AS (SELECT 'https://x.example/' || sha256(line) AS url, {TITLE_SQL} AS title,
    [{', '.join(repr(code) for code in FEED_CODES)}][substr(source, 4)::INT % 12 + 1] AS publisher, doc_id, pos,
    {LINE_STAMP_SQL} AS published FROM lines), firsts AS (SELECT sha256(url) AS url_hash, url, arg_min(title, (doc_id, pos)) AS title,
    arg_min(publisher, (doc_id, pos)) AS publisher, arg_min(published, (doc_id, pos)) AS published FROM entries GROUP BY url)"""


def first_entries(spark, sf_dir):
    """Parse, enrich with the feed list, keep the first writer of each URL."""
    parsed = parse_feeds(feed_landing(spark, sf_dir), config.load_feeds(spark)).where("fault IS NULL")
    rows = parsed.selectExpr("url_hash", "url", "title", "publisher", "CAST(published AS TIMESTAMP_NTZ) AS published", "ingest_seq")
    return first_writer(rows, "url_hash", "ingest_seq").drop("ingest_seq")


@query(f"WITH {FIRST_ENTRIES_SQL} SELECT * FROM firsts")
def feed_ingest(spark, sf_dir):
    return first_entries(spark, sf_dir)


@query(f"""WITH {FIRST_ENTRIES_SQL} SELECT * FROM firsts WHERE publisher = 'istat' AND published >= TIMESTAMP '2024-02-01'
    AND published < TIMESTAMP '2024-10-01' ORDER BY published DESC NULLS LAST, url_hash LIMIT 100""")
def feed_ingest_search(spark, sf_dir):
    """The whole way: bodies to entries, feed list, first writer, dated newest-first search."""
    spec = search.SearchSpec({"publisher": "istat"}, dt.datetime(2024, 2, 1), dt.datetime(2024, 10, 1))
    return search.search(first_entries(spark, sf_dir), spec, search.RAW_FIELDS)


DAY = "make_date(2024, 3, 1) + CAST((doc_id + pos) % 200 AS INT)"
DAY_SQL = "DATE '2024-03-01' + ((doc_id + pos) % 200)::INT"
ICS_ZONES = {"de": "Europe/Berlin", "es": "Europe/Madrid", "fr": "Europe/Paris", "en": "Europe/Dublin"}
ICS_EVENT = f"""concat('BEGIN:VEVENT\\r\\nDTSTART;TZID=', {lookup(ICS_ZONES, 'lang')}, ':', date_format({DAY}, 'yyyyMMdd'), 'T',
    lpad(8 + pos % 12, 2, '0'), '3000\\r\\n', regexp_replace(concat('SUMMARY:', regexp_replace(line, r'([,;\\\\])', r'\\\\$1')), '(.{{60}})', '$1\\r\\n '),
    '\\r\\nDESCRIPTION:Reference period: ', lang, ' ', pos, '\\\\, more\\r\\nEND:VEVENT\\r\\n')"""


ICS_DT_SQL = f"""timezone('UTC', timezone(CASE lang WHEN 'de' THEN 'Europe/Berlin' WHEN 'es' THEN 'Europe/Madrid' WHEN 'fr' THEN 'Europe/Paris'
    ELSE 'Europe/Dublin' END, ({DAY_SQL})::TIMESTAMP + to_hours(8 + pos % 12) + INTERVAL 30 MINUTE))"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS item_pos, trim(line) AS title, lang || ' ' || pos AS reference_period,
    {ICS_DT_SQL} AS release_dt FROM lines""")
def ics_parse(spark, sf_dir):
    bodies = write_bodies(spark, sf_dir, ICS_EVENT, "BEGIN:VCALENDAR\r\n", "END:VCALENDAR\r\n")
    bodies = bodies.withColumn("source", F.expr("CASE lang WHEN 'es' THEN 'ine' WHEN 'en' THEN 'eurostat' ELSE 'istat' END"))
    rows = parse_ics(bodies, config.calendar_sources(spark)).where("fault IS NULL")
    return _calendar(rows, "reference_period")


def _calendar(rows, *more):
    return rows.selectExpr(
        "doc_id", "CAST(item_pos AS BIGINT) AS item_pos", "title", "CAST(release_dt AS TIMESTAMP_NTZ) AS release_dt", *more
    )


EVENT_ITEM = f"""concat('<div class="row c-result--event-preview"><h3 class="c-result__heading"> <a href="#">', {ESCAPED}, '</a>12</h3>',
    '<div class="c-result-meta__item"><strong>Reporting period:</strong> ', lang, '</div><div class="c-result-meta__item">Date of issue: ',
    date_format({DAY}, 'yyyy.MM.dd'), ' <a>ICS/iCal</a></div></div>')"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS item_pos, regexp_replace(trim(line), '[0-9]+$', '') AS title, lang AS reference_period,
    timezone('UTC', timezone('Europe/Berlin', ({DAY_SQL})::TIMESTAMP + INTERVAL 8 HOUR)) AS release_dt FROM lines
    WHERE regexp_replace(trim(line), '[0-9]+$', '') <> ''""")
def event_list_parse(spark, sf_dir):
    bodies = write_bodies(spark, sf_dir, EVENT_ITEM, "<html><body>", "</body></html>")
    return _calendar(parse_event_list(bodies).where("fault IS NULL"), "reference_period")


MONTHS_FR = "array(" + ", ".join(f"'{name}'" for name in dates.MONTHS["fr"]) + ")"
TABLE_ITEM = f"""concat('<tr><td><p>', {ESCAPED}, '</p></td><td>', day({DAY}), ' ', upper(element_at({MONTHS_FR}, month({DAY}))), ' à ', 8 + pos % 10,
    'h', if(pos % 2 = 0, '', '45'), '</td></tr>')"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS item_pos, trim(line) AS title, timezone('UTC', timezone('Europe/Paris',
    ({DAY_SQL})::TIMESTAMP + to_years(CASE WHEN month({DAY_SQL}) < 6 THEN 1 ELSE 0 END) + to_hours(8 + pos % 10)
    + to_minutes(CASE WHEN pos % 2 = 0 THEN 0 ELSE 45 END))) AS release_dt, month({DAY_SQL}) < 6 AS year_inferred
    FROM lines WHERE length(trim(line)) >= 5""")
def embargo_table_parse(spark, sf_dir):
    bodies = write_bodies(spark, sf_dir, TABLE_ITEM, "<table>", "</table>")
    return _calendar(parse_embargo_table(bodies, dt.date(2024, 6, 15)).where("fault IS NULL"), "year_inferred")


PAGE_DAY = "make_date(2024, 3, 1) + CAST((doc_id + pos div 4) % 200 AS INT)"
PAGE_DAY_SQL = "DATE '2024-03-01' + ((doc_id + pos // 4) % 200)::INT"
MARKET_ROW = f"""concat('<tr class="calendar__row"><td class="calendar__cell calendar__date">', if(pos % 4 = 0,
    concat('<span>', date_format({PAGE_DAY}, 'EEE'), ' <span>', date_format({PAGE_DAY}, 'MMM d'), '</span></span>'), ''),
    '</td><td class="calendar__cell calendar__time">', if(pos % 5 = 0, 'Tentative', concat(1 + pos % 12, ':30', if(pos % 2 = 0, 'am', 'pm'))),
    '</td><td class="calendar__cell calendar__currency">', if(pos % 3 = 2, 'USD', 'EUR'),
    '</td><td class="calendar__cell calendar__impact"><span class="icon icon--ff-impact-', element_at(array('red', 'ora', 'yel', 'gra'), 1 + pos % 4),
    '"></span></td><td class="calendar__cell calendar__event"><span>', {ESCAPED}, '</span></td><td class="calendar__cell calendar__actual">',
    if(pos % 2 = 0, concat('0.', pos, '%'), ''), '</td></tr>')"""


MARKET_SQL = f"""SELECT doc_id, pos AS item_pos, trim(line) AS title,
    timezone('UTC', timezone('America/New_York', ({PAGE_DAY_SQL})::TIMESTAMP + CASE WHEN pos % 5 = 0 THEN INTERVAL 0 MINUTE ELSE
    to_minutes(30 + 60 * ((1 + pos % 12) % 12 + CASE WHEN pos % 2 = 0 THEN 0 ELSE 12 END)) END)) AS release_dt,
    CASE pos % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact,
    CASE WHEN pos % 2 = 0 THEN '0.' || pos || '%' END AS actual,
    CASE WHEN pos % 5 = 0 THEN 'Tentative' ELSE (1 + pos % 12) || ':30' || CASE WHEN pos % 2 = 0 THEN 'am' ELSE 'pm' END END AS release_dt_orig
    FROM lines WHERE pos % 3 <> 2 AND trim(line) <> ''"""


@query(f"WITH {LINES_SQL} {MARKET_SQL}")
def market_page_parse(spark, sf_dir):
    bodies = write_bodies(spark, sf_dir, MARKET_ROW, '<table class="calendar__table">', "</table>")
    rows = parse_market_pages(bodies.withColumn("year", F.lit(2024)), ["doc_id"], "year")
    return _calendar(rows.where("fault IS NULL"), "impact", "actual", "release_dt_orig")


JSON_ITEM = """to_json(named_struct('label', concat(' ', line, ' '), 'updated', concat(date_format(%s, "yyyy-MM-dd'T'HH:mm:ss"), '.250Z'),
    'href', if(pos %% 2 = 0, concat('https://cso.example/', pos), concat('/relative/', pos))))""" % LINE_STAMP


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS item_pos, trim(line) AS title, {LINE_STAMP_SQL} + INTERVAL 250 MILLISECOND AS release_dt,
    CASE WHEN pos % 2 = 0 THEN 'https://cso.example/' || pos END AS url FROM lines WHERE trim(line) <> ''""")
def json_items(spark, sf_dir):
    bodies = write_bodies(spark, sf_dir, JSON_ITEM, '{"link": {"item": [', "]}}", ",")
    return _calendar(parse_cso(bodies).where("fault IS NULL"), "url")


def _cut(expression: str, *tags: str) -> str:
    for tag in tags:
        expression = f"regexp_replace({expression}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return expression


def _entities(expression: str) -> str:
    for entity, character in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        expression = f"replace({expression}, '{entity}', '{character}')"
    return expression


_BODY = _cut("regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')", *htmltext.BOILERPLATE)
_BODY = f"regexp_replace({_BODY}, '(?is)<div\\b[^>]*\\bclass\\s*=\\s*\"ad\"[^>]*>.*?</div\\s*>', ' ', 'g')"


@query(rf"""WITH body AS (SELECT page_id, {_BODY} AS body FROM pages),
    article AS (SELECT page_id, coalesce(nullif(regexp_extract(body, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1), ''), body) AS body FROM body)
    SELECT page_id, trim(regexp_replace({_entities("regexp_replace(body, '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) AS main_text FROM article""")
def page_main_text(spark, sf_dir):
    pages = dealt(table(spark, sf_dir, "pages").select("page_id", "html"))
    return htmltext.with_main_text(pages, "html", "main_text").select("page_id", "main_text")


NESTED_HTML = f"""concat('<html><head><title>t</title></head><body><nav>a<nav>b</nav>c</nav><article><table><tr><td>x<table><tr><td>y</td></tr></table>z</td></tr></table><p>',
    {ESCAPED}, '<div class="ad">ad<div>inner</div>more</div><p>unclosed ', doc_id, '<aside>s<aside>t</aside>u</aside></article><footer>f')"""


@query(r"""SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1) || ' unclosed ' || doc_id, '\s+', ' ', 'g')) AS main_text FROM documents""")
def nested_page_text(spark, sf_dir):
    """Pages with tables, menus and adverts inside each other, and elements that nothing closes."""
    lines = dealt(table(spark, sf_dir, "documents")).selectExpr("doc_id", r"split_part(text, '\n', 1) AS line")
    return htmltext.with_main_text(lines.selectExpr("doc_id", f"{NESTED_HTML} AS html"), "html", "main_text").select("doc_id", "main_text")


@query(rf"""SELECT page_id, trim(regexp_replace({_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) AS title,
    lower(regexp_extract(html, '<html[^>]*lang="([a-z-]+)"', 1)) AS language, regexp_extract(url, '://([^/?#:]+)', 1) AS host FROM pages""")
def page_title_lang_host(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "html", htmltext.page_language(F.col("html")).alias("language"), htmltext.url_host(F.col("url")).alias("host")
    )
    return htmltext.with_page_title(pages, "html", "title").drop("html")


def document_pages(spark, sf_dir):
    """Labelled documents as captured pages."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    html = "concat('<html><head><title>x</title></head><body><nav>menu</nav><article><p>', " + ESCAPED.replace("line", "text") + ", '</p></article></body></html>')"
    return releases(spark, sf_dir, heavy=True).join(labels, "doc_id", "left_semi").selectExpr(
        "concat('https://x.example/', doc_id) AS url", f"{html} AS html"
    )
