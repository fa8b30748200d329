"""Why rows of bodies are refused: bodies in which three items of four lack something, and the reasons by item."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.catalog.base import query
from gazette.catalog.bodies import DAY, ESCAPED, FETCHED, LINE_STAMP, LINES_SQL, write_bodies
from gazette.sources import config
from gazette.sources.cso import parse_cso
from gazette.sources.feeds import normalise, read_items
from gazette.sources.html_calendars import parse_event_list
from gazette.sources.ics import parse_ics


def reasons(rows, place="item_pos"):
    return rows.select("doc_id", F.col(place).cast("bigint").alias("item_pos"), "fault", F.col("raw").isNotNull().alias("kept_raw"))


RSS_ITEM = f"""concat('<item><title>', {ESCAPED}, '</title>', if(pos % 4 = 1, '', concat('<link>https://x.example/', doc_id, '/', pos, '</link>')), '</item>')"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS item_pos, CASE WHEN pos % 4 = 1 THEN 'no_url' END AS fault, pos % 4 = 1 AS kept_raw FROM lines""")
def rss_rejects(spark, sf_dir):
    bodies = write_bodies(spark, sf_dir, RSS_ITEM, "<rss><channel>", "</channel></rss>").withColumn("fetched_at", F.expr(FETCHED))
    return reasons(normalise(read_items(bodies)), "entry_pos")


ICS_EVENT = f"""concat('BEGIN:VEVENT\\r\\n', CASE pos % 4 WHEN 1 THEN '' WHEN 2 THEN 'DTSTART:20241345T990000Z\\r\\n' ELSE concat('DTSTART:', date_format({DAY}, 'yyyyMMdd'), 'T080000Z\\r\\n') END,
    if(pos % 4 = 3, '', 'SUMMARY:title\\r\\n'), 'END:VEVENT\\r\\n')"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS item_pos, CASE pos % 4 WHEN 1 THEN 'no_start' WHEN 2 THEN 'bad_date' WHEN 3 THEN 'no_title' END AS fault,
    pos % 4 <> 0 AS kept_raw FROM lines""")
def ics_rejects(spark, sf_dir):
    bodies = write_bodies(spark, sf_dir, ICS_EVENT, "BEGIN:VCALENDAR\r\n", "END:VCALENDAR\r\n")
    bodies = bodies.withColumn("source", F.expr("CASE lang WHEN 'es' THEN 'ine' WHEN 'en' THEN 'eurostat' ELSE 'istat' END"))
    return reasons(parse_ics(bodies, config.calendar_sources(spark)))


JSON_ITEM = """to_json(named_struct('label', if(pos %% 4 = 0, '  ', 'title'), 'updated', CASE pos %% 4 WHEN 1 THEN '' WHEN 2 THEN 'soon'
    ELSE date_format(%s, "yyyy-MM-dd'T'HH:mm:ss'Z'") END, 'href', 'https://cso.example/'))""" % LINE_STAMP


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS item_pos, CASE pos % 4 WHEN 0 THEN 'no_title' WHEN 1 THEN 'no_start' WHEN 2 THEN 'bad_date' END AS fault,
    pos % 4 <> 3 AS kept_raw FROM lines""")
def json_rejects(spark, sf_dir):
    return reasons(parse_cso(write_bodies(spark, sf_dir, JSON_ITEM, '{"link": {"item": [', "]}}", ",")))


EVENT_ITEM = f"""concat('<div class="row c-result--event-preview"><h3 class="c-result__heading"> <a href="#">', if(pos % 4 = 0, '', 'title'), '</a>12</h3>',
    '<div class="c-result-meta__item"><strong>Reporting period:</strong> x</div><div class="c-result-meta__item">Date of issue: ',
    CASE pos % 4 WHEN 1 THEN 'soon' WHEN 2 THEN '2024.13.45' ELSE date_format({DAY}, 'yyyy.MM.dd') END, ' <a>ICS/iCal</a></div></div>')"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos AS item_pos, CASE pos % 4 WHEN 0 THEN 'no_title' WHEN 1 THEN 'no_start' WHEN 2 THEN 'bad_date' END AS fault,
    pos % 4 <> 3 AS kept_raw FROM lines""")
def event_list_rejects(spark, sf_dir):
    return reasons(parse_event_list(write_bodies(spark, sf_dir, EVENT_ITEM, "<html><body>", "</body></html>")))
