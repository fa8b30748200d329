from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gazette import schemas
from gazette.functions.keys import url_hash
from gazette.sources.config import load_feeds, local_frame
from gazette.sources.feeds import parse_feeds

FETCHED = dt.datetime(2025, 7, 15, 12)

RSS_IT = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
  <title>Campi</title><link>https://it.example</link><language>it</language>
  <item><title>Olive: stima del raccolto</title><link>https://it.example/olive-7</link>
    <description>
        A novembre il raccolto
        è di 4 quintali.
    </description><pubDate>Tue, 12 Nov 2024 08:30:00 +0000</pubDate><category>olive</category><category/></item>
  <item><title>Vendemmia</title><link>https://it.example/uva</link><description>d</description>
    <pubDate>Thu, 24 Oct 2024 07:15:00 +0000</pubDate></item>
</channel></rss>"""
ATOM_EN = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>E</title><link rel="alternate" href="https://eu.example"/>
  <entry><title>Ferry crossings</title><link rel="self" href="https://eu.example/self"/><link href="https://eu.example/ferry"/>
    <id>urn:1</id><updated>2024-09-17T05:45:00Z</updated><summary>Ferries crossed 310 times.</summary><category term="sea"/></entry>
  <entry><title>Tides</title><link rel="alternate" href="https://eu.example/tides"/><id>urn:2</id>
    <updated>2024-09-05T06:20:00+02:00</updated></entry>
</feed>"""


def releases(spark, *bodies, url="https://www.istat.it/tema/prezzi/feed", fetched=FETCHED):
    rows = [(url, fetched, 1, body) for body in bodies]
    landing = local_frame(spark, rows, schemas.LANDING_FEED)
    return parse_feeds(landing, load_feeds(spark)).orderBy("ingest_seq").collect()


def rss(*items):
    return "<rss><channel>" + "".join(f"<item>{item}</item>" for item in items) + "</channel></rss>"


def test_rss(spark):
    first, second = releases(spark, RSS_IT)
    assert (first.title, first.url) == ("Olive: stima del raccolto", "https://it.example/olive-7")
    assert first.summary == "A novembre il raccolto è di 4 quintali."
    assert first.published == dt.datetime(2024, 11, 12, 8, 30)
    assert (first.publisher, first.publisher_full, first.feed_label, first.language) == ("istat", "Istat", "Prices", "it")
    assert first.tags == ["olive"] and second.tags == []
    assert first.ingest_seq.entry_pos == 0 and second.ingest_seq.entry_pos == 1
    assert first.fetched_at == FETCHED and first.fault is None


def test_atom(spark):
    first, second = releases(spark, ATOM_EN)
    assert first.url == "https://eu.example/ferry"
    assert first.published == dt.datetime(2024, 9, 17, 5, 45)
    assert second.published == dt.datetime(2024, 9, 5, 4, 20)
    assert (first.summary, second.summary) == ("Ferries crossed 310 times.", "")
    assert first.tags == ["sea"]


TITLES = [
    ("<link>https://a</link>", "(untitled)"),
    ("<title>  Many   spaces </title><link>https://a</link>", "Many spaces"),
    ("<title>caf&eacute;&nbsp;x</title><link>https://a</link>", "café x"),
    ("<title><![CDATA[A &amp; B &lt;b&gt;]]></title><link>https://a</link>", "A & B <b>"),
    ("<title>P &amp;amp; Q</title><link>https://a</link>", "P & Q"),
    ("<title>R & D</title><link>https://a?x=1&y=2</link>", "R & D"),
]


def one_by_one(spark, items):
    """The release each item gives, every item in a body of its own and all of them in one job."""
    rows = releases(spark, *[rss(f"{item}<category>{n}</category>") for n, item in enumerate(items)])
    return sorted(rows, key=lambda row: int(row.tags[0]))


def test_titles(spark):
    rows = one_by_one(spark, [item for item, _ in TITLES])
    assert [(row.title, row.fault) for row in rows] == [(title, None) for _, title in TITLES]


def test_stray_ampersand_in_link(spark):
    (row,) = releases(spark, rss("<title>t</title><link>https://a?x=1&y=2</link>"))
    assert row.url == "https://a?x=1&y=2"


def test_description_lines(spark):
    (row,) = releases(spark, rss("<link>https://a</link><description><![CDATA[  Line one.\n\n  Line two.  ]]></description>"))
    assert row.summary == "Line one. Line two."


def test_summary_falls_back_to_content(spark):
    (row,) = releases(spark, rss("<link>https://a</link><description/><content:encoded><![CDATA[<p>full</p>]]></content:encoded>"))
    assert row.summary == "<p>full</p>"


def test_guid_as_link(spark):
    one, two = releases(spark, rss("<guid>https://g</guid><title>a</title>", "<guid isPermaLink='false'>x</guid><title>b</title>"))
    assert one.url == "https://g" and one.fault is None
    assert two.fault == "no_url" and two.raw == "b"


def test_no_url_is_quarantined(spark):
    (row,) = releases(spark, rss("<title>No URL</title><description>d</description>"))
    assert row.fault == "no_url"


STAMPS = [
    ("<pubDate>Thu, 10 Jul 2025 09:30:00 +0200</pubDate>", dt.datetime(2025, 7, 10, 7, 30)),
    ("<pubDate>10 Jul 25 09:30 GMT</pubDate>", dt.datetime(2025, 7, 10, 9, 30)),
    ("<pubDate>Thu, 10 Jul 2025 09:30:00 EST</pubDate>", dt.datetime(2025, 7, 10, 14, 30)),
    ("<pubDate>2025-07-10</pubDate>", dt.datetime(2025, 7, 10)),
    ("<dc:date>2025-07-10T09:30:00+02:00</dc:date>", dt.datetime(2025, 7, 10, 7, 30)),
    ("<pubDate>July 10, 2025 4pm</pubDate>", dt.datetime(2025, 7, 10, 16)),
    ("<pubDate>4pm</pubDate>", dt.datetime(2025, 7, 15, 16)),
    ("<pubDate>soon</pubDate>", None),
    ("<pubDate>soon</pubDate><dc:date>2025-01-02</dc:date>", dt.datetime(2025, 1, 2)),
    ("", None),
]


def test_stamps(spark):
    rows = one_by_one(spark, [f"<title>t</title><link>https://a</link>{stamp}" for stamp, _ in STAMPS])
    assert [row.published for row in rows] == [published for _, published in STAMPS]


def test_title_date_only_without_stamp(spark):
    dated, plain = releases(spark, rss(
        "<title>IPC. 21 Julio 26</title><link>https://a</link>",
        "<title>IPC. 21 Julio 26</title><link>https://b</link><pubDate>2025-01-02</pubDate>",
    ))
    assert dated.published == dt.datetime(2026, 7, 21)
    assert plain.published == dt.datetime(2025, 1, 2)


def test_broken_bodies(spark):
    half = "<rss><channel><item><title>ok</title><link>https://a</link></item><item><title>cut"
    rows = releases(spark, half, "not a feed", "<rss><channel></channel></rss>", '<feed xmlns="x"><title>t</title></feed>')
    assert sorted((row.fault or "", row.title) for row in rows) == [("", "ok"), ("feed_not_parsed", "(untitled)")]


def test_bad_item_keeps_neighbours(spark):
    rows = releases(spark, rss("<title>a</title><link>https://a</link>", "<title>b<x></title>", "<title>c</title><link>https://c</link>"))
    assert [(row.title, row.fault) for row in rows if row.fault is None] == [("a", None), ("c", None)]
    assert [row.fault for row in rows if row.fault] == ["item_not_parsed"]


def test_unknown_feed(spark):
    (row,) = releases(spark, rss("<title>a</title><link>https://a</link>"), url="https://nowhere")
    assert row.fault == "unknown_feed" and row.raw == "https://nowhere"


def test_feed_list(spark):
    feeds = load_feeds(spark).collect()
    assert len(feeds) == 12 and len({feed.publisher for feed in feeds}) == 6
    assert all(feed.feed_url.startswith("https://") and feed.feed_label for feed in feeds)


def test_url_hash(spark):
    hashes = [row.h for row in local_frame(spark, [("https://a",), ("https://a",), ("https://a#x",)], schemas.LANDING_PAGE[:1])
              .select(url_hash(F.col("url")).alias("h")).collect()]
    assert hashes[0] == hashes[1] != hashes[2] and all(len(h) == 64 and h == h.lower() for h in hashes)
