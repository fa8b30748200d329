"""Table schemas and key lists."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(), "strings": T.ArrayType(T.StringType()),
}


def struct(fields: str, **nested: T.DataType) -> T.StructType:
    """Schema from ``name type`` pairs; ``nested`` names further types. Needs no session, unlike a DDL string."""
    types = {**TYPES, **nested}
    return T.StructType([T.StructField(name, types[kind]) for name, kind in (pair.split() for pair in fields.split(","))])


LANDING_FEED = struct("feed_url string, fetched_at timestamp, batch_id bigint, body string")
LANDING_CALENDAR = struct("source string, facet string, seen_at timestamp, batch_ord bigint, body string")
LANDING_PAGE = struct("url string, html string")

FEEDS = struct(
    "publisher string, publisher_full string, language string, feed_label string, feed_url string,"
    " agency_ord int, feed_ord int"
)
DOMAINS = struct("field string, choice string, ord int")
PREFERENCES = struct("rank int, provider string, model string")
CALENDAR_SOURCES = struct("source string, tz string, default_hour int")

INGEST_SEQ = struct("batch_id bigint, agency_ord int, feed_ord int, entry_pos int")

PRESS_RELEASES = struct(
    "url_hash string, url string, title string, summary string, publisher string, publisher_full string,"
    " feed_label string, language string, published timestamp, fetched_at timestamp, tags strings, ingest_seq seq",
    seq=INGEST_SEQ,
)
# Layout column of the release tables: month of publication.
MONTH, UNDATED = "pub_month", "undated"
PROCESSED = struct(
    "url_hash string, url string, title string, publisher string, publisher_full string, feed_label string,"
    " language string, published timestamp, fetched_at timestamp, processed_at timestamp, processing_model string,"
    " topic string, country string, sentiment string, title_en string, summary_en string, key_figures string,"
    " updated_at timestamp"
)

# What a calendar key is made of: a search by these reaches the stored log.
CALENDAR_KEY = ["source_uid", "source", "title", "release_dt"]
NSO_PAYLOAD = ["source", "title", "release_dt", "reference_period", "url"]
FF_PAYLOAD = ["source", "title", "release_dt", "release_dt_orig", "impact", "currency"]
FF_STICKY = ["actual", "forecast", "previous"]
NSO_LOG = struct(
    "source_uid string, source string, title string, release_dt timestamp, reference_period string, url string,"
    " seen_at timestamp, batch_ord bigint"
)
FF_LOG = struct(
    "source_uid string, source string, title string, release_dt timestamp, release_dt_orig string, impact string,"
    " currency string, actual string, forecast string, previous string, seen_at timestamp, batch_ord bigint"
)

ANSWER_FIELDS = ["topic", "country", "sentiment", "title_en", "summary_en", "key_figures"]
ANSWERS = struct(
    "url_hash string, provider string, model string, answer record, error string",
    record=T.StructType([T.StructField(name, T.StringType()) for name in ANSWER_FIELDS]),
)
# Columns an answer may never carry: they are copied from the raw row after generation.
RESERVED_FIELDS = ["url", "url_hash", "published", "fetched_at", "publisher", "processing_model"]

# A feed body that was read: its entries, and the agency as text if it could not be parsed.
READ_BODY = struct("entries bigint, unread string")
POLL = struct("polled timestamp_ntz, bodies bigint, unchanged bigint, entries bigint, inserted bigint, skipped bigint, errors bigint")
# A later value of one field of a processed release.
CORRECTIONS = struct("url_hash string, field string, value string, set_at timestamp")
# Tries of a release with a model; a snapshot has a row for each pair, the number of failed ones, and the last of them.
TRIES = struct("url_hash string, provider string, model string, tried_at timestamp, error string")
TRIED = struct("failures bigint")
FIRST_SEEN = struct("first_seen timestamp")

STATUS = struct("key string, last_run timestamp_ntz, status string, details string")
STATUS_KEYS = ["press_releases", "calendar"]
QUARANTINE = struct("source string, reason string, raw string, seen_at timestamp")
