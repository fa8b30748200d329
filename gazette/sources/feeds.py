"""RSS 2.0, RSS 1.0 and Atom bodies to entry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions import dates, keys, text
from gazette.functions.sqltext import raw
from gazette.schemas import struct
from gazette.sources.landing import pin

# One item shape covers the three dialects: what a dialect lacks is null.
LINKS = T.ArrayType(struct("_VALUE string, _href string, _rel string"))
ITEM = struct(
    "title string, description string, summary string, content:encoded string, content string,"
    " link links, atom:link links, guid guid, id string,"
    " pubDate string, published string, issued string, dcterms:issued string,"
    " updated string, modified string, dc:date string, dcterms:modified string,"
    " created string, dcterms:created string, category terms, dc:subject strings",
    links=LINKS, guid=struct("_VALUE string, _isPermaLink string"),
    terms=T.ArrayType(struct("_VALUE string, _term string")),
)
ITEMS = T.ArrayType(ITEM)
# The reader fills the last field with the body when it is not well formed; the rest may then be incomplete.
BROKEN = "_corrupt_record"
FEED = struct(f"channel channel, item items, entry items, {BROKEN} string", channel=struct("item items", items=ITEMS), items=ITEMS)
BLOCK = T.StructType([*ITEM.fields, T.StructField(BROKEN, T.StringType())])
FRAGMENT = r"(?s)<(?:item|entry)\b[^>]*>.*?</(?:item|entry)>"
BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#[xX][0-9a-fA-F]+);)"


def read_items(landing: DataFrame, body: str = "body") -> DataFrame:
    """Explode every body into its items: keeps the other columns, adds ``entry_pos``, ``item`` and ``fault``.

    A well-formed body is parsed once as a whole. Of a broken one each item block is parsed by itself, with stray
    ampersands repaired, so one bad item does not lose its neighbours. What is still unread has a ``fault``.
    """
    kept = [f"`{name}`" for name in landing.columns if name != body]
    source = text.with_xml_safe(landing.selectExpr(*kept, f"`{body}` AS _body"), "_body")
    parsed = source.withColumn("_feed", F.from_xml("_body", FEED)).selectExpr(
        *kept, "_body", "coalesce(_feed.channel.item, _feed.item, _feed.entry) AS _whole",
        f"_body = '' OR _feed IS NULL OR _feed.{BROKEN} IS NOT NULL AS _broken",
    )
    # Exactly one of the two arrays is filled; zipping pads the other with nulls.
    listed = parsed.selectExpr(
        *kept, "if(_broken, _body, NULL) AS _raw",
        "coalesce(if(_broken, NULL, _whole), array()) AS _item",
        f"""CASE WHEN NOT _broken THEN array()
            WHEN regexp_like(_body, {raw(FRAGMENT)}) THEN regexp_extract_all(_body, {raw(FRAGMENT)}, 0)
            ELSE array(CAST(NULL AS STRING)) END AS _block""",
    )
    exploded = listed.selectExpr(*kept, "_raw", "posexplode(arrays_zip(_item, _block)) AS (entry_pos, _piece)")
    block = F.col("_piece._block")
    tried = exploded.withColumn("_once", F.from_xml(block, BLOCK))
    repaired = F.from_xml(F.regexp_replace(block, BARE_AMPERSAND, "&amp;"), BLOCK)
    mended = tried.withColumn("_mended", F.when(F.expr(f"_once.{BROKEN} IS NULL"), F.col("_once")).otherwise(repaired))
    fields = ", ".join(f"'{name}', _mended.`{name}`" for name in ITEM.names)
    read = mended.selectExpr(
        *kept, "entry_pos", "_raw", "_piece._block AS _block",
        f"coalesce(_piece._item, if(_mended.{BROKEN} IS NULL AND _mended IS NOT NULL, named_struct({fields}), NULL)) AS item",
    )
    return pin(read.selectExpr(
        *kept, "entry_pos", "item",
        "CASE WHEN item IS NULL THEN if(_block IS NULL, 'feed_not_parsed', 'item_not_parsed') END AS fault",
        "if(item IS NULL, coalesce(_block, _raw), NULL) AS raw",
    ), "fault")


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(item.`{name}`, '')" for name in names) + ")"


# First plain or alternate link, else a permanent guid, else the id.
LINK_TARGETS = f"""filter(transform(
    filter(concat(coalesce(item.link, array()), coalesce(item.`atom:link`, array())),
           link -> link._rel IS NULL OR link._rel = 'alternate'),
    link -> coalesce(nullif({text.strip_space('link._href')}, ''), nullif({text.strip_space('link._VALUE')}, ''))),
    target -> target IS NOT NULL)"""
ENTRY_URL = f"""coalesce(
    try_element_at({LINK_TARGETS}, 1),
    if(coalesce(lower(item.guid._isPermaLink), 'true') = 'true', nullif({text.strip_space('item.guid._VALUE')}, ''), NULL),
    nullif({text.strip_space('item.id')}, ''))"""
ENTRY_TAGS = f"""filter(transform(
    concat(transform(coalesce(item.category, array()), tag -> coalesce(tag._term, tag._VALUE)),
           coalesce(item.`dc:subject`, array())),
    tag -> {text.strip_space('tag')}), tag -> tag <> '')"""


def normalise(items: DataFrame) -> DataFrame:
    """Item rows to entry rows: url, clean title and summary, publication stamp, tags; ``fault`` where a row is unfit.

    ``fetched_at`` fills what a free-form date leaves open.
    """
    kept = [f"`{name}`" for name in items.columns if name not in ("item", "fault", "raw")]
    fields = items.selectExpr(
        *kept, "fault", "raw", f"{ENTRY_URL} AS url", f"{ENTRY_TAGS} AS tags",
        "coalesce(item.title, '') AS _title",
        f"coalesce({_first('summary', 'description', 'content:encoded', 'content')}, '') AS _summary",
        f"{_first('pubDate', 'published', 'issued', 'dcterms:issued')} AS _published",
        f"{_first('updated', 'modified', 'dc:date', 'dcterms:modified')} AS _updated",
        f"{_first('created', 'dcterms:created')} AS _created",
    )
    decoded = text.decode_entities(fields, "_title", "_summary")
    stamped = dates.with_publication_stamp(decoded, "_published", "_updated", "_created", "fetched_at", "published")
    dated = dates.with_title_date(stamped, "_title", "published")
    return pin(dated.select(
        *kept,
        F.expr("coalesce(fault, if(url IS NULL, 'no_url', NULL)) AS fault"),
        F.expr("coalesce(raw, if(url IS NULL, _title, NULL)) AS raw"),
        "url",
        keys.url_hash(F.col("url")).alias("url_hash"),
        text.title_or_placeholder(text.collapse_space(F.col("_title"))).alias("title"),
        text.collapse_space(F.col("_summary")).alias("summary"),
        "published", "tags",
    ), "fault")


def to_releases(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """Add what the feed list knows about each entry and the explicit arrival order."""
    return entries.join(feeds, "feed_url", "left").selectExpr(
        "url_hash", "url", "title", "summary", "publisher", "publisher_full", "feed_label", "language", "published",
        "fetched_at", "tags", "struct(batch_id, agency_ord, feed_ord, entry_pos) AS ingest_seq",
        "coalesce(fault, if(publisher IS NULL, 'unknown_feed', NULL)) AS fault",
        "coalesce(raw, if(publisher IS NULL, feed_url, NULL)) AS raw",
        "feed_url",
    )


def parse_feeds(landing: DataFrame, feeds: DataFrame) -> DataFrame:
    """Landing bodies to release rows; rows with a ``fault`` belong in quarantine."""
    return to_releases(normalise(read_items(landing)), feeds)
