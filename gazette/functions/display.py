"""View columns: the text, flags and links a results page shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.sqltext import lookup
from gazette.functions.text import blank_to_null

# Display names of calendar sources.
SOURCE_NAMES = {
    "eurostat": "Eurostat", "istat": "Istat", "ine": "INE", "destatis": "Destatis", "insee": "INSEE", "cso": "CSO",
    "forexfactory": "ForexFactory",
}
MARKET_SOURCE = "forexfactory"


def stamp_text(stamp: Column) -> Column:
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm"), F.lit(""))


def day_text(stamp: Column) -> Column:
    return F.coalesce(F.date_format(stamp, "EEE MMM dd"), F.lit(""))


def clock_text(stamp: Column) -> Column:
    return F.coalesce(F.date_format(stamp, "HH:mm 'UTC'"), F.lit(""))


def source_name(code: str) -> Column:
    return F.expr(f"coalesce({lookup(SOURCE_NAMES, code)}, {code})")


def safe_link(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise("#")


def publisher_label(full: Column, slug: Column) -> Column:
    return F.coalesce(blank_to_null(full), slug)


def summary_teaser(summary: Column, max_chars: int = 200) -> Column:
    return F.substring(F.coalesce(summary, F.lit("")), 1, max_chars)


def sentiment_bucket(sentiment: Column) -> Column:
    return F.when(sentiment.isin("positive", "negative", "neutral"), sentiment).otherwise("neutral")


def translated_title(title: Column, title_en: Column) -> Column:
    """The English title when there is one and it differs from the title."""
    return F.when((title_en != "") & (title_en != title), title_en)


def status_icon(status: Column) -> Column:
    return F.when(status == "ok", "ok").when(status == "partial", "warn").otherwise("")


def card_link(is_past: Column, url: Column) -> Column:
    """A calendar card links to what was released, once it was."""
    return F.when(is_past, url)


def has_values(is_market: Column, *values: Column) -> Column:
    """Whether a market card shows a line of values: any of actual, forecast and previous is there."""
    shown = F.lit(False)
    for value in values:
        shown = shown | (F.coalesce(value, F.lit("")) != "")
    return is_market & shown
