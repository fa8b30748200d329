"""HTML calendar pages to release rows, with pattern-based column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import dates, text
from gazette.functions.sqltext import group, lookup, raw
from gazette.functions.htmltext import element_with_class, inner_html, plain_text, with_class
from gazette.operators.carry import carry_forward
from gazette.sources.landing import pin

ROW_TAG, CELL_TAG = r"<[tT][rR]\b[^>]*>", r"<[tT][dDhH]\b[^>]*>"
ROW_END, CELL_END = r"(?s)</[tT](?:[rR]|[aA][bB][lL][eE])\b.*$", r"(?s)</[tT][dDhH]\b.*$"


# More pieces than a text has tags: a length that needs no second split to be known.
ALL_PIECES = 1 << 30


def _after_tags(html: str, tag: str, end: str) -> str:
    """What follows each opening tag, up to its end tag; ``html`` is mentioned, and so computed, once."""
    return f"transform(slice(split({html}, {raw(tag)}), 2, {ALL_PIECES}), piece -> regexp_replace(piece, {raw(end)}, ''))"


def _release_columns(rows: DataFrame, kept: list[str], fault: Column, raw: str) -> DataFrame:
    return pin(rows.select(
        *kept, "item_pos", "title", "release_dt", "reference_period", F.lit(None).cast("string").alias("url"),
        fault.alias("fault"), F.when(fault.isNotNull(), F.col(raw)).alias("raw"),
    ), "fault")


def parse_event_list(landing: DataFrame) -> DataFrame:
    """German event list: one block per result with a heading and labelled meta items (period, issue date)."""
    kept = [name for name in landing.columns if name != "body"]
    pieces = f"split(body, {raw(rf"(?i){with_class('c-result--event-preview', 'div')}")})"
    blocks = landing.selectExpr(*kept, f"posexplode(slice({pieces}, 2, {ALL_PIECES})) AS (item_pos, block)")
    meta = "trim(replace(" + plain_text("item") + ", 'ICS/iCal', ''))"
    metas = f"transform(regexp_extract_all(block, {raw(element_with_class('c-result-meta__item'))}, 2), item -> {meta})"
    listed = blocks.selectExpr(
        *kept, "item_pos", "block", f"{metas} AS metas", f"{plain_text(inner_html('block', 'c-result__heading'))} AS heading"
    )

    def labelled(label: str, among: str) -> str:
        value = f"try_element_at(filter(metas, meta -> {among}), -1)"
        return text.strip_space(f"replace({value}, '{label}:', '')")

    period, issue = "contains(meta, 'Reporting period')", "contains(meta, 'Date of issue')"
    fields = text.decode_entities(listed, "heading").selectExpr(
        *kept, "item_pos", "block", f"regexp_replace({text.strip_space('heading')}, '[0-9]+$', '') AS title",
        f"nullif({labelled('Reporting period', period)}, '') AS reference_period",
        f"{labelled('Date of issue', f'{issue} AND NOT {period}')} AS issued",
    )
    timed = fields.withColumn("release_dt", F.expr(dates.dotted_date_to_utc("issued")))
    fault = (
        F.when(F.col("title") == "", "no_title")
        .when(~F.coalesce(F.col("issued").rlike(dates.DOTTED_DATE), F.lit(False)), "no_start")
        .when(F.col("release_dt").isNull(), "bad_date")
    )
    return _release_columns(timed, kept, fault, "block")


def parse_embargo_table(landing: DataFrame, as_of: dt.date) -> DataFrame:
    """French table rows: ``title … 14 août à 8h45``; adds ``year_inferred`` where the year was moved ahead."""
    kept = [name for name in landing.columns if name != "body"]
    rows = landing.selectExpr(*kept, f"posexplode({_after_tags('body', ROW_TAG, ROW_END)}) AS (item_pos, row)")
    cells = rows.selectExpr(
        *kept, "item_pos", "row", f"transform({_after_tags('row', CELL_TAG, CELL_END)}, cell -> {plain_text('cell')}) AS cells"
    )
    texts = cells.selectExpr(
        *kept, "item_pos", "row", "try_element_at(cells, 1) AS first",
        "array_join(cells, ' ') AS combined",
    )
    fields = text.decode_entities(texts, "first", "combined").selectExpr(
        "*", f"nullif({group('combined', dates.FRENCH_DATE, 0)}, '') AS date_text"
    )
    title = text.strip_space(f"get(split(first, {raw('(?iu)' + dates.DAY_AND_MONTH)}, 2), 0)")
    title = text.strip_space(f"regexp_replace({title}, '(?i)^INDICATEURS CONJONCTURELS', '')")
    dated = fields.select(
        *kept, "item_pos", "row", "date_text", F.expr(title).alias("title"), F.expr(dates.french_month("date_text")).alias("month"),
        F.lit(None).cast("string").alias("reference_period"),
    )
    timed = dated.withColumn("release_dt", F.expr(dates.french_date_to_utc("date_text", "month", as_of)))
    fault = (
        F.when(F.col("date_text").isNull(), "no_start")
        .when(F.col("month").isNull(), "unknown_month")
        .when(F.col("release_dt").isNull(), "bad_date")
        .when(F.length("title") < 5, "short_title")
    )
    return _release_columns(timed, kept, fault, "row").withColumn(
        "year_inferred", F.year("release_dt") > F.lit(as_of.year)
    )


# Icon class of a market event to its impact.
IMPACT_CLASSES = {"icon--ff-impact-red": "high", "icon--ff-impact-ora": "medium", "icon--ff-impact-yel": "low"}
IMPACT_ICON = r"""(?is)<span\b[^>]*?\bclass\s*=\s*["']([^"']*icon--ff-impact[^"']*)["']"""


MARKET_CELLS = ["date", "time", "currency", "event", "actual", "forecast", "previous"]
# Keeps cell texts apart while they are decoded together in one pass.
CELL_MARK = r"'\u001f'"
SPACES = r"\s+"
CELL_CLASSES = r"""<[tT][dDhH]\b(?:[^>]*?\b[cC][lL][aA][sS][sS]\s*=\s*["']([^"']*)["'])?[^>]*>"""


def event_impact(cell: str) -> str:
    """The last known icon class of the first icon counts; low without one."""
    levels = f"transform(split({group(cell, IMPACT_ICON, 1)}, {raw(SPACES)}), name -> {lookup(IMPACT_CLASSES, 'name')})"
    return f"coalesce(try_element_at(filter({levels}, level -> level IS NOT NULL), -1), 'low')"


def parse_market_pages(landing: DataFrame, page: list[str], year: str, currency: str = "EUR") -> DataFrame:
    """Month pages of market events: the date is printed on the first row of a day and carried down the page.

    ``page`` lists the columns that identify one body, so a page is never larger than one landing row; ``year`` is
    the page's year column.
    """
    kept = [name for name in landing.columns if name != "body"]
    table = group("body", element_with_class("calendar__table", "table"), 2)
    listed = landing.selectExpr(*kept, f"posexplode({_after_tags(table, ROW_TAG, ROW_END)}) AS (row_no, row)")
    # Cells by class: the classes of every opening tag next to what follows it.
    zipped = listed.selectExpr(
        *kept, "row_no", f"transform(regexp_extract_all(row, {raw(CELL_CLASSES)}, 1), names -> split(names, {raw(SPACES)})) AS classes",
        f"{_after_tags('row', CELL_TAG, CELL_END)} AS cells",
    ).selectExpr(*kept, "row_no", "arrays_zip(classes, cells) AS cells")

    def cell(name: str) -> str:
        return f"coalesce(try_element_at(filter(cells, c -> array_contains(c.classes, 'calendar__{name}')), 1).cells, '')"

    named = zipped.selectExpr(*kept, "row_no", f"{event_impact(cell('impact'))} AS impact", *[f"{cell(name)} AS _{name}" for name in MARKET_CELLS])
    # Most cells are bare text, which needs none of the patterns.
    plain = ", ".join(
        f"if(contains(_{name}, '<') OR contains(_{name}, '&'), {plain_text(f'_{name}')}, {text.strip_space(f'_{name}')})" for name in MARKET_CELLS
    )
    read = named.selectExpr(*kept, "row_no", "impact", f"concat_ws({CELL_MARK}, {plain}) AS _texts")
    read = text.decode_entities(read, "_texts").selectExpr(*kept, "row_no", "impact", f"split(_texts, {CELL_MARK}) AS _t")
    fields = {name: f"{text.strip_space(f'_t[{i}]')}" for i, name in enumerate(MARKET_CELLS)}
    read = read.selectExpr(
        *kept, "row_no", "impact", f"nullif({group(fields['date'], f'({dates.SHORT_DATE})', 1)}, '') AS date_text",
        f"{fields['currency']} AS currency", f"{fields['event']} AS title", f"nullif({fields['time']}, '') AS release_dt_orig",
        *[f"nullif({fields[name]}, '') AS {name}" for name in ("actual", "forecast", "previous")],
    )
    dated = carry_forward(read, page, "row_no", "date_text", chunk=None)
    events = pin(dated, "title").where((F.col("currency") == currency) & (F.col("title") != ""))
    timed = events.withColumn(
        "release_dt", F.expr(dates.market_date_to_utc("date_text", "release_dt_orig", year))
    )
    fault = F.when(F.col("date_text").isNull(), "no_start").when(F.col("release_dt").isNull(), "bad_date")
    return pin(timed.select(
        *kept, F.col("row_no").alias("item_pos"), "title", "release_dt", "release_dt_orig", "impact", "currency",
        "actual", "forecast", "previous", fault.alias("fault"),
        F.when(fault.isNotNull(), F.concat_ws(" | ", "date_text", "release_dt_orig", "title")).alias("raw"),
    ), "fault")
