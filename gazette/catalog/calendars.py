"""Upsert, carry-forward, calendar search, view and status queries over events and orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gazette.catalog.base import dealt, query, table
from gazette.functions import dates, display, keys
from gazette.functions.sqltext import lookup
from gazette.operators import carry, search, status, upsert
from gazette.schemas import CALENDAR_SOURCES, STATUS_KEYS, struct
from gazette.sources import config, months
from gazette.sources.cso import is_recent

# Event types as calendar sources.
SOURCES = {"click": "eurostat", "view": "istat", "signup": "ine", "error": "destatis", "purchase": "forexfactory"}
SOURCE_SQL = "CASE event_type " + " ".join(f"WHEN '{name}' THEN '{code}'" for name, code in SOURCES.items()) + " END"
NAMES_SQL = "CASE code " + " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in display.SOURCE_NAMES.items()) + " ELSE code END"
STICKY = "CASE WHEN value < 20 THEN '' WHEN value >= 40 THEN props END"


def log(spark, sf_dir):
    """Events as a change log: key (user_id, event_type), write order (ts, event_id)."""
    return table(spark, sf_dir, "events").selectExpr("*", f"{STICKY} AS actual", "if(value < 30, NULL, props) AS url")


@query("""SELECT user_id, event_type, arg_max_null(CASE WHEN value >= 30 THEN props END, (ts, event_id)) AS url,
    arg_max(value, (ts, event_id)) AS value, min(ts) AS first_seen, max(ts) AS updated_at FROM events GROUP BY user_id, event_type""")
def calendar_upsert_overwrite(spark, sf_dir):
    return upsert.latest(
        log(spark, sf_dir), ["user_id", "event_type"], ["url", "value"], order=["ts", "event_id"], seen="ts"
    )


@query(f"""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value,
    arg_max(nullif({STICKY}, ''), (ts, event_id)) FILTER (WHERE nullif({STICKY}, '') IS NOT NULL) AS actual,
    min(ts) AS first_seen, max(ts) AS updated_at FROM events GROUP BY user_id, event_type""")
def calendar_upsert_keep_nonnull(spark, sf_dir):
    return upsert.latest(
        log(spark, sf_dir), ["user_id", "event_type"], ["value"], ["actual"], order=["ts", "event_id"], seen="ts"
    )


@query("""WITH stored AS (SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events WHERE value < 10 GROUP BY user_id),
    batch AS (SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events WHERE value >= 10 GROUP BY user_id)
    SELECT count(*) FILTER (WHERE s.user_id IS NULL) AS inserted, count(*) FILTER (WHERE s.props <> b.props) AS updated,
    count(*) FILTER (WHERE s.props = b.props) AS unchanged, count(*) AS written FROM batch b LEFT JOIN stored s USING (user_id)""")
def calendar_upsert_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "props", "value", "ts AS seen_at", "event_id AS batch_ord")
    stored = upsert.latest(rows.where("value < 10"), "user_id", ["props"])
    return upsert.upsert_counts(stored, rows.where("value >= 10"), "user_id", ["props"])


@query("""SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS seen_at, arg_max(event_id, (ts, event_id)) AS batch_ord,
    arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type""")
def calendar_log_compaction(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "value", "ts AS seen_at", "event_id AS batch_ord")
    return upsert.compact(rows, ["user_id", "event_type"], ["value"])


@query("""SELECT event_id, event_type, last_value(CASE WHEN value > 60 THEN strftime(ts, '%Y-%m-%d') END IGNORE NULLS)
    OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS date_text FROM events""")
def carry_forward_date(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type", "if(value > 60, date_format(ts, 'yyyy-MM-dd'), NULL) AS date_text"
    )
    return carry.carry_forward(rows, "event_type", "event_id", "date_text")


def view(spark, sf_dir):
    """Events as the unified calendar: purchases are the market side."""
    rows = table(spark, sf_dir, "events").select(
        F.expr(f"{lookup(SOURCES, 'event_type')} AS source"), F.expr("event_type || ' ' || props AS title"),
        F.col("ts").alias("release_dt"), F.col("event_id").alias("source_uid"), "value", "props", "event_type",
    )
    office = rows.where("event_type <> 'purchase'").selectExpr("source", "title", "release_dt", "source_uid", "props AS url")
    market = rows.where("event_type = 'purchase'").selectExpr("title", "release_dt", "source_uid", "if(value >= 50, props, '') AS actual")
    return search.calendar_view(office, market)


VIEW_SQL = f"""view AS (SELECT {SOURCE_SQL} AS source, event_type || ' ' || props AS title, ts AS release_dt, event_id AS source_uid,
    event_type = 'purchase' AS is_ff, CASE WHEN event_type <> 'purchase' THEN props END AS url,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN value >= 50 THEN props ELSE '' END END AS actual FROM events)"""


@query(f"""WITH {VIEW_SQL} SELECT source, title, release_dt, source_uid, is_ff FROM view WHERE regexp_matches(title, '(?i)K": [1-4]\\d?')
    AND release_dt >= TIMESTAMP '2024-01-05' AND release_dt < TIMESTAMP '2024-01-21' ORDER BY release_dt, is_ff, source_uid LIMIT 500""")
def calendar_unified_search(spark, sf_dir):
    hits = search.search_calendar(
        view(spark, sf_dir), date_from=dt.datetime(2024, 1, 5), date_to=dt.datetime(2024, 1, 20), q=r'K": [1-4]\d?'
    )
    return hits.select("source", "title", "release_dt", "source_uid", "is_ff")


@query(f"""WITH {VIEW_SQL} SELECT source, title, release_dt, source_uid FROM view WHERE source = 'forexfactory'
    AND contains(lower(title), lower('"K": 7')) ORDER BY release_dt, source_uid LIMIT 500""")
def calendar_literal_search(spark, sf_dir):
    hits = search.search_calendar(view(spark, sf_dir), source="forexfactory", q='"K": 7', mode="literal")
    return hits.select("source", "title", "release_dt", "source_uid")


@query(f"""WITH {VIEW_SQL} SELECT source, release_dt, source_uid FROM view
    WHERE release_dt >= TIMESTAMP '2024-01-01' AND release_dt < TIMESTAMP '2024-02-01'""")
def calendar_default_month(spark, sf_dir):
    start, end = search.default_calendar_range(dt.date(2024, 1, 15))
    hits = search.matching_calendar(view(spark, sf_dir), date_from=start, date_to=end)
    return hits.select("source", "release_dt", "source_uid")


@query(f"""WITH {VIEW_SQL} SELECT code, {NAMES_SQL} AS name, is_ff FROM (SELECT DISTINCT source AS code, is_ff FROM view)""")
def calendar_sources(spark, sf_dir):
    return search.calendar_sources_present(view(spark, sf_dir))


SOURCE_VALUES = ", ".join(f"('{code}')" for code in display.SOURCE_NAMES)


@query(f"""WITH {VIEW_SQL} SELECT s.source, count(v.source) AS written FROM (VALUES {SOURCE_VALUES}) s(source)
    LEFT JOIN view v USING (source) GROUP BY s.source""")
def calendar_written_per_source(spark, sf_dir):
    sources = config.local_frame(spark, [(code,) for code in display.SOURCE_NAMES], CALENDAR_SOURCES[:1])
    return status.written_per_source(view(spark, sf_dir), sources)


@query("""SELECT lower(strftime(month, '%b.%Y')) AS facet, count(*) AS events FROM (SELECT
    unnest(generate_series(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, date_trunc('month', o_orderdate) + INTERVAL 3 MONTH,
    INTERVAL 1 MONTH)) AS month FROM orders) GROUP BY 1""")
def calendar_month_windows(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    pages = days.select(F.explode(months.routine_months(F.col("day"))).alias("month"), "n")
    return pages.groupBy(months.page_key(F.col("month")).alias("facet")).agg(F.sum("n").alias("events"))


@query("""SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-16'""")
def recent_window(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts").where(is_recent("ts", dt.datetime(2024, 2, 15, 12)))


@query("""SELECT event_id, sha256(event_type || '|' || user_id || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00') AS source_uid FROM events""")
def calendar_uid(spark, sf_dir):
    uid = keys.calendar_uid(F.col("event_type"), F.col("user_id").cast("string"), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", uid.alias("source_uid"))


ORDER_ZONES = {"1-URGENT": "Europe/Rome", "2-HIGH": "Europe/Madrid", "3-MEDIUM": "Europe/Brussels", "5-LOW": "America/New_York"}
ZONE_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{name}' THEN '{zone}'" for name, zone in ORDER_ZONES.items()) + " ELSE 'Europe/Berlin' END"


@query(f"""SELECT o_orderkey,
    timezone('UTC', timezone(zone, o_orderdate + to_hours(8 + o_orderkey % 12))) AS zoned_dt,
    timezone('UTC', timezone('Europe/Madrid', o_orderdate + INTERVAL 9 HOUR)) AS day_dt,
    timezone('UTC', timezone('Europe/Berlin', o_orderdate + INTERVAL 8 HOUR)) AS dotted_dt,
    timezone('UTC', timezone('America/New_York', o_orderdate + to_hours(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 8 + o_orderkey % 12 END))) AS market_dt
    FROM (SELECT *, {ZONE_SQL} AS zone FROM orders)""")
def calendar_local_to_utc(spark, sf_dir):
    orders = dealt(table(spark, sf_dir, "orders")).selectExpr(
        "o_orderkey", f"{lookup(ORDER_ZONES, 'o_orderpriority')} AS tzid", "'Europe/Berlin' AS tz", "9 AS hour",
        "o_orderdate + make_dt_interval(0, 8 + o_orderkey % 12) AS local", "o_orderdate", "o_orderstatus",
    ).selectExpr(
        "*", "date_format(local, \"yyyyMMdd'T'HHmmss\") AS start", "date_format(o_orderdate, 'yyyyMMdd') AS day",
        "date_format(o_orderdate, 'yyyy.MM.dd') || ' (deadline)' AS dotted", "date_format(o_orderdate, 'EEE MMM d') AS short",
        "if(o_orderstatus = 'P', 'Tentative', lower(date_format(local, 'h:mma'))) AS clock", "year(o_orderdate) AS year",
    )
    stamps = {
        "zoned_dt": dates.ics_start_to_utc("start", "tzid", "tz", "hour"),
        "day_dt": dates.ics_start_to_utc("day", "tzid", "'Europe/Madrid'", "hour"),
        "dotted_dt": dates.dotted_date_to_utc("dotted"),
        "market_dt": dates.market_date_to_utc("short", "clock", "year"),
    }
    return orders.selectExpr("o_orderkey", *[f"CAST({stamp} AS TIMESTAMP_NTZ) AS {name}" for name, stamp in stamps.items()])


@query(f"""WITH {VIEW_SQL} SELECT source_uid, {NAMES_SQL.replace('code', 'source')} AS source_name, strftime(release_dt, '%a %b %d') AS day_text,
    strftime(release_dt, '%H:%M UTC') AS clock_text, release_dt < TIMESTAMP '2024-01-15 12:00:00' AS is_past, is_ff,
    CASE WHEN release_dt < TIMESTAMP '2024-01-15 12:00:00' THEN url END AS link,
    is_ff AND coalesce(actual, '') <> '' AS has_values FROM view""")
def calendar_view_text(spark, sf_dir):
    now = F.lit(dt.datetime(2024, 1, 15, 12)).cast("timestamp_ntz")
    is_past = F.col("release_dt") < now
    return view(spark, sf_dir).select(
        "source_uid", display.source_name("source").alias("source_name"), display.day_text(F.col("release_dt")).alias("day_text"),
        display.clock_text(F.col("release_dt")).alias("clock_text"), is_past.alias("is_past"), "is_ff",
        F.when(is_past, F.col("url")).alias("link"),
        (F.col("is_ff") & (F.coalesce("actual", F.lit("")) != "")).alias("has_values"),
    )


def status_log(spark, sf_dir):
    """Events as a status log: one pipeline per event type, details from the row."""
    details = status.status_details(F.col("user_id"), F.when(F.col("value") > 50, F.col("event_id")).otherwise(0), "new releases", "agency")
    return table(spark, sf_dir, "events").select(
        F.expr("CASE event_type WHEN 'view' THEN 'press_releases' WHEN 'purchase' THEN 'calendar' ELSE event_type END AS key"),
        F.col("ts").alias("last_run"),
        status.run_status(F.when(F.col("value") > 50, F.col("event_id")).otherwise(0)).alias("status"), details.alias("details"),
    )


STATUS_SQL = """status AS (SELECT CASE event_type WHEN 'view' THEN 'press_releases' WHEN 'purchase' THEN 'calendar' ELSE event_type END AS key,
    ts AS last_run, CASE WHEN value > 50 AND event_id <> 0 THEN 'partial' ELSE 'ok' END AS status, user_id || ' new releases' ||
    CASE WHEN value > 50 AND event_id > 0 THEN ', ' || event_id || ' agency errors' ELSE '' END AS details FROM events),
    latest AS (SELECT key, max(last_run) AS last_run, arg_max(status, (last_run, status, details)) AS status,
    arg_max(details, (last_run, status, details)) AS details FROM status GROUP BY key)"""


@query(f"WITH {STATUS_SQL} SELECT key, last_run, status, details FROM latest")
def status_latest(spark, sf_dir):
    return status.latest_status(status_log(spark, sf_dir))


KEY_VALUES = ", ".join(f"('{key}')" for key in [*STATUS_KEYS, "backfill"])


@query(f"""WITH {STATUS_SQL} SELECT k.key, coalesce(strftime(last_run, '%Y-%m-%d %H:%M UTC'), 'never') AS last_run_text,
    coalesce(status, 'never') AS status, coalesce(details, '') AS details,
    CASE status WHEN 'ok' THEN 'ok' WHEN 'partial' THEN 'warn' ELSE '' END AS icon
    FROM (VALUES {KEY_VALUES}) k(key) LEFT JOIN latest USING (key)""")
def status_text(spark, sf_dir):
    pipelines = config.local_frame(spark, [(key,) for key in [*STATUS_KEYS, "backfill"]], struct("key string"))
    return status.status_view(status.latest_status(status_log(spark, sf_dir)), pipelines)


@query("""SELECT event_type AS source, count(*) FILTER (WHERE value > 90) AS errors,
    CASE WHEN count(*) FILTER (WHERE value > 90) = 0 THEN 'ok' ELSE 'partial' END AS status FROM events GROUP BY event_type""")
def run_status_per_source(spark, sf_dir):
    errors = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count_if(F.col("value") > 90).alias("errors"))
    return errors.select("source", "errors", status.run_status(F.col("errors")).alias("status"))


MONTH_NAMES_SQL = "CASE o_custkey % 5 " + " ".join(
    f"WHEN {i} THEN [{', '.join(repr(name) for name in names)}]" for i, names in enumerate(dates.MONTHS.values())) + " END"
RANKS_SQL = "[" + ", ".join(repr(name) for name in dates.TITLE_MONTHS) + "]"


@query(f"""WITH named AS (SELECT o_orderkey, o_orderdate AS first_date, o_orderdate + INTERVAL 45 DAY AS second_date, {MONTH_NAMES_SQL} AS names FROM orders),
    ranked AS (SELECT o_orderkey, first_date, second_date, list_position({RANKS_SQL}, names[month(first_date)]) AS first_rank,
    list_position({RANKS_SQL}, names[month(second_date)]) AS second_rank FROM named)
    SELECT o_orderkey, CASE WHEN first_rank < second_rank THEN first_date ELSE second_date END AS published FROM ranked""")
def title_month_dates(spark, sf_dir):
    names = "element_at(array(" + ", ".join(
        "array(" + ", ".join(f"'{name}'" for name in of_language) + ")" for of_language in dates.MONTHS.values()
    ) + "), CAST(o_custkey % 5 AS INT) + 1)"
    named = dealt(table(spark, sf_dir, "orders")).selectExpr(
        "o_orderkey", "o_orderdate", "o_orderdate + interval 45 days AS second", f"{names} AS names"
    )
    titles = named.selectExpr(
        "o_orderkey", "concat('Nota: ', day(o_orderdate), ' ', element_at(names, month(o_orderdate)), ' ', year(o_orderdate), ' / ',"
        " day(second), upper(element_at(names, month(second))), '. ', year(second)) AS title", "CAST(NULL AS TIMESTAMP) AS published",
    )
    dated = dates.with_title_date(titles, "title", "published")
    return dated.selectExpr("o_orderkey", "CAST(published AS TIMESTAMP_NTZ) AS published")
