"""ICS bodies to release rows."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import dates, text
from gazette.functions.sqltext import group, literal, raw
from gazette.sources.landing import pin

REGIONS = (
    "Africa", "America", "Antarctica", "Arctic", "Asia", "Atlantic", "Australia", "Etc", "Europe", "Indian", "Pacific",
)
# A zone name outside this list would fail the job, so such an event falls back to its source's zone.
KNOWN_ZONES = ", ".join(
    literal(name) for name in sorted(zoneinfo.available_timezones()) if name.split("/")[0] in REGIONS or name in ("UTC", "GMT")
)

# Labels before a reference period, English first; the first letter may be small.
PERIOD_LABELS = ["Reference period", "Periodo di riferimento"]


def unfold(body: Column) -> Column:
    return F.regexp_replace(body, r"\r?\n[ \t]", "")


def event_blocks(body: Column) -> Column:
    """One string per VEVENT, alarms cut out."""
    blocks = F.regexp_extract_all(unfold(body), F.lit(r"(?si)BEGIN:VEVENT\s(.*?)END:VEVENT"), F.lit(1))
    return F.transform(blocks, lambda block: F.regexp_replace(block, r"(?si)BEGIN:VALARM.*?END:VALARM", ""))


def property_pattern(name: str) -> str:
    return rf'(?im)^{name}((?:;(?:[^":;\r\n]|"[^"\r\n]*")*)*):([^\r\n]*)'


def unescape(value: Column) -> Column:
    r"""``\n`` ``\,`` ``\;`` ``\\`` back to characters; a NUL holds the place of a double backslash meanwhile."""
    value = F.replace(value, F.lit("\\\\"), F.lit("\0"))
    for escaped, plain in (("\\n", "\n"), ("\\N", "\n"), ("\\,", ","), ("\\;", ";")):
        value = F.replace(value, F.lit(escaped), F.lit(plain))
    return F.replace(value, F.lit("\0"), F.lit("\\"))


def text_property(block: Column, name: str) -> Column:
    return unescape(F.regexp_extract(block, property_pattern(name), 2))


def reference_period(description: str) -> str:
    """What follows the label, up to a comma or a literal backslash-n; none where the line ends before."""

    def after(label: str) -> str:
        start = f"[{label[0]}{label[0].lower()}]{label[1:]}:?"
        rest = f"get(split({description}, {raw(start)}, 2), 1)"
        value = text.strip_space(f"get(split({rest}, {raw(r',|\\n')}, 2), 0)")
        return f"get(transform(array({value}), v -> if(contains(v, char(10)), NULL, nullif(v, ''))), 0)"

    return f"coalesce({', '.join(after(label) for label in PERIOD_LABELS)})"


def parse_ics(landing: DataFrame, sources: DataFrame) -> DataFrame:
    """Landing bodies joined to their source's zone and default hour, one row per event."""
    kept = [name for name in landing.columns if name != "body"]
    events = landing.select(*kept, F.posexplode(event_blocks(F.col("body"))).alias("item_pos", "block"))
    start = property_pattern("DTSTART")
    zone = group(group("block", start, 1), r'(?i);TZID="?([^";:]+)', 1)
    fields = events.join(sources, "source").select(
        *kept, "item_pos", "tz", "default_hour", "block",
        F.trim(F.regexp_extract("block", start, 2)).alias("start"),
        F.expr(f"if({zone} IN ({KNOWN_ZONES}), {zone}, NULL)").alias("tzid"),
        text_property(F.col("block"), "SUMMARY").alias("summary"),
        text_property(F.col("block"), "DESCRIPTION").alias("description"),
        F.expr(f"nullif(trim({group('block', property_pattern('URL'), 2)}), '')").alias("url"),
    )
    timed = fields.selectExpr(
        "*", f"{text.strip_space('summary')} AS title", f"{dates.ics_start_to_utc('start', 'tzid', 'tz', 'default_hour')} AS release_dt",
        f"{reference_period('description')} AS reference_period",
    )
    fault = (
        F.when(F.col("start") == "", "no_start")
        .when(F.col("release_dt").isNull(), "bad_date")
        .when(F.col("title") == "", "no_title")
    )
    return pin(timed.select(
        *kept, "item_pos", "title", "release_dt", "reference_period", "url", fault.alias("fault"),
        F.when(fault.isNotNull(), F.col("block")).alias("raw"),
    ), "fault")
