"""JSON collection bodies (``link.item[]``) to release rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions import dates, text
from gazette.schemas import struct
from gazette.sources.landing import pin

ITEM = struct("label string, updated string, href string")
COLLECTION = struct("link link", link=struct("item items", items=T.ArrayType(ITEM)))


def parse_cso(landing: DataFrame) -> DataFrame:
    """One row per item; a body that is not JSON is one faulty row."""
    kept = [name for name in landing.columns if name != "body"]
    parsed = landing.select(*kept, "body", F.from_json("body", COLLECTION).alias("doc"))
    broken = F.col("doc").isNull() | (F.col("doc.link").isNull() & ~F.col("body").rlike(r"(?s)^\s*\{.*\}\s*$"))
    items = F.when(broken, F.array(F.lit(None).cast(ITEM))).otherwise(
        F.col("doc.link.item")
    )
    rows = parsed.select(
        *kept, F.when(broken, F.col("body")).alias("_raw"), F.posexplode(items).alias("item_pos", "item")
    )
    fields = rows.select(
        *kept, "item_pos", "_raw", "item",
        F.expr(f"coalesce({text.strip_space('item.label')}, '') AS title"),
        F.expr(f"coalesce({text.strip_space('item.updated')}, '') AS updated"),
        F.when(F.startswith("item.href", F.lit("http")), F.col("item.href")).alias("url"),
    )
    timed = fields.withColumn("release_dt", F.expr(dates.parse_iso_date("updated", keep_fraction=True)))
    fault = (
        F.when(F.col("_raw").isNotNull(), "body_not_parsed")
        .when(F.col("title") == "", "no_title")
        .when(F.col("updated") == "", "no_start")
        .when(F.col("release_dt").isNull(), "bad_date")
    )
    return pin(timed.select(
        *kept, "item_pos", "title", "release_dt", F.lit(None).cast("string").alias("reference_period"), "url",
        fault.alias("fault"), F.when(fault.isNotNull(), F.coalesce("_raw", F.to_json("item"))).alias("raw"),
    ), "fault")


def is_recent(stamp: str, as_of: dt.datetime, days: int = 30) -> Column:
    """The API's own window: items updated in the last ``days`` days, counted from the start of the day."""
    since = dt.datetime.combine((as_of - dt.timedelta(days=days)).date(), dt.time())
    return F.col(stamp) >= F.lit(since).cast("timestamp")
