"""Hash keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_hash(url: Column) -> Column:
    """SHA-256 of the URL as it stands: no normalisation."""
    return F.sha2(url, 256)


def iso_utc(stamp: Column) -> Column:
    """``2026-08-14T12:00:00+00:00``, with six fraction digits only when there is a fraction."""
    fraction = F.date_format(stamp, "SSSSSS")
    return F.concat(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)),
        F.lit("+00:00"),
    )


def calendar_uid(source: Column, title: Column, release_dt: Column) -> Column:
    """SHA-256 of ``source|title|iso time``; null when a part is null."""
    parts = F.concat(source, F.lit("|"), title, F.lit("|"), iso_utc(release_dt))
    return F.sha2(parts, 256)
