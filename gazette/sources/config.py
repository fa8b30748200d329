"""Small configured dimensions: feeds, extraction domains, model preferences, calendar sources.

They are built as local relations, so the planner knows their exact size and broadcasts them only while they are
below the session's threshold.
"""

from __future__ import annotations

import importlib.util
import tomllib
from pathlib import Path
from typing import Literal, get_args, get_origin, get_type_hints

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gazette import schemas

# The closed domains of an extraction record, in display order.
EXTRACTION_DOMAINS = {
    "topic": [
        "Consumer prices", "Producer prices", "Import prices", "Export prices", "GDP", "Industrial production",
        "Services production", "International trade", "Labour market", "Public finance", "Retail trade",
        "Construction", "Business surveys", "Other economic topics", "Non-economic topics",
    ],
    "country": ["Euro area", "Italy", "Spain", "France", "Germany", "Ireland", "Other"],
    "sentiment": ["positive", "negative", "neutral"],
}
EXTRACTION_TEXTS = ["title_en", "summary_en", "key_figures"]

# ICS calendars with their zone and the hour a date-only event gets.
ICS_SOURCES = [("eurostat", "Europe/Brussels", 11), ("istat", "Europe/Rome", 10), ("ine", "Europe/Madrid", 9)]
# Facets of the German release calendar, one landing body each.
DESTATIS_TOPICS = [
    "preise", "industrie_verarbeitendes_gewerbe", "bauen", "unternehmen", "arbeitsmarkt", "aussenhandel",
    "gross_einzelhandel", "verdienste", "dienstleistungen", "volkswirtschaftliche_gesamtrechnungen_inlandsprodukt",
    "arbeits_lohnnebenkosten", "bevoelkerung", "verkehrsunfaelle",
]

CONF = Path(__file__).resolve().parent.parent / "conf"


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    return spark.createDataFrame(pa.table([list(column) for column in columns], schema=to_arrow_schema(schema)))


def load_feeds(spark: SparkSession, path: str | Path = CONF / "feeds.toml") -> DataFrame:
    """One row per feed, from a TOML file with a table per agency; read again on every call."""
    with open(path, "rb") as handle:
        agencies = tomllib.load(handle)
    rows = [
        (slug, agency["name"], agency["language"], feed["label"], feed["url"], agency_ord, feed_ord)
        for agency_ord, (slug, agency) in enumerate(agencies.items())
        for feed_ord, feed in enumerate(agency["feeds"])
    ]
    return local_frame(spark, rows, schemas.FEEDS)


def publishers(feeds: DataFrame) -> DataFrame:
    """(slug, name) list in configured order."""
    named = feeds.groupBy("publisher", "publisher_full").agg(F.min("agency_ord").alias("ord"))
    return named.orderBy("ord").select(F.col("publisher").alias("slug"), F.col("publisher_full").alias("name"))


def load_preferences(spark: SparkSession, path: str | Path = CONF / "models.toml", cascade: str | None = None) -> DataFrame:
    """Model preference list in the order it is tried; the first cascade of the file unless one is named."""
    with open(path, "rb") as handle:
        cascades = tomllib.load(handle)["cascades"]
    entries = cascades[cascade or next(iter(cascades))]["entries"]
    rows = [(rank, entry["provider"], entry["model"]) for rank, entry in enumerate(entries)]
    return local_frame(spark, rows, schemas.PREFERENCES)


def load_domains(path: str | Path, class_name: str = "LLMExtraction") -> dict[str, list[str]]:
    """Closed domains of a user's model file: the ``Literal`` fields of a class, in field order."""
    spec = importlib.util.spec_from_file_location("user_extraction_model", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    hints = get_type_hints(getattr(module, class_name), vars(module))
    return {name: list(get_args(hint)) for name, hint in hints.items() if get_origin(hint) is Literal}


def domain_frame(spark: SparkSession, domains: dict[str, list[str]] = EXTRACTION_DOMAINS) -> DataFrame:
    rows = [(field, choice, ord_) for field, choices in domains.items() for ord_, choice in enumerate(choices)]
    return local_frame(spark, rows, schemas.DOMAINS)


def calendar_sources(spark: SparkSession) -> DataFrame:
    return local_frame(spark, ICS_SOURCES, schemas.CALENDAR_SOURCES)
