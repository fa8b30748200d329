"""Registration and the stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.keys import url_hash
from gazette.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that gives the same rows."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if oracle:
            ORACLES[run.__name__] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over as many partitions as the setting ``spark.gazette.parse.partitions`` names; where it is unset, as they were scanned."""
    count = rows.sparkSession.conf.get("spark.gazette.parse.partitions", None)
    return rows.repartition(int(count)) if count else rows


# A stamp per document, spread over 2024; every seventh document has none.
PUBLISHED = "if(doc_id % 7 = 0, NULL, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, pmod(doc_id * 7919, 527040)))"
PUBLISHED_SQL = "CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 527040) END"
RELEASES_SQL = f"""releases AS (SELECT doc_id, sha256(text) AS url_hash, split_part(text, chr(10), 1) AS title, text, source AS publisher,
    lang AS language, {PUBLISHED_SQL} AS published FROM documents)"""


def releases(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Documents as raw releases; copies of a text share their key. ``heavy`` deals them for work bound by the processor."""
    documents = table(spark, sf_dir, "documents")
    documents = dealt(documents) if heavy else documents
    return documents.select(
        "doc_id", url_hash(F.col("text")).alias("url_hash"), F.expr(r"split_part(text, '\n', 1) AS title"), "text",
        F.col("source").alias("publisher"), F.col("lang").alias("language"), F.expr(f"{PUBLISHED} AS published"),
    )


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as processed releases."""
    labels = table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "if(quality = 1, 'positive', 'negative') AS sentiment",
        "if(toxic = 1, 'Non-economic topics', 'Other economic topics') AS topic",
    )
    return releases(spark, sf_dir).join(labels, "doc_id")


PROCESSED_SQL = f"""{RELEASES_SQL}, processed AS (SELECT r.*, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment,
    CASE WHEN toxic = 1 THEN 'Non-economic topics' ELSE 'Other economic topics' END AS topic
    FROM releases r JOIN labels USING (doc_id))"""
