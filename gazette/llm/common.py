"""Reading, staging and hashing shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.session import bound_batches, work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(frame: DataFrame, label: str, *by: str) -> DataFrame:
    """Write a step to the shared folder, in folders ``by`` columns, and read it back: lineage ends here and a lost executor costs nothing."""
    bound_batches(frame.sparkSession)
    path = work_dir(frame.sparkSession, label)
    frame.write.partitionBy(*by).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, label: str, key: str) -> DataFrame:
    """As ``stage``, in as many buckets of the key as shuffles have partitions: a join on the key does not move these rows again.

    The session's catalogue knows the table only while it is written; the frame goes on reading its files.
    """
    return bucketed_and_plain(frame, label, key)[0]


def bucketed_and_plain(frame: DataFrame, label: str, key: str) -> tuple[DataFrame, DataFrame]:
    """As ``bucketed``, and the same rows as files without buckets, for joins where a key may be hot."""
    spark, name = frame.sparkSession, f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = work_dir(bound_batches(spark), label)
    frame.write.bucketBy(partitions(spark), key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows, spark.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_class(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, by a modulus; a null key is in class -1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))


def small(frame: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast a frame whose counted rows are within the bound, else leave the join to the planner."""
    return F.broadcast(frame) if rows <= max_rows else frame


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; texts of ASCII characters take the faster way to the same result."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
