"""Parquet tables: layout, reads and replay-safe writes.

Two kinds of write. A *keyed* table is appended to by what its key index does not hold, so running a batch twice adds
nothing. A *run* table holds one folder per run, which a replay overwrites; the runs of a log are folded into generations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette import schemas
from gazette.schemas import MONTH, UNDATED
from gazette.operators.upsert import corrected
from gazette.sources import files
from gazette.sources.generations import Generations
from gazette.sources.keyindex import KeyIndex

@dataclass(frozen=True)
class Store:
    """Folders of the stored tables below one root; ``digits`` is the length of the prefixes in its key indexes."""

    spark: SparkSession
    root: str
    digits: int = 2

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def press_releases(self) -> DataFrame:
        return read(self.spark, self.path("press_releases"), with_month(schemas.PRESS_RELEASES))

    def release_keys(self) -> KeyIndex:
        return KeyIndex(self.spark, self.path("press_releases.keys"), digits=self.digits)

    def bodies(self) -> KeyIndex:
        """Feed bodies that were read, by a digest of feed and body, with what they gave."""
        return KeyIndex(self.spark, self.path("bodies.keys"), schemas.READ_BODY, self.digits)

    def polls(self) -> DataFrame:
        return read(self.spark, self.path("polls"), schemas.POLL)

    def stored_processed(self) -> DataFrame:
        """Processed releases as they were written."""
        return read(self.spark, self.path("processed"), with_month(schemas.PROCESSED))

    def processed_keys(self) -> KeyIndex:
        return KeyIndex(self.spark, self.path("processed.keys"), digits=self.digits)

    def corrections(self) -> DataFrame:
        """Later values of single fields of processed releases, laid out by the releases' month."""
        return read(self.spark, self.path("corrections"), with_month(schemas.CORRECTIONS))

    def processed(self) -> DataFrame:
        """Processed releases with their corrections."""
        corrections = f"{self.path('corrections')}"
        return corrected(self.stored_processed(), self.corrections(), [MONTH, "url_hash"]) if exists(self.spark, corrections) else self.stored_processed()

    def retries(self) -> Generations:
        return Generations(self.spark, self.path("retry"), schemas.PRESS_RELEASES)

    def retry(self) -> DataFrame:
        """Releases that an enrichment run failed on, once each; those processed since are among them until the next closing."""
        return self.retries().rows()

    def attempts(self) -> Generations:
        return Generations(self.spark, self.path("attempt_log"), schemas.TRIES, schemas.TRIED)

    def nso(self) -> Generations:
        return Generations(self.spark, self.path("nso_log"), schemas.NSO_LOG, schemas.FIRST_SEEN)

    def nso_log(self) -> DataFrame:
        return self.nso().rows()

    def ff(self) -> Generations:
        return Generations(self.spark, self.path("ff_log"), schemas.FF_LOG, schemas.FIRST_SEEN)

    def ff_log(self) -> DataFrame:
        return self.ff().rows()

    def statuses(self) -> Generations:
        return Generations(self.spark, self.path("status"), schemas.STATUS)

    def status_log(self) -> DataFrame:
        return self.statuses().rows()

    def quarantine(self) -> DataFrame:
        return read(self.spark, self.path("quarantine"), schemas.QUARANTINE)


def content_name(rows: DataFrame, *columns: str) -> str:
    """Name of a batch's content: the same rows give the same name in any order, other rows another."""
    row = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}-{abs(int(row.h or 0)):x}{'n' if (row.h or 0) < 0 else ''}"


def with_month(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])


def month_of(stamp: Column) -> Column:
    return F.coalesce(F.date_format(stamp, "yyyy-MM"), F.lit(UNDATED))


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, empty until its first write."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("_ string").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def append_releases(rows: DataFrame, path: str, key: str = "url_hash") -> None:
    """Append to a release table laid out by month of publication and sorted by date inside its files.

    The range split also cuts a month, or the undated rows, that hold much of the batch.
    """
    dated = rows.withColumn(MONTH, month_of(F.col("published")))
    ranged = dated.repartitionByRange(MONTH, "published", key).sortWithinPartitions(MONTH, "published")
    ranged.write.mode("append").partitionBy(MONTH).parquet(path, compression=files.CODEC)


def write_run(rows: DataFrame, path: str, run: str, sort_by: list[str] | None = None) -> str:
    """One run's rows of a run table; the same run again replaces them."""
    target = f"{path}/run={run}"
    rows = rows.sortWithinPartitions(*sort_by) if sort_by else rows
    rows.write.mode("overwrite").parquet(target, compression=files.CODEC)
    return target


def stage(rows: DataFrame, store: Store, name: str, run: str) -> DataFrame:
    """Write rows that several later steps need and read them back, which also cuts the lineage."""
    return store.spark.read.schema(rows.schema).parquet(write_run(rows, store.path(f"stage/{name}"), run))


def stage_once(make: Callable[[], DataFrame], store: Store, name: str, run: str) -> DataFrame:
    """As ``stage``, but what the run has written to its end before is read and not made again."""
    target = f"{store.path(f'stage/{name}')}/run={run}"
    if not files.finished(store.spark, target):
        write_run(make(), store.path(f"stage/{name}"), run)
    return store.spark.read.parquet(target)


def quarantine(rows: DataFrame, store: Store, source: Column, seen_at: Column, name: str, run: str) -> None:
    """Faulty rows with their reason and raw text."""
    rejects = rows.where("fault is not null").select(
        source.alias("source"), F.col("fault").alias("reason"), F.col("raw"), seen_at.alias("seen_at")
    )
    write_run(rejects, store.path("quarantine"), f"{name}-{run}")
