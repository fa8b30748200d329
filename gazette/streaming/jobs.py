"""The pipelines as streams over file folders.

Each micro-batch runs the batch job's function inside ``foreachBatch``. Writes are keyed or one folder per run, so a
batch that is replayed after a failure, or after a lost checkpoint, changes nothing. History is kept in the tables and
not in stream state, which therefore does not grow.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gazette import schemas
from gazette.operators import enrich as op
from gazette.operators.attempts import RetryPolicy
from gazette.plans import collect as calendar_plan
from gazette.plans.enrich import enrich
from gazette.plans.ingest import ingest
from gazette.sources.files import CODEC
from gazette.sources.keyindex import KeyIndex
from gazette.sources.tables import Store, content_name, read, with_month, write_run

Clock = Callable[[], dt.datetime]


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def start(writer: DataStreamWriter, checkpoint: str, every: str | None) -> object:
    """``every`` such as ``5 minutes``; without it, what is there is processed and the stream ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest_stream(
    spark: SparkSession, landing: str, load_feeds: Callable[[], DataFrame], store: Store, checkpoint: str,
    every: str | None = None, max_files: int | None = None, clock: Clock = utc_now,
):
    """Feed poll: new landing files become press releases. The feed list is read again for each batch."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        ingest(rows, load_feeds(), store, "stream", clock())

    source = file_stream(spark, landing, schemas.LANDING_FEED, max_files)
    return start(source.writeStream.foreachBatch(batch), checkpoint, every)


def enrich_stream(
    spark: SparkSession, store: Store, load_pages: Callable[[], DataFrame], extract: op.Extractor, checkpoint: str,
    every: str | None = None, max_files: int | None = None, clock: Clock = utc_now, parallelism: int | None = None,
    policy: RetryPolicy = RetryPolicy(),
):
    """Incremental processing: each batch holds the releases of new files and those that failed before and are due, so old history is
    not scanned for work. Failed releases are tried at the start as well, when there may be no new file.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        enrich(store, load_pages(), extract, "stream", clock(), among=rows, parallelism=parallelism, policy=policy)

    if store.retries().runs() and not op.pending(store.retry().select("url_hash"), store.stored_processed()).isEmpty():
        enrich(store, load_pages(), extract, "retry", clock(), among=store.retry(), parallelism=parallelism, policy=policy)

    source = file_stream(spark, store.path("press_releases"), with_month(schemas.PRESS_RELEASES), max_files)
    return start(source.writeStream.foreachBatch(batch), checkpoint, every)


def collect_stream(
    spark: SparkSession, landing: str, store: Store, checkpoint: str, every: str | None = None,
    max_files: int | None = None, clock: Clock = utc_now,
):
    """Calendar collection over a landing folder.

    A micro-batch is not pruned by source, as a stored landing is, so it is staged by source while the collectors read it.
    Its run is named by its content alone, so that a stream with a new checkpoint adds to the logs.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        folder = f"{store.path('stage/landing')}/run=stream-{batch_id}"
        rows.write.mode("overwrite").partitionBy("source").parquet(folder, compression=CODEC)
        kept = spark.read.schema(schemas.LANDING_CALENDAR).parquet(folder).select(*schemas.LANDING_CALENDAR.names)
        calendar_plan.collect_once(kept, store, "stream", clock())

    source = file_stream(spark, landing, schemas.LANDING_CALENDAR, max_files)
    return start(source.writeStream.foreachBatch(batch), checkpoint, every)


def dedup_stream(source: DataFrame, target: str, key: str, order: str, checkpoint: str, every: str | None = None, digits: int = 1):
    """Insert-if-absent of any keyed stream into a Parquet folder, by a key index beside it."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        index, run = KeyIndex(spark, f"{target}.keys", digits=digits), content_name(rows, key, order)

        def staged(some: DataFrame, name: str) -> DataFrame:
            return spark.read.schema(some.schema).parquet(write_run(some, f"{target}.stage/{name}", run))

        index.insert(rows, key, order, run, lambda: read(spark, target, rows.schema), staged, lambda some: some.write.mode("append").parquet(target))

    return start(source.writeStream.foreachBatch(batch), checkpoint, every)


def horizon_dedup(source: DataFrame, key: str, stamp: str, horizon: str) -> DataFrame:
    """Dedup with bounded state, for feeds whose repeats come within ``horizon`` of each other."""
    return source.withWatermark(stamp, horizon).dropDuplicatesWithinWatermark([key])


def latest_stream(log: DataFrame, key: str, last: str, payload: list[str]) -> DataFrame:
    """Change feed of the latest row per key; use with the update output mode."""
    row = F.max_by(F.struct(*payload), F.struct(last, *payload))
    latest = log.groupBy(key).agg(F.max(last).alias(last), row.alias("_last"))
    return latest.select(key, last, *[F.col(f"_last.{name}").alias(name) for name in payload])


def status_stream(spark: SparkSession, store: Store, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Live status: whenever a pipeline records a run, its latest row goes to the sink."""
    log = file_stream(spark, store.path("status"), schemas.STATUS)
    latest = latest_stream(log, "key", "last_run", ["status", "details"])
    return start(latest.writeStream.outputMode("update").foreachBatch(sink), checkpoint, every)




def changes_stream(log: DataFrame, key: str = "key", stamp: str = "last_run", payload: tuple[str, ...] = ("status", "details")) -> DataFrame:
    """Change feed of real changes: a row of the log goes out if its payload differs from the last one that did for its key.

    State is one row for each key. Rows of a batch are looked at in the order of their stamps; one that is older than the last that
    went out is late and does not. Use with the append output mode.
    """
    kinds = {field.name: field for field in log.schema.fields}
    schema = T.StructType([kinds[name] for name in (key, stamp, *payload)])
    state = T.StructType([kinds[name] for name in (stamp, *payload)])

    def changes(group: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([stamp, *payload], kind="stable")
        last, out = kept.get if kept.exists else None, []
        for row in rows[[stamp, *payload]].itertuples(index=False, name=None):
            row = tuple(None if pd.isna(one) else one.to_pydatetime() if isinstance(one, pd.Timestamp) else one for one in row)
            if last is None or (row[0] >= last[0] and row[1:] != tuple(last[1:])):
                out.append((group[0], *row))
                last = row
        kept.update(tuple(last))
        yield pd.DataFrame(out, columns=schema.names)

    return log.groupBy(key).applyInPandasWithState(changes, schema, state, "append", GroupStateTimeout.NoTimeout)


def status_changes(spark: SparkSession, store: Store, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, max_files: int | None = None):
    """Live status without repetitions: a pipeline's status goes to the sink when it is another than before."""
    feed = changes_stream(file_stream(spark, store.path("status"), schemas.STATUS, max_files))
    return start(feed.writeStream.outputMode("append").foreachBatch(sink), checkpoint, every)
