"""Keys of a large table, in folders by a prefix of their hash.

A batch is compared with the folders of its own prefixes alone, whatever the table's history holds: the cost of a poll follows
the batch. Prefixes are at most ``16 ** digits`` short strings, so their list may pass through the driver; it prunes the folders
before anything is read.

A key is added with the name of the run that brought it. Names are made from a run's content, so a run that is repeated after
a failure finds its own keys and does not count them as known; what it then appends is compared with the table itself. Keys go
into the index before rows go into the table: a failure between the two is mended by the repeated run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.operators.dedup import absent_from_large, first_writer
from gazette.sources import files

PREFIX, RUN, KEY = "prefix", "run", "index_key"


def prefix_of(key: Column, digits: int) -> Column:
    """Of a hash of the key, so that keys of any kind spread evenly."""
    return F.substring(F.lower(F.hex(F.xxhash64(key.cast("string")))), -digits, digits)


@dataclass(frozen=True)
class KeyIndex:
    """``payload`` are further columns kept with a key. ``digits`` is the length of the prefixes, for all the index's life: a batch reads
    about its number of keys over ``16 ** digits`` of the index, so tables of billions of keys want three or four.
    """

    spark: SparkSession
    path: str
    payload: T.StructType = T.StructType()
    digits: int = 2

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(KEY, T.StringType()), *self.payload.fields, T.StructField(RUN, T.StringType()), T.StructField(PREFIX, T.StringType())])

    def folders(self) -> list[str]:
        return [one.removeprefix(f"{PREFIX}=") for one in files.children(self.spark, self.path) if one.startswith(f"{PREFIX}=")]

    def rows(self, prefixes: list[str] | None = None) -> DataFrame:
        """Entries of all folders, or of some: the others are not even listed."""
        there = self.folders() if prefixes is None else [one for one in prefixes if files.exists(self.spark, f"{self.path}/{PREFIX}={one}")]
        if not there:
            return self.spark.createDataFrame([], self.schema())
        reader = self.spark.read.schema(self.schema()).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/{PREFIX}={one}" for one in sorted(there)]).select(*self.schema().names)

    def matching(self, batch: DataFrame, key: str) -> DataFrame:
        """Entries of the batch's keys, from the folders of its prefixes."""
        if not files.exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema()).drop(PREFIX)
        prefixes = [row[0] for row in batch.select(prefix_of(F.col(key), self.digits)).distinct().collect()]
        entries = self.rows(prefixes)
        return entries.join(batch.select(F.col(key).cast("string").alias(KEY)).distinct(), KEY, "left_semi").drop(PREFIX)

    def add(self, rows: DataFrame, key: str, run: str) -> None:
        """Append keys with their payload; in one task's hands per folder, so that a batch adds a file to a folder at most."""
        entries = rows.select(F.col(key).cast("string").alias(KEY), *self.payload.names, F.lit(run).alias(RUN), prefix_of(F.col(key), self.digits).alias(PREFIX))
        entries.repartition(PREFIX).write.mode("append").partitionBy(PREFIX).parquet(self.path, compression=files.CODEC)

    def absent(self, batch: DataFrame, key: str, run: str | None = None) -> DataFrame:
        """Rows of the batch whose key no other run has brought."""
        known = self.matching(batch, key)
        known = known if run is None else known.where(F.col(RUN) != run)
        return batch.join(known.select(F.col(KEY).alias(key)).distinct(), key, "left_anti")

    def ensure(self, stored: Callable[[], DataFrame], key: str) -> None:
        """Fill an index that does not exist yet from its table."""
        if not files.exists(self.spark, self.path):
            history = stored().select(key).distinct()
            if history.head(1):
                self.add(history.select(key, *[F.lit(None).cast(one.dataType).alias(one.name) for one in self.payload.fields]), key, "history")

    def insert(
        self, batch: DataFrame, key: str, order: str | list[str], run: str, stored: Callable[[], DataFrame],
        stage: Callable[[DataFrame, str], DataFrame], append: Callable[[DataFrame], None],
    ) -> DataFrame:
        """First writer wins, and only keys that are new are appended; the rows that were.

        ``stage`` writes a step and reads it back, where no key is known the first writers alone; ``stored`` is the table, which is asked only by a run that has been here before,
        or to fill an index that does not exist yet.
        """
        self.ensure(stored, key)
        firsts = stage(first_writer(batch, key, order), "firsts")
        known = stage(self.matching(firsts, key).select(F.col(KEY).alias(key), RUN), "known")
        if known.head(1):
            fresh = firsts.join(known.where(F.col(RUN) != run).select(key).distinct(), key, "left_anti")
            if known.where(F.col(RUN) == run).head(1):
                fresh = absent_from_large(fresh, stored(), key)
            fresh = stage(fresh, "fresh")
        else:
            fresh = firsts
        self.add(fresh.select(key, *[one.name for one in self.payload.fields]), key, run)
        append(fresh)
        return fresh

    def compact(self, prefixes: list[str] | None = None) -> None:
        """Rewrite folders that many batches have added to as one file each, a key's entries of all runs but the first dropped.

        For a time when nothing is added. The merged file is there before the old ones go: at any moment every key is in the index.
        """
        for prefix in prefixes or self.folders():
            folder = f"{self.path}/{PREFIX}={prefix}"
            old = [one for one in files.children(self.spark, folder) if one.endswith(".parquet")]
            if len(old) < 2:
                continue
            merged = first_writer(self.rows([prefix]), KEY, RUN).drop(PREFIX).coalesce(1)
            merged.write.mode("append").parquet(folder, compression=files.CODEC)
            for one in old:
                files.remove(self.spark, f"{folder}/{one}")
