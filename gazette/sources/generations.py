"""Generations of a run table: numbered snapshots, and the runs that came after.

A run table has a folder for each run. Closing folds the newest generation and all finished runs into a snapshot, and then
writes its marker: one file, moved to its place by one rename, that names the runs inside. Readers take the generation of
the newest marker and the runs it does not name. Until the marker is there they read what they read before, so a failure at
any point loses nothing and the next closing starts over. A run that is repeated after it was folded writes what the
snapshot already has, and stays named.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.schemas import struct
from gazette.sources import files

MARKER = struct("run string")
Fold = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Generations:
    """``schema`` is that of a run; snapshots may have the columns ``more`` besides, which are null in runs."""

    spark: SparkSession
    path: str
    schema: T.StructType
    more: T.StructType = T.StructType()

    def marker(self, number: int) -> str:
        return f"{self.path}.closed/generation={number:08d}"

    def snapshot(self, number: int) -> str:
        return f"{self.path}.snapshots/generation={number:08d}"

    def closed(self) -> list[int]:
        names = files.children(self.spark, f"{self.path}.closed")
        numbers = [int(name.removeprefix("generation=")) for name in names if name.startswith("generation=")]
        return [one for one in sorted(numbers) if files.finished(self.spark, self.marker(one))]

    def runs(self) -> list[str]:
        """Runs that are written to their end."""
        names = [name.removeprefix("run=") for name in files.children(self.spark, self.path) if name.startswith("run=")]
        return [name for name in names if files.finished(self.spark, f"{self.path}/run={name}")]

    def folded(self, number: int) -> set[str]:
        return {row.run for row in self.spark.read.schema(MARKER).parquet(self.marker(number)).collect()}

    def later(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/run={run}" for run in runs]).select(*self.schema.names)

    def rows(self, runs: list[str] | None = None) -> DataFrame:
        """The newest closed generation, and the runs after it."""
        numbers, runs = self.closed(), self.runs() if runs is None else runs
        if not numbers:
            rest = self.later(runs)
            return rest.select("*", *[F.lit(None).cast(one.dataType).alias(one.name) for one in self.more.fields])
        inside = self.folded(numbers[-1])
        whole = T.StructType([*self.schema.fields, *self.more.fields])
        snapshot = self.spark.read.schema(whole).parquet(self.snapshot(numbers[-1])).select(*whole.names)
        rest = [run for run in runs if run not in inside]
        return snapshot.unionByName(self.later(rest), allowMissingColumns=True) if rest else snapshot

    def close(self, fold: Fold, sort_by: list[str] | None = None) -> int | None:
        """Close a generation over all finished runs; its number, or None if no run came since the last one."""
        numbers, runs = self.closed(), self.runs()
        inside = self.folded(numbers[-1]) if numbers else set()
        if set(runs) <= inside:
            return None
        number = numbers[-1] + 1 if numbers else 1
        folded = fold(self.rows(runs)).select(*self.schema.names, *self.more.names)
        folded = folded.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else folded
        folded.write.mode("overwrite").parquet(self.snapshot(number))
        names = self.spark.createDataFrame([(one,) for one in runs], MARKER).coalesce(1)
        names.write.mode("overwrite").parquet(self.marker(number))
        return number

    def vacuum(self) -> int:
        """Remove runs that the last generation but one has folded, and older generations; the number of folders that went.

        Readers of the newest generation and of the one before it are not disturbed.
        """
        numbers = self.closed()
        if len(numbers) < 2:
            return 0
        gone = [f"{self.path}/run={run}" for run in self.folded(numbers[-2])]
        gone += [place for one in numbers[:-2] for place in (self.snapshot(one), self.marker(one))]
        gone = [one for one in gone if files.exists(self.spark, one)]
        for one in gone:
            files.remove(self.spark, one)
        return len(gone)
