"""Folders of the stored tables, through the file system that Spark itself reads them by."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Of stored tables and staged steps. Keys are hexadecimal digests, which Snappy leaves at full length and Zstandard halves.
CODEC = "zstd"


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    place, system = _system(spark, path)
    return sorted(one.getPath().getName() for one in system.listStatus(place)) if system.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _system(spark, path)
    return system.exists(place)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has written this folder to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    place, system = _system(spark, path)
    system.delete(place, True)
