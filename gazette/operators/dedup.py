"""First-writer-wins dedup and insert-if-absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_writer(rows: DataFrame, key: str | list[str], order: str | list[str | Column]) -> DataFrame:
    """The first row of each key in arrival order.

    Spark cuts each map partition to one row per key before the shuffle (WindowGroupLimit), so a key that holds a
    third of all rows costs one row per map task after it.
    """
    key = [key] if isinstance(key, str) else key
    order = [order] if isinstance(order, str) else order
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_distinct(rows: DataFrame, order: str | list[str]) -> DataFrame:
    """First (title, time) of each calendar source."""
    return first_writer(rows, ["source", "title", "release_dt"], order)


def insert_if_absent(batch: DataFrame, stored: DataFrame, key: str, order: str | list[str]) -> DataFrame:
    """Rows of the batch to append: first writer inside the batch, nothing the table already holds.

    Only the key column of the table is read.
    """
    return first_writer(batch, key, order).join(stored.select(key), key, "left_anti")


def absent_from_large(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The same anti join for a small materialised batch against a very large table.

    The stored keys are first cut to those the batch holds. When the planner knows the batch to be below the broadcast
    threshold, the table is scanned once and never shuffled; otherwise both joins are ordinary shuffled ones.
    """
    hits = stored.select(key).join(batch.select(key), key, "left_semi")
    return batch.join(hits, key, "left_anti")


def insert_summary(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row (inserted, skipped), duplicates counted exactly.

    Both sides are counted per key in one aggregation, which combines on the map side: one shuffle and no join.
    """
    sides = batch.select(key, F.lit(1).alias("_new"), F.lit(0).alias("_old")).unionByName(
        stored.select(key, F.lit(0).alias("_new"), F.lit(1).alias("_old"))
    )
    sizes = sides.groupBy(key).agg(F.sum("_new").alias("_new"), F.max("_old").alias("_old"))
    inserted = F.count_if((F.col("_new") > 0) & (F.col("_old") == 0))
    return sizes.agg(inserted.alias("inserted"), (F.coalesce(F.sum("_new"), F.lit(0)) - inserted).alias("skipped"))


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    """Contract check: keys that occur more than once."""
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
