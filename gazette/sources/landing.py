"""Helpers every parse job shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pin(rows: DataFrame, column: str) -> DataFrame:
    """Fix a computed column, so that a later filter on it is not copied into every step that computes it.

    Filters do not move below the generator that makes the column, here a one-element explode.
    """
    return rows.select(*[
        F.explode(F.array(column)).alias(column) if name == column else F.col(f"`{name}`") for name in rows.columns
    ])
