"""Keyed upserts as views over an append-only change log.

A log row carries ``seen_at`` and ``batch_ord``; together they order the writes of a key. The view keeps the latest
payload, the first sighting and the last update. All aggregates combine on the map side, so a hot key is safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import blank_to_null

ORDER = ("seen_at", "batch_ord")


def _order(columns: Sequence[str]) -> Column:
    return F.struct(*columns) if len(columns) > 1 else F.col(columns[0])


def _seen(log: DataFrame, seen: str) -> tuple[Column, Column]:
    first = F.coalesce("first_seen", seen) if "first_seen" in log.columns else F.col(seen)
    return F.min(first).alias("first_seen"), F.max(seen).alias("updated_at")


def latest(
    log: DataFrame, key: str | list[str], payload: Sequence[str], sticky: Sequence[str] = (),
    order: Sequence[str] = ORDER, seen: str = "seen_at",
) -> DataFrame:
    """Current state per key.

    ``payload`` columns take the last write, nulls included. ``sticky`` columns keep the last value that is neither
    null nor empty.
    """
    key = [key] if isinstance(key, str) else key
    by = _order(order)
    last = F.max_by(F.struct(*payload), by).alias("_last")
    kept = [
        F.max_by(name, F.when(F.col(name).isNotNull() & (F.col(name).cast("string") != ""), by)).alias(name)
        for name in sticky
    ]
    state = log.groupBy(*key).agg(last, *kept, *_seen(log, seen))
    return state.select(*key, *[F.col(f"_last.{name}").alias(name) for name in payload], *sticky, "first_seen", "updated_at")


def upsert_counts(stored: DataFrame, batch: DataFrame, key: str, payload: Sequence[str], sticky: Sequence[str] = ()) -> DataFrame:
    """One row: inserted, updated, unchanged, written (all three).

    ``batch`` is a log; its last write per key is compared with the stored state, a sticky null or blank counting as
    unchanged.
    """
    state = latest(batch, key, payload, sticky)
    old = stored.select(key, F.struct(*payload).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in sticky], F.lit(True).alias("_known"))
    joined = state.join(old, key, "left")
    same = F.struct(*payload).eqNullSafe(F.col("_old"))
    for name in sticky:
        same = same & (F.col(name).isNull() | F.col(name).eqNullSafe(F.col(f"_old_{name}")))
    known = F.col("_known").isNotNull()
    return joined.agg(
        F.count_if(~known).alias("inserted"), F.count_if(known & ~same).alias("updated"),
        F.count_if(known & same).alias("unchanged"), F.count("*").alias("written"),
    )


def compact(log: DataFrame, key: str, payload: Sequence[str], sticky: Sequence[str] = ()) -> DataFrame:
    """Log rows up to a closed batch as one row per key, to be read together with the newer log rows.

    The snapshot has the log's columns plus ``first_seen``; write it to a new folder and switch readers over.
    """
    key_list = [key] if isinstance(key, str) else key
    last = F.max_by(F.struct(*payload, *ORDER), _order(ORDER)).alias("_last")
    kept = [
        F.max_by(name, F.when(blank_to_null(F.col(name)).isNotNull(), _order(ORDER))).alias(name) for name in sticky
    ]
    state = log.groupBy(*key_list).agg(last, *kept, _seen(log, "seen_at")[0])
    return state.select(
        *key_list, *[F.col(f"_last.{name}").alias(name) for name in payload], *sticky,
        *[F.col(f"_last.{name}").alias(name) for name in ORDER], "first_seen",
    )


def set_field(table: DataFrame, values: DataFrame, key: str, field: str, run_ts: Column) -> DataFrame:
    """Set one field by key where a non-blank value came back; ``updated_at`` moves only on those rows.

    ``values`` has (key, field) and one row per key.
    """
    new = values.where(F.trim(field) != "").select(key, F.trim(field).alias("_new"))
    joined = table.join(new, key, "left")
    changed = F.col("_new").isNotNull()
    replaced = {
        field: F.coalesce("_new", field),
        "updated_at": F.when(changed, run_ts).otherwise(F.col("updated_at")),
    }
    return joined.select(*[replaced[name].alias(name) if name in replaced else F.col(name) for name in table.columns])


def corrected(table: DataFrame, corrections: DataFrame, key: list[str], stamp: str = "updated_at") -> DataFrame:
    """A table under its correction log: the last value of each field wins, ``stamp`` is the time of the last one.

    ``corrections`` has the key, ``field``, ``value`` and ``set_at``. The key has the layout column, so a filter on it prunes both
    sides; fields of the table that the log never names cost nothing but a null.
    """
    skip = {*key, stamp}
    fields = [name for name, kind in table.dtypes if kind == "string" and name not in skip]
    last = [F.max_by("value", F.when(F.col("field") == name, F.struct("set_at", "value"))).alias(f"_new_{name}") for name in fields]
    latest_values = corrections.groupBy(*key).agg(*last, F.max("set_at").alias("_set_at"))
    joined = table.join(latest_values, key, "left")
    new = {name: F.coalesce(f"_new_{name}", name) for name in fields} | {stamp: F.coalesce("_set_at", stamp)}
    return joined.select(*[new[name].alias(name) if name in new else F.col(name) for name in table.columns])
