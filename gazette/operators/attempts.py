"""Attempt ledger: how often a model failed on a release, and when it is due again.

The log has a row for every try. Folded, it has one for each release and model: the number of failures and the last of them. The
first retry is due at the next run; from the second failure on the delay doubles, and after ``max_tries`` failures the model
is not asked again. A release is given up when all models that were asked are.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["url_hash", "provider", "model"]


@dataclass(frozen=True)
class RetryPolicy:
    """``delay`` is the one after the second failure."""

    delay: dt.timedelta = dt.timedelta(hours=1)
    max_tries: int = 8


def failures(tries: DataFrame) -> DataFrame:
    """One row for each release and model that failed, in the form of the log: the last failure and the number of all."""
    number = F.coalesce("failures", F.lit(1).cast("bigint")) if "failures" in tries.columns else F.lit(1).cast("bigint")
    failed = tries.where("error IS NOT NULL").groupBy(*PAIR)
    return failed.agg(F.max("tried_at").alias("tried_at"), F.max_by("error", F.struct("tried_at", "error")).alias("error"), F.sum(number).alias("failures"))


def due_at(policy: RetryPolicy) -> Column:
    """When a model that failed is asked again; null if never."""
    seconds = F.when(F.col("failures") < 2, 0.0).otherwise(policy.delay.total_seconds() * F.pow(F.lit(2.0), F.col("failures") - 2))
    due = F.timestamp_seconds(F.unix_micros("tried_at") / 1e6 + F.least(seconds, F.lit(1e10)))
    return F.when(F.col("failures") < policy.max_tries, due)


def release_state(tries: DataFrame, now: Column, policy: RetryPolicy) -> DataFrame:
    """``url_hash, failures, waiting`` (models not to be asked now), ``due`` and ``given_up`` of every release with a failure."""
    each = failures(tries).withColumn("_due", due_at(policy))
    ready = F.coalesce(F.col("_due") <= now, F.lit(False))
    name = F.concat_ws("/", "provider", "model")
    return each.groupBy("url_hash").agg(
        F.sum("failures").alias("failures"), F.sort_array(F.collect_set(F.when(~ready, name))).alias("waiting"),
        F.max(ready).alias("due"), F.min(F.col("_due").isNull()).alias("given_up"),
    )
