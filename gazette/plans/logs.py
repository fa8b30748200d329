"""Upkeep of a store: generations of its logs, and fewer files."""

from __future__ import annotations

import datetime as dt

from gazette import schemas
from gazette.operators.attempts import RetryPolicy
from gazette.operators.dedup import first_writer
from gazette.operators.upsert import compact
from gazette.plans.enrich import close_attempts
from gazette.sources import files
from gazette.sources.tables import Store


def close_logs(store: Store) -> dict[str, int | None]:
    """Fold what runs have written since the last time: calendar logs to a row for each key, the status log to one file.

    The number of the generation of each log that got one. Old folders are left to ``Generations.vacuum``, so that readers that
    have begun are not disturbed.
    """
    key = schemas.CALENDAR_KEY

    def payload(names: list[str]) -> list[str]:
        return [name for name in names if name not in key]

    return {
        "nso_log": store.nso().close(lambda rows: compact(rows, key, payload(schemas.NSO_PAYLOAD)), ["release_dt"]),
        "ff_log": store.ff().close(lambda rows: compact(rows, key, payload(schemas.FF_PAYLOAD), schemas.FF_STICKY), ["release_dt"]),
        "status": store.statuses().close(lambda rows: first_writer(rows, schemas.STATUS.names, "last_run"), ["last_run"]),
    }


def maintain(store: Store, run_ts: dt.datetime, policy: RetryPolicy = RetryPolicy()) -> None:
    """What keeps the folders of a store few: generations of all logs, the ledger of attempts, old runs and staged steps removed, indexes merged.

    To be run now and then, such as once a day, while no job writes. Staged answers of models stay, as a run that broke off reads them.
    """
    close_logs(store)
    close_attempts(store, run_ts, policy)
    for log in (store.nso(), store.ff(), store.statuses(), store.retries(), store.attempts()):
        log.vacuum()
    for name in files.children(store.spark, store.path("stage")):
        if name != "attempts":
            files.remove(store.spark, f"{store.path('stage')}/{name}")
    for index in (store.release_keys(), store.processed_keys(), store.bodies()):
        index.compact()
