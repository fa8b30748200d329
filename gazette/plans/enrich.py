"""Enrichment of pending releases and field backfill."""

from __future__ import annotations

import datetime as dt
from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.operators import enrich as op
from gazette.operators.attempts import RetryPolicy, failures, release_state
from gazette.operators.dedup import first_writer
from gazette.operators.status import attempt_totals
from gazette.operators.upsert import set_field
from gazette.plans.ingest import mark
from gazette.schemas import PRESS_RELEASES, PROCESSED
from gazette.sources.config import EXTRACTION_DOMAINS, EXTRACTION_TEXTS
from gazette.sources.files import finished
from gazette.sources.tables import MONTH, Store, append_releases, content_name, quarantine, stage, stage_once, write_run

#: Lanes in which open rows are numbered; a batch takes some numbers of each.
DRAIN_LANES = 16
#: Rows that one job of a drain translates, at least a batch: its batches run side by side.
DRAIN_ROWS = 100_000


def enrich(
    store: Store, pages: DataFrame, extract: op.Extractor, run: str, run_ts: dt.datetime, limit: int | None = None,
    domains: dict[str, list[str]] = EXTRACTION_DOMAINS, max_chars: int = 4000, among: DataFrame | None = None,
    captured: str | None = None, parallelism: int | None = None, policy: RetryPolicy = RetryPolicy(),
) -> DataFrame:
    """Process pending releases: all of them, or the oldest ``limit`` as a cost cap for the model.

    Pending keys are staged first: their size is then known, and whole rows are fetched by a broadcast of the keys while
    they are few. Each pending row gets one attempt per run, if ``policy`` does not make it wait. A run over ``among`` alone also
    takes the rows that earlier runs failed on and that are due again. Prompts carry the models that are not to be asked (``waiting``).

    The run's folders are named by the pending keys and their failures so far. Attempts are staged before use, and a run that is
    repeated because it broke off later reads them again: answers already paid for survive. The ledger of attempts is written last.
    ``captured`` orders the captures of a page; ``parallelism`` is the number of tasks that call the model. Returns one row: attempted, processed, failed.
    """
    now, index = F.lit(run_ts).cast("timestamp"), store.processed_keys()
    index.ensure(store.stored_processed, "url_hash")
    state = release_state(store.attempts().rows(), now, policy) if store.attempts().runs() or store.attempts().closed() else None
    raw = store.press_releases().drop(MONTH)
    if among is not None:
        raw = first_writer(among.select(*PRESS_RELEASES.names).unionByName(store.retry()) if state is not None else among.select(*PRESS_RELEASES.names), "url_hash", "ingest_seq")
    named = raw.select("url_hash", "ingest_seq").withColumns({"failures": F.lit(0).cast("bigint"), "waiting": F.array().cast("array<string>")})
    if state is not None:
        known = state.select("url_hash", F.col("failures").alias("_failures"), F.col("waiting").alias("_waiting"), "due")
        named = named.join(known, "url_hash", "left").where("coalesce(due, true)").select(
            "url_hash", "ingest_seq", F.coalesce("_failures", "failures").alias("failures"), F.coalesce("_waiting", "waiting").alias("waiting"))
    if among is None:
        named = op.pending(named, store.stored_processed())
        named = named.orderBy("ingest_seq").limit(limit) if limit is not None else named
    else:
        named = index.absent(stage(named, store, "among", f"{run}-{uuid4().hex}"), "url_hash")
    keys = stage(named.drop("ingest_seq"), store, "pending_keys", f"{run}-{uuid4().hex}")
    run = f"{run}-{content_name(keys, 'url_hash', 'failures')}"
    todo = stage(raw.join(keys.select("url_hash"), "url_hash", "left_semi"), store, "pending", run)
    prompts = op.with_prompt(todo, pages, max_chars, captured).select("url_hash", "prompt").join(keys.select("url_hash", "waiting"), "url_hash")
    prompts = prompts.repartition(parallelism, "url_hash") if parallelism else prompts
    attempts = stage_once(lambda: extract(prompts), store, "attempts", run)
    chosen = stage(op.choose_answers(attempts, domains, EXTRACTION_TEXTS), store, "chosen", run)
    rows = op.assemble(todo, chosen, now).select(*PROCESSED.names)
    index.insert(
        rows, "url_hash", "processed_at", run, store.stored_processed, lambda some, name: stage(some, store, f"processed_{name}", run),
        lambda some: append_releases(some, store.path("processed")),
    )
    failed = todo.join(chosen.where("chosen IS NOT NULL"), "url_hash", "left_anti").select(*PRESS_RELEASES.names)
    write_run(failed.join(store.retry().select("url_hash"), "url_hash", "left_anti"), store.path("retry"), run)
    error = F.coalesce("error", op.answer_fault(F.col("answer"), domains, EXTRACTION_TEXTS))
    tries = attempts.select("url_hash", "provider", "model", now.alias("tried_at"), error.alias("error"))
    before = store.attempts().rows().join(keys.where("failures > 0").select("url_hash"), "url_hash", "left_semi")
    gone = release_state(before.unionByName(tries, allowMissingColumns=True), now, policy).where("given_up").select("url_hash", "given_up")
    faults = chosen.where("chosen IS NULL").join(gone, "url_hash", "left").select("url_hash", F.concat(F.when(F.col("given_up"), "gave_up:").otherwise(""), "fault").alias("fault"))
    rejects = faults.join(todo.select("url_hash", "url"), "url_hash").select("fault", F.col("url").alias("raw"))
    quarantine(rejects, store, F.lit("extraction"), now, "extraction", run)
    totals = stage(attempt_totals(chosen), store, "totals", run)
    write_run(tries, store.path("attempt_log"), run)
    return totals


def close_attempts(store: Store, run_ts: dt.datetime, policy: RetryPolicy = RetryPolicy()) -> None:
    """Fold the attempt ledger, and the table of failed releases less those that were processed since or given up."""
    open_rows = store.processed_keys()

    def unfinished(rows: DataFrame) -> DataFrame:
        state = release_state(store.attempts().rows(), F.lit(run_ts).cast("timestamp"), policy)
        left = open_rows.absent(rows, "url_hash").join(state.where("given_up").select("url_hash"), "url_hash", "left_anti")
        return first_writer(left, "url_hash", "ingest_seq")

    store.retries().close(unfinished)
    store.attempts().close(failures)


def translations(missing: DataFrame, extract: op.Extractor) -> DataFrame:
    """``url_hash`` and ``title_en`` of the rows for which a translation came back that is not blank."""
    attempts = extract(missing.select("url_hash", op.title_prompt(F.col("title")).alias("prompt")))
    title = F.trim(F.col("answer.title_en"))
    valid = F.col("error").isNull() & (title != "")
    return op.first_success(attempts, "url_hash", "rank", valid, title).withColumnRenamed("answer", "title_en").where("title_en IS NOT NULL")


def untitled(processed: DataFrame) -> DataFrame:
    """Rows without an English title whose own title is not blank."""
    return processed.where(F.col("title_en").isNull() & (F.trim("title") != ""))


def backfill_titles(processed: DataFrame, extract: op.Extractor, run_ts: dt.datetime) -> DataFrame:
    """Processed table with ``title_en`` set where it was missing and a translation came back.

    All missing rows go in one plan; blank titles are skipped and failed rows stay as they are. ``extract`` returns
    attempts whose answer has ``title_en``.
    """
    return set_field(processed, translations(untitled(processed), extract), "url_hash", "title_en", F.lit(run_ts).cast("timestamp"))


def drain_titles(store: Store, extract: op.Extractor, run: str, run_ts: dt.datetime, batch_size: int | None = None) -> DataFrame:
    """Translate the missing titles of stored releases, batch by batch, until every open row had its turn, and record the run.

    The open keys are staged once, numbered; a batch is a range of numbers, so a row that fails is not tried twice in a drain, and
    stays open for the next. Small batches go side by side in one job, so that jobs and folders do not grow with their number.
    Translations are corrections: appended by run and month, merged when the table is read. A drain of the same ``run`` over the
    same open rows is one that broke off: batches that it has written are not asked for again, nor those whose answers are staged.
    Returns one row: open, translated, batches.
    """
    open_rows = untitled(store.processed()).select("url_hash", "title", MONTH)
    run = f"{run}-{content_name(open_rows, 'url_hash')}"
    numbered = open_rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("url_hash"), F.lit(DRAIN_LANES))).orderBy("url_hash")))
    todo = stage(numbered, store, "untitled", run)
    total, highest = todo.agg(F.count("*"), F.max("_n")).first()
    step = highest or 0 if batch_size is None else max(1, batch_size // DRAIN_LANES)
    batches = range(1, (highest or 0) + 1, step) if total else []
    jobs = range(1, (highest or 0) + 1, step * max(1, DRAIN_ROWS // (step * DRAIN_LANES))) if total else []
    for first in jobs:
        past = first + jobs.step
        name = f"{run}-{first}-{past - 1}"
        if finished(store.spark, f"{store.path('corrections')}/run={name}"):
            continue
        some = todo.where(F.col("_n").between(first, past - 1))
        found = stage_once(lambda some=some: translations(some, extract), store, "translations", name)
        rows = found.join(some, "url_hash").select("url_hash", F.lit("title_en").alias("field"), F.col("title_en").alias("value"), F.lit(run_ts).cast("timestamp").alias("set_at"), MONTH)
        rows.repartition(MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(f"{store.path('corrections')}/run={name}")
    done = store.corrections().where((F.col("set_at") == F.lit(run_ts).cast("timestamp")) & (F.col("field") == "title_en")).join(todo.select("url_hash"), "url_hash", "left_semi")
    result = stage(done.agg(F.lit(total).cast("bigint").alias("open"), F.count("*").alias("translated"), F.lit(len(batches)).alias("batches")), store, "drained", run)
    mark(store, "titles", result.withColumn("errors", F.lit(0)), "translated", "titles translated", "title", run, run_ts)
    return result
