"""Pending rows, prompts, extractors, validation and assembly."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette import schemas
from gazette.functions import htmltext, text

Extractor = Callable[[DataFrame], DataFrame]
"""(url_hash, prompt) rows to attempts (url_hash, provider, model, rank, answer, error)."""

ATTEMPTS = T.StructType(
    [schemas.ANSWERS["url_hash"], schemas.ANSWERS["provider"], schemas.ANSWERS["model"],
     T.StructField("rank", T.IntegerType()), schemas.ANSWERS["answer"], schemas.ANSWERS["error"]]
)


def pending(raw: DataFrame, processed: DataFrame, key: str = "url_hash") -> DataFrame:
    """Raw rows not yet processed; all of them are considered."""
    return raw.join(processed.select(key), key, "left_anti")


def pending_keys(
    raw: DataFrame, processed: DataFrame, limit: int | None = None, key: str = "url_hash", order: str = "ingest_seq"
) -> DataFrame:
    """Keys of the pending rows, or of the oldest ``limit``: only key and order columns are read and shuffled."""
    keys = pending(raw.select(key, order), processed, key)
    return (keys.orderBy(order).limit(limit) if limit is not None else keys).select(key)


def first_pending(raw: DataFrame, processed: DataFrame, limit: int, key: str = "url_hash", order: str = "ingest_seq") -> DataFrame:
    """The oldest ``limit`` pending rows; whole rows are fetched for the chosen keys only."""
    return raw.join(pending_keys(raw, processed, limit, key, order), key, "left_semi").orderBy(order).limit(limit)


def backlog(raw: DataFrame, processed: DataFrame, key: str = "url_hash") -> DataFrame:
    """One row: raw, processed and pending counts, from one aggregation per key without a join."""
    sides = raw.select(key, F.lit(1).alias("_raw"), F.lit(0).alias("_done")).unionByName(
        processed.select(key, F.lit(0).alias("_raw"), F.lit(1).alias("_done"))
    )
    keys = sides.groupBy(key).agg(F.sum("_raw").alias("_raw"), F.max("_done").alias("_done"))
    counts = {"raw": "sum(_raw)", "processed": "sum(_done)", "pending": "sum(if(_done = 0, _raw, 0))"}
    return keys.agg(*[F.expr(f"CAST(coalesce({total}, 0) AS BIGINT) AS {name}") for name, total in counts.items()])


def page_texts(pages: DataFrame, max_chars: int = 4000) -> DataFrame:
    """Main text per page url, cut for the prompt."""
    texts = htmltext.with_main_text(pages.select("url", "html"), "html", "page_text")
    return texts.select("url", text.truncate(F.col("page_text"), max_chars).alias("page_text"))


def one_capture(pages: DataFrame, captured: str | None = None) -> DataFrame:
    """One page body per url: the newest by the ``captured`` column, or that of the greatest hash where captures have no time.

    Choosing moves hashes alone; the body is fetched from its own row afterwards.
    """
    order = F.struct(*([captured] if captured else []), F.sha2("html", 256).alias("_hash"))
    chosen = pages.groupBy("url").agg(F.max(order).alias("_order"))
    own = pages.withColumn("_order", order).join(chosen, ["url", "_order"], "left_semi")
    return own.select("url", "html").dropDuplicates(["url"])


def prompt_text(title: Column, page_text: Column, summary: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\n\n"), text.first_nonblank(page_text, summary))


def with_prompt(rows: DataFrame, pages: DataFrame, max_chars: int = 4000, captured: str | None = None) -> DataFrame:
    """Page text where there is one, the feed summary otherwise. Text is taken from the pages of these rows alone, one capture per url."""
    wanted = one_capture(pages.join(rows.select("url"), "url", "left_semi"), captured)
    joined = rows.join(page_texts(wanted, max_chars), "url", "left")
    return joined.withColumn("prompt", prompt_text(F.col("title"), F.col("page_text"), F.col("summary"))).drop("page_text")


def title_prompt(title: Column) -> Column:
    return F.concat(F.lit("Title: "), title)


def recorded_answers(answers: DataFrame, preferences: DataFrame) -> Extractor:
    """Extractor over answers recorded earlier; prompts without one give an error row."""

    def extract(prompts: DataFrame) -> DataFrame:
        ranked = answers.join(preferences, ["provider", "model"])
        joined = prompts.select("url_hash").join(ranked, "url_hash", "left")
        error = F.coalesce("error", F.when(F.col("answer").isNull(), "no_answer"))
        return joined.select("url_hash", "provider", "model", "rank", "answer", error.alias("error"))

    return extract


def timed(call: Callable[[], dict], gate: threading.Semaphore, seconds: float | None) -> dict:
    """A call under its provider's limit. One that takes too long is left to itself, and goes on counting until it ends.

    Only a call that may be left needs a thread of its own.
    """
    if seconds is None:
        with gate:
            return call()
    result: Future = Future()

    def run() -> None:
        with gate:
            started.set()
            try:
                result.set_result(call())
            except BaseException as failure:
                result.set_exception(failure)

    started = threading.Event()
    threading.Thread(target=run, daemon=True).start()
    started.wait()
    return result.result(seconds)


def cascade_rows(
    generate: Callable[[str, str, str], dict], preferences: list[tuple[str, str]], calls: int, per_provider: int, seconds: float | None,
) -> Callable[[pd.DataFrame], list[tuple]]:
    """Function from a batch of prompts to its attempts, in the prompts' order; its limits hold over all batches it is given."""
    gates = {provider: threading.Semaphore(per_provider) for provider, _ in preferences}
    pool = ThreadPoolExecutor(calls)

    def ask(url_hash: str, prompt: str, waiting: list[str] | None) -> list[tuple]:
        rows = []
        for rank, (provider, model) in enumerate(preferences):
            if waiting is not None and f"{provider}/{model}" in waiting:
                continue
            try:
                answer = timed(lambda: generate(prompt, provider, model), gates[provider], seconds)
            except Exception as failure:  # the model's failure belongs to the row
                rows.append((url_hash, provider, model, rank, None, f"{type(failure).__name__}: {failure}"))
                continue
            rows.append((url_hash, provider, model, rank, answer, None))
            break
        return rows

    return lambda batch: [row for some in pool.map(ask, batch["url_hash"], batch["prompt"], batch["waiting"]) for row in some]


def model_cascade(
    generate: Callable[[str, str, str], dict], preferences: list[tuple[str, str]], calls: int = 8, per_provider: int = 4, seconds: float | None = None,
) -> Extractor:
    """Extractor over a user's ``generate(prompt, provider, model) -> dict``, tried in order of preference.

    Rows of an Arrow batch overlap, ``calls`` at a time in a task and ``per_provider`` of them with one provider; each row asks its
    models one after the other and stops at the first answer. A call that fails, or takes more than ``seconds`` once it has begun, is an
    error row, never a failed job; the next model is tried. Models in a prompt's ``waiting`` (``provider/model``) are left out; a row
    for which none is left has no attempt.
    """

    def attempts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = cascade_rows(generate, preferences, calls, per_provider, seconds)
        for batch in batches:
            yield pd.DataFrame(rows(batch), columns=ATTEMPTS.names)

    def extract(prompts: DataFrame) -> DataFrame:
        waiting = F.col("waiting") if "waiting" in prompts.columns else F.lit(None).cast("array<string>").alias("waiting")
        return prompts.select("url_hash", "prompt", waiting).mapInPandas(attempts, ATTEMPTS)

    return extract


WORD = r"(?:^|[^\p{L}])(?:%s)(?:$|[^\p{L}])"
# Stand-in vocabulary of the offline tagger, most specific first.
TOPIC_WORDS = {
    "Producer prices": "producer price", "Import prices": "import price", "Export prices": "export price",
    "Consumer prices": "consumer price|hicp|inflation", "GDP": WORD % "gdp|gross domestic product|pil",
    "Industrial production": "industrial production", "Services production": "services production",
    "International trade": "trade balance|foreign trade|international trade",
    "Labour market": "unemployment|employment|labour", "Public finance": "government debt|deficit",
    "Retail trade": "retail", "Construction": "construction|building", "Business surveys": "confidence|survey",
}
COUNTRY_WORDS = {
    "Euro area": WORD % "euro area|eu", "Italy": "ital", "Spain": "spain|españa", "France": "franc",
    "Germany": "german|deutsch", "Ireland": "ireland|irish",
}
RISE, FALL = WORD % "rose|rise|rises|increase|increased|grew|up", WORD % "fell|fall|falls|decrease|decreased|shrank|down"
FIGURE = r"[+-]?\d+(?:[.,]\d+)*\s?%"


def _first_match(content: Column, words: dict[str, str], default: str) -> Column:
    picked = F.lit(default)
    for choice, pattern in reversed(words.items()):
        picked = F.when(content.rlike(f"(?iu){pattern}"), choice).otherwise(picked)
    return picked


# Length of the offline tagger's answers: words of a summary, different figures of a text.
SUMMARY_WORDS, KEY_FIGURES = 150, 12


def keyword_answer(title: Column, content: Column, summary_words: int = SUMMARY_WORDS, key_figures: int = KEY_FIGURES) -> Column:
    """Answer struct from keyword rules: an offline stand-in for a model, inside the JVM. Words and figures are kept whole."""
    ups, downs = F.regexp_count(content, F.lit(f"(?i){RISE}")), F.regexp_count(content, F.lit(f"(?i){FALL}"))
    figures = F.array_distinct(F.regexp_extract_all(content, F.lit(FIGURE), F.lit(0)))
    words = F.split(content, r"\s+", summary_words + 1)
    summary = F.array_join(F.slice(words, 1, summary_words), " ")
    return F.struct(
        _first_match(content, TOPIC_WORDS, "Other economic topics").alias("topic"),
        _first_match(content, COUNTRY_WORDS, "Other").alias("country"),
        F.when(ups > downs, "positive").when(downs > ups, "negative").otherwise("neutral").alias("sentiment"),
        title.alias("title_en"), summary.alias("summary_en"), F.array_join(F.slice(figures, 1, key_figures), "; ").alias("key_figures"),
    )


def keyword_tagger(prompts: DataFrame) -> DataFrame:
    """The offline extractor: reads the title back from the prompt's first line."""
    title = F.regexp_extract("prompt", r"(?s)^Title: ([^\n]*)\n\n", 1)
    return prompts.select(
        "url_hash", F.lit("offline").alias("provider"), F.lit("keywords").alias("model"), F.lit(0).alias("rank"),
        keyword_answer(title, F.regexp_replace("prompt", r"(?s)^Title: ", "")).alias("answer"),
        F.lit(None).cast("string").alias("error"),
    )


def guard_answer_schema(attempts: DataFrame) -> None:
    """Answers may carry the extraction fields and nothing that is copied from the raw row."""
    fields = set(attempts.schema["answer"].dataType.names)
    if fields & set(schemas.RESERVED_FIELDS):
        raise ValueError(f"answer carries copied fields: {sorted(fields & set(schemas.RESERVED_FIELDS))}")
    if not set(schemas.ANSWER_FIELDS) <= fields:
        raise ValueError(f"answer lacks fields: {sorted(set(schemas.ANSWER_FIELDS) - fields)}")


def answer_fault(answer: Column, domains: dict[str, list[str]], texts: list[str]) -> Column:
    """Why an answer is refused: ``domain:<field>`` for an unknown choice, ``missing:<field>`` for a lacking text."""
    fault = F.when(answer.isNull(), "missing:answer")
    for name, choices in domains.items():
        fault = fault.when(~F.coalesce(answer.getField(name).isin(choices), F.lit(False)), f"domain:{name}")
    for name in texts:
        fault = fault.when(answer.getField(name).isNull(), f"missing:{name}")
    return fault


def first_success(attempts: DataFrame, key: str, rank: str | Column, valid: Column, answer: Column) -> DataFrame:
    """First valid answer of each key in preference order; null where none is valid."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    return attempts.groupBy(key).agg(F.min_by(answer, F.when(valid, rank)).alias("answer"))


def choose_answers(attempts: DataFrame, domains: dict[str, list[str]], texts: list[str], *also: Column) -> DataFrame:
    """Per row the first attempt that succeeded and validates, with the fault of the best attempt where none did.

    ``also`` are further aggregates of a row's attempts: attempts that come from a model are not made again to count them.
    """
    guard_answer_schema(attempts)
    fault = F.coalesce("error", answer_fault(F.col("answer"), domains, texts))
    judged = attempts.withColumn("_fault", fault)
    candidate = F.struct("provider", "model", "answer")
    return judged.groupBy("url_hash").agg(
        F.min_by(candidate, F.when(F.col("_fault").isNull(), F.col("rank"))).alias("chosen"),
        F.min_by("_fault", F.coalesce("rank", F.lit(2**31 - 1))).alias("fault"), *also,
    ).withColumn("fault", F.when(F.col("chosen").isNull(), F.col("fault")))


def assemble(raw: DataFrame, chosen: DataFrame, run_ts: Column) -> DataFrame:
    """Model fields next to metadata copied verbatim from the raw row."""
    answers = chosen.where(F.col("chosen").isNotNull()).select("url_hash", "chosen")
    joined = raw.join(answers, "url_hash")
    copied = ["url_hash", "url", "title", "publisher", "publisher_full", "feed_label", "language", "published", "fetched_at"]
    return joined.select(
        *copied, run_ts.alias("processed_at"),
        F.concat_ws("/", "chosen.provider", "chosen.model").alias("processing_model"),
        *[F.col(f"chosen.answer.{name}").alias(name) for name in schemas.ANSWER_FIELDS],
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
