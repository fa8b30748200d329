"""Prompt, extraction, validation and backfill queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gazette.catalog.base import RELEASES_SQL, query, releases, table
from gazette.catalog.bodies import document_pages
from gazette.operators import enrich
from gazette.operators.search import missing_field
from gazette.plans.enrich import backfill_titles
from gazette.sources import config

CLEAN_SQL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
PROMPT_SQL = f"""prompts AS (SELECT doc_id, title, text, 'Title: ' || title || chr(10) || chr(10) || CASE WHEN l.doc_id IS NULL THEN language || ' summary'
    WHEN length({CLEAN_SQL}) > 4000 THEN substring({CLEAN_SQL}, 1, 4000) || ' […]' ELSE {CLEAN_SQL} END AS prompt
    FROM releases LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id))"""


def prompts(spark, sf_dir):
    rows = releases(spark, sf_dir, heavy=True).selectExpr(
        "doc_id", "concat('https://x.example/', doc_id) AS url", "title", "concat(language, ' summary') AS summary"
    )
    return enrich.with_prompt(rows, document_pages(spark, sf_dir)).select("doc_id", "title", "prompt")


@query(f"WITH {RELEASES_SQL}, {PROMPT_SQL} SELECT doc_id, prompt FROM prompts")
def truncate_prompt(spark, sf_dir):
    return prompts(spark, sf_dir).select("doc_id", "prompt")


FIGURE_SQL = r"[+-]?\d+(?:[.,]\d+)*\s?%"


def _case(words, default):
    return "CASE " + " ".join(f"WHEN regexp_matches(content, '(?i){pattern}') THEN '{choice}'" for choice, pattern in words.items()) + f" ELSE '{default}' END"


TAGGED_SQL = f"""contents AS (SELECT *, substring(prompt, 8) AS content FROM prompts),
    tagged AS (SELECT doc_id, title, {_case(enrich.TOPIC_WORDS, 'Other economic topics')} AS topic, {_case(enrich.COUNTRY_WORDS, 'Other')} AS country,
    len(regexp_extract_all(content, '(?i){enrich.RISE}')) - len(regexp_extract_all(content, '(?i){enrich.FALL}')) AS trend,
    array_to_string(list_slice(regexp_split_to_array(content, '\\s+'), 1, {enrich.SUMMARY_WORDS}), ' ') AS summary_en,
    regexp_extract_all(content, '{FIGURE_SQL}') AS figures FROM contents),
    extracted AS (SELECT doc_id, 'offline/keywords' AS processing_model, topic, country,
    CASE WHEN trend > 0 THEN 'positive' WHEN trend < 0 THEN 'negative' ELSE 'neutral' END AS sentiment, title AS title_en, summary_en,
    array_to_string(list_slice([f FOR f, i IN figures IF list_position(figures, f) = i], 1, {enrich.KEY_FIGURES}), '; ') AS key_figures FROM tagged)"""


@query(f"WITH {RELEASES_SQL}, {PROMPT_SQL}, {TAGGED_SQL} SELECT * FROM extracted")
def keyword_extraction(spark, sf_dir):
    """Pending rows to processed rows with the offline extractor: prompt, answer, validation, assembly."""
    rows = prompts(spark, sf_dir).withColumnRenamed("doc_id", "url_hash")
    attempts = enrich.keyword_tagger(rows)
    chosen = enrich.choose_answers(attempts, config.EXTRACTION_DOMAINS, config.EXTRACTION_TEXTS)
    return chosen.where("fault IS NULL").selectExpr(
        "url_hash AS doc_id", "concat_ws('/', chosen.provider, chosen.model) AS processing_model", "chosen.answer.*"
    )


@query("""SELECT user_id, arg_min(event_id, (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3
    ELSE 4 END, event_id)) FILTER (WHERE value >= 50) AS answer FROM events GROUP BY user_id""")
def cascade_first_success(spark, sf_dir):
    ranks = config.local_frame(
        spark, [(rank, "models", name) for rank, name in enumerate(["view", "click", "signup", "purchase", "error"])], config.schemas.PREFERENCES
    )
    attempts = table(spark, sf_dir, "events").join(ranks, F.col("event_type") == F.col("model"))
    return enrich.first_success(attempts, "user_id", F.struct("rank", "event_id"), F.col("value") >= 50, F.col("event_id"))


@query("""SELECT doc_id, CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'domain:topic'
    WHEN lang NOT IN ('de', 'en', 'fr') THEN 'domain:country' WHEN doc_id % 7 = 0 THEN 'missing:title_en' ELSE 'ok' END AS verdict FROM documents""")
def domain_validation(spark, sf_dir):
    answer = F.expr("named_struct('topic', source, 'country', lang, 'title_en', if(doc_id % 7 = 0, NULL, text))")
    domains = {"topic": [f"src{i}" for i in range(8)], "country": ["de", "en", "fr"]}
    verdict = F.coalesce(enrich.answer_fault(answer, domains, ["title_en"]), F.lit("ok"))
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"))


def untranslated(spark, sf_dir):
    """Releases as processed rows whose English title is missing unless they are English."""
    return releases(spark, sf_dir).selectExpr(
        "doc_id AS url_hash", "title", "language", "published", "if(language = 'en', title, NULL) AS title_en",
        "CAST(NULL AS TIMESTAMP) AS updated_at",
    )


@query(f"""WITH {RELEASES_SQL} SELECT doc_id, published FROM releases WHERE language <> 'en'
    ORDER BY published DESC NULLS LAST, doc_id LIMIT 500""")
def missing_field_topk(spark, sf_dir):
    return missing_field(untranslated(spark, sf_dir), "title_en").selectExpr("url_hash AS doc_id", "published")


def prefix_translator(prompts):
    """Stand-in translator; every seventh title fails, as a model may."""
    return prompts.selectExpr(
        "url_hash", "'p' AS provider", "'m' AS model", "0 AS rank",
        "named_struct('title_en', concat(' EN ', substr(prompt, 8), ' ')) AS answer", "if(url_hash % 7 = 0, 'failed', NULL) AS error",
    )


@query(f"""WITH {RELEASES_SQL} SELECT doc_id, CASE WHEN language = 'en' THEN title WHEN trim(title) <> '' AND doc_id % 7 <> 0
    THEN trim('EN ' || title) END AS title_en, CASE WHEN language <> 'en' AND trim(title) <> '' AND doc_id % 7 <> 0
    THEN TIMESTAMP '2024-06-01' END AS updated_at FROM releases""")
def backfill_field(spark, sf_dir):
    done = backfill_titles(untranslated(spark, sf_dir), prefix_translator, dt.datetime(2024, 6, 1))
    return done.selectExpr("url_hash AS doc_id", "title_en", "CAST(updated_at AS TIMESTAMP_NTZ) AS updated_at")
