"""Queries of the numbered operators over the driver's tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import align, bpe, decontaminate, katz, language_id, linededup, neardup, quality, repair, runs, suffixes, topk, warc
from gazette.llm.common import crc_class, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_class(F.col("doc_id"), 4) == 2)
    model = language_id.train(docs.where("NOT held_out"))
    return language_id.identify(docs, model).withColumn("held_out", crc_class(F.col("doc_id"), 4) == 2)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("hits"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return whole.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.catalogue(warc.write(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), k=2, percent=80)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("n_cut", F.size("cut_starts").cast("long"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_class(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    return quality.score(docs, quality.train(docs.where(~held_out), labels)).withColumn("held_out", held_out)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = repair.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    rows = repair.read(archive).select("file", "shard", F.col("key").alias("doc_id"), "offset", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    starts = rows.join(repair.shard_starts(archive), ["file", "shard"])
    return starts.select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_class(F.col("doc_id"), 7) == 2
    scores, model = katz.score(table(spark, sf_dir, "documents"), ~held_out, order=2)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    groups = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", groups.alias("groups_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document in ten goes on, from some word, with the words from there on again and again."""
    split = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda word: word != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, split)).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.expr("if(n > 0, (h div 10) % n, NULL)")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    spliced = F.expr("array_join(concat(slice(words, 1, int(a)), transform(sequence(a, n - 1), i -> words[int(a + (i - a) % p)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, spliced).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_planted_runs(table(spark, sf_dir, "documents")))
    # Runs are in order of their starts and periods: an earlier one goes before a later one of the same exponent.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(b.length * a.period > a.length * b.period, b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"), width=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, one: total + one.length)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_bpe": op3_bpe,
    "op4_bit_sliced_topk": op4_bit_sliced_topk,
    "op5_warc": op5_warc,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_files": op9_token_files,
    "op10_katz": op10_katz,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}
ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), i AS (
            SELECT item_id, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM b WHERE len(w) > 0
        ), v AS (
            SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS g FROM i
        ), s AS (
            SELECT DISTINCT n FROM v
        ), p AS (
            SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM d, s WHERE len(w) >= n
        ), h AS (
            SELECT doc_id, pos, n, item_id FROM (SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS g FROM p) JOIN v USING (n, g)
        ), c AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM (SELECT DISTINCT doc_id, pos, n FROM h)) GROUP BY doc_id
        ), t AS (
            SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op4_bit_sliced_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op5_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
            SELECT h, max(page_id) AS keeper FROM p GROUP BY h
        )
        SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, (
            SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31 AS INTEGER), 1), '' ORDER BY i, j)
            FROM range(8) a(i), range(4) c(j)
        ) AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM p JOIN d USING (h)
    """,
    # Units, stretches of repeated units by the places that their numbers leave out, and the pieces outside long stretches.
    "op7_line_dedup": r"""
        WITH p AS (
            SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS place
            FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]*?(?:[.!?…,;:]["''”’»)\]]?[ \t]+|[。！？｡，；]|\n|\z)') AS pieces FROM documents WHERE text IS NOT NULL)
        ), u AS (
            SELECT *, trim(regexp_replace(lower(piece), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS unit,
                coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM p
        ), r AS (
            SELECT *, start + length(piece) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS number,
                min(doc_id) OVER (PARTITION BY unit) < doc_id AS again,
                len(string_split(unit, ' ')) + length(regexp_replace(unit, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+', '', 'g')) // 2 AS words
            FROM u WHERE unit <> ''
        ), s AS (
            SELECT doc_id, min(start) AS start, max(stop) AS stop
            FROM (SELECT *, number - row_number() OVER (PARTITION BY doc_id, again ORDER BY number) AS stretch FROM r)
            WHERE again GROUP BY doc_id, stretch HAVING sum(words) >= 25
        ), k AS (
            SELECT u.doc_id, string_agg(piece, '' ORDER BY place) AS text
            FROM u ANTI JOIN s ON u.doc_id = s.doc_id AND u.start >= s.start AND u.start < s.stop GROUP BY u.doc_id
        ), c AS (
            SELECT doc_id, list(CAST(start AS INTEGER) ORDER BY start) AS cut_starts, list(CAST(stop - start AS INTEGER) ORDER BY start) AS cut_lengths
            FROM s GROUP BY doc_id
        )
        SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(c.cut_starts, []) AS cut_starts,
            coalesce(c.cut_lengths, []) AS cut_lengths, coalesce(len(c.cut_starts), 0) AS n_cut
        FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
}
