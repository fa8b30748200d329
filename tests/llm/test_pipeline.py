"""The pipeline: order of the stages, what each passes on, and its rows against a brute-force version of stages two to four."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gazette.llm import linededup
from gazette.sources.config import local_frame
from gazette.schemas import struct

DOCS = struct("doc_id bigint, text string, lang string, source string, n_chars bigint")
LABELS = struct("doc_id bigint, quality int, toxic int")
BENCHMARK = struct("item_id bigint, text string")
ITEM = "which of these ten plain words is asked about in question one here"
PASSAGE = "Every sentence of this passage stands in several documents of the table. It has more than twenty five words in all of its sentences. Nothing else is like it. "


def sentence(i):
    return " ".join(f"word{(i * 7 + k * k) % 97}x{i % 13}" for k in range(14)) + ". "


def tables(spark, folder):
    own = [(i, "".join(sentence(i * 31 + k) for k in range(8))) for i in range(40)]
    texts = own + [(40, own[3][1] + "end"), (41, own[5][1]), (42, own[6][1] + PASSAGE), (43, PASSAGE + own[7][1][:300]), (44, f"{own[8][1][:200]} {ITEM} {own[9][1][:200]}"), (45, ITEM.upper())]
    texts += [(46, None), (47, ""), (48, " \n")]
    local_frame(spark, [(i, text, "en", "s", len(text or "")) for i, text in texts], DOCS).write.parquet(f"{folder}/documents.parquet")
    local_frame(spark, [(i, 1, 0) for i in range(20)], LABELS).write.parquet(f"{folder}/labels.parquet")
    local_frame(spark, [(1, ITEM), (2, None)], BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_stages(spark, tmp_path):
    texts = dict(tables(spark, str(tmp_path)))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES[1:4]:
        docs = function(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({row.doc_id: row for row in docs.collect()})
    near, cut, clean = seen
    assert set(near) == set(texts) - {40, 41}
    stretched = {i for i in near if cut[i].text != near[i].text}
    assert 43 in stretched and PASSAGE.strip() not in cut[43].text and PASSAGE in cut[42].text
    assert all(cut[i].n_chars == len(cut[i].text) for i in stretched) and all(near[i].text == texts[i] for i in near)
    assert set(cut) - set(clean) == {44, 45}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for row in corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect():
        ids = tokenizer.encode(clean[row.doc_id].text or "", add_special_tokens=False).ids
        assert (row.n_tokens, np.frombuffer(row.ids, "<u4").tolist(), row.decoded) == (len(ids), ids, clean[row.doc_id].text or "")


def test_run(spark, tmp_path):
    texts = dict(tables(spark, str(tmp_path)))
    rows = {row.doc_id: row for row in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) <= set(texts) - {40, 41, 44, 45} and len(rows) >= 35
    assert linededup.MIN_WORDS == 25


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", BENCHMARK)):
        local_frame(spark, [], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
