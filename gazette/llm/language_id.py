"""Language identification by compression with per-language zstandard dictionaries.

A language is a raw-content dictionary: labelled excerpts, normalised and joined. A text is cut into chunks, every chunk is
compressed with every dictionary, and the language with the smallest total wins. A narrow win is marked as rejected.

Defined cases: a null text or a text without letters is ``und`` with score 0, and so is every text if nothing was learned;
with one learned language that language wins with score 1; equal sizes go to the first language in order of name; repeated
rows are predicted each; columns of the input other than key and text take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import small, stage

#: A larger sample than this (``sample_docs`` times the languages) is joined by shuffle.
MAX_BROADCAST_ROWS = 100_000
UNDETERMINED = "und"
PREDICTION = "lang string, score double, margin double, rejected boolean"


@dataclass(frozen=True)
class LanguageModel:
    dictionaries: dict[str, bytes]
    chunk_bytes: int = 8192
    level: int = 6
    min_margin: float = 0.005


def normalised(text: Column) -> Column:
    """Lower-case words of letters between single spaces."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = 800, excerpt_chars: int = 512, dict_bytes: int = 131072) -> LanguageModel:
    """Learn from a bounded sample: of each language ``sample_docs`` different texts, chosen by hash, an excerpt of
    ``excerpt_chars`` from a hashed place of each, ``dict_bytes`` in all. Copies count once.
    """
    rows = labelled.select(F.col(text).alias("body"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND body IS NOT NULL").withColumn("h", F.xxhash64("body"))
    hashes = stage(rows.select("lang", "h").distinct(), "language-hashes")
    # Twice the share that the sample needs passes a threshold before the rest is ranked: no task ranks a language's hashes.
    counts = hashes.groupBy("lang").agg(F.count("*").alias("texts"))
    low = F.pmod(F.col("h"), F.lit(1 << 32)) < F.lit(2.0 * sample_docs * (1 << 32)) / F.col("texts")
    hashes = hashes.join(counts, "lang").where((F.col("texts") <= 4 * sample_docs) | low)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = stage(hashes.select("lang", "h").withColumn("nth", nth).where(F.col("nth") <= sample_docs), "language-sample")
    chosen = small(chosen, chosen.count(), MAX_BROADCAST_ROWS)
    start = F.lit(1) + F.pmod(F.col("h"), F.greatest(F.length("body") - excerpt_chars, F.lit(1))).cast("int")
    excerpt = normalised(F.substring("body", start, F.lit(excerpt_chars)))
    parts = rows.join(chosen, ["lang", "h"]).select("lang", "h", excerpt.alias("part")).groupBy("lang", "h").agg(F.min("part").alias("part"))
    joined = parts.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list(F.struct("h", "part")))["part"], " ").alias("body"))
    return LanguageModel({row.lang: row.body.encode()[-dict_bytes:] for row in sorted(joined.collect())})


class Judge:
    """One worker's compressors."""

    def __init__(self, model: LanguageModel):
        self.model, self.names, self.compressors = model, list(model.dictionaries), []
        for content in model.dictionaries.values():
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=model.level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=words, level=model.level, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data, step = text.encode(), self.model.chunk_bytes
        chunks = [data[at:at + step] for at in range(0, len(data), step)]
        return [sum(len(one.compress(chunk)) for chunk in chunks) for one in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        if not self.names or not text or not text.strip():
            return UNDETERMINED, 0.0, 0.0, True
        found = self.sizes(text)
        order = sorted(range(len(found)), key=found.__getitem__)
        best = found[order[0]]
        margin = (found[order[1]] - best) / best if len(order) > 1 else 1.0
        share = 1.0 / sum(2.0 ** max((best - size) / 2, -60.0) for size in found)
        return self.names[order[0]], share, margin, margin < self.model.min_margin


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, best language, score (its share when a byte less counts as half a bit), relative margin, rejection mark."""

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(model)
        for batch in batches:
            yield pd.DataFrame([judge(one) for one in batch], columns=["lang", "score", "margin", "rejected"])

    letters = F.when(F.col(text).rlike(r"\p{L}"), normalised(F.col(text)))
    found = docs.select(F.col(key).alias("doc_id"), predict(letters).alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), "found.score", "found.margin", "found.rejected")
