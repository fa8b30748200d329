"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows of class 1, the unlabelled set is the corpus itself, and the class prior is estimated
from the labelled rows. A small network on surface statistics of whole texts minimises the non-negative risk estimate with
the bounded sigmoid loss, which a prior that is off by a little does not upset.

Defined cases: a null text scores as the empty text, which has a score like any other; without positives every score is
the prior (one half if there are no labels); repeated rows are scored each; columns other than key and text take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
FEATURES = 8


def statistics(text: str | None, compressor: zstandard.ZstdCompressor) -> list[float]:
    """Surface statistics of the whole text."""
    data = (text or "").encode()
    words = data.split()
    size, count = max(len(data), 1), max(len(words), 1)
    return [
        float(np.log1p(len(words))),
        (sum(map(eq, words, words[1:])) / count) ** 0.5,
        ((len(data) - len(data.translate(None, UPPER))) / size) ** 0.5,
        (len(data) - len(data.translate(None, DIGITS))) / size,
        min(len(data) / count, 50.0) / 10,
        len(set(words)) / count,
        min(len(compressor.compress(data)) / size, 2.0),
        data.count(b".") / count,
    ]


def text_features(text: str) -> Column:
    """Statistics of a text column as an array column."""

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pd.Series([statistics(one, compressor) for one in batch])

    return features(F.col(text))


@dataclass(frozen=True)
class QualityModel:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(features), self.prior)
        return 1 / (1 + np.exp(-np.clip(forward(scaled(features, self.mean, self.scale), self.layers)[1], -30, 30)))


def scaled(features: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((features - mean) / scale, -6, 6)


def forward(x: np.ndarray, layers: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    first, bias, second, shift = layers
    hidden = np.tanh(x @ first + bias)
    return hidden, hidden @ second + shift


def backward(x: np.ndarray, hidden: np.ndarray, slope: np.ndarray, layers: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    inner = np.outer(slope, layers[2]) * (1 - hidden * hidden)
    return [x.T @ inner, inner.sum(0), hidden.T @ slope, np.array(slope.sum())]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 12, steps: int = 600, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> QualityModel:
    """Full-batch Adam on prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the sigmoid loss.

    While the second part is negative it counts as nothing, which is the non-negative correction.
    """
    if not len(positive) or not len(unlabelled):
        return QualityModel(prior, np.zeros(FEATURES), np.ones(FEATURES), ())
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = scaled(positive, mean, scale), scaled(unlabelled, mean, scale)
    random = np.random.default_rng(seed)
    layers = [random.normal(0, 0.4, (p.shape[1], hidden)), np.zeros(hidden), random.normal(0, 0.4, hidden), np.zeros(())]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, steps + 1):
        hp, fp = forward(p, layers)
        hu, fu = forward(u, layers)
        up, uu = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        slope_p, slope_u = -prior * up * (1 - up) / len(p), np.zeros(len(u))
        if uu.mean() > prior * up.mean():
            slope_p, slope_u = 2 * slope_p, uu * (1 - uu) / len(u)
        slopes = [a + b for a, b in zip(backward(p, hp, slope_p, layers), backward(u, hu, slope_u, layers), strict=True)]
        for i, slope in enumerate(slopes):
            slope = slope + decay * layers[i]
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope * slope
            layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(prior, mean, scale, tuple(layers))


def below(rows: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows and a half more, by a threshold on the key's hash that follows from their number; all if they are few."""
    count = rows.count()
    share = min(1.5 * limit / max(count, 1), 1.0)
    return rows if count <= 2 * limit else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < int(share * (1 << 32)))


def sampled(rows: DataFrame, limit: int) -> np.ndarray:
    """Features of at most ``limit`` rows; they are computed where the rows lie, and no text moves."""
    each = below(rows, limit).select(F.pmod(F.xxhash64("id"), F.lit(1 << 32)).alias("h"), "id", text_features("body").alias("x"))
    found = each.orderBy("h", "id").limit(limit).toPandas()["x"]
    return np.stack(found) if len(found) else np.zeros((0, FEATURES))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 6000) -> QualityModel:
    """Fit on bounded samples: ``sample_rows`` positives and ``sample_rows`` documents at most, chosen by the key's hash.

    ``labels`` holds only rows that may be learned from; the prior is their share of class 1 with one row added to each class.
    """
    bodies = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).where("id IS NOT NULL")
    marks = labels.select(F.col(key).alias("id"), F.col(label).alias("mark")).where("id IS NOT NULL AND mark IS NOT NULL")
    counts = marks.agg(F.count_if(F.col("mark") == 1).alias("good"), F.count("*").alias("rows")).first()
    trusted = marks.where("mark = 1").select("id").distinct()
    chosen = below(trusted, sample_rows).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    positives = bodies.join(F.broadcast(chosen), "id", "left_semi")  # of sample_rows rows at most
    return fit(sampled(positives, sample_rows), sampled(bodies, sample_rows), (counts.good + 1) / (counts.rows + 2))


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, probability of class 1, and the class at one half."""
    return scored(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model, "text").select("doc_id", "score", "predicted")


def scored(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """All columns of the input, with ``score`` and ``predicted``; input columns of these names give way to them."""

    @F.pandas_udf("double")
    def scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            features = [statistics(one, compressor) for one in batch]
            yield pd.Series(model.scores(np.array(features).reshape(-1, FEATURES)))

    return docs.withColumn("score", scorer(F.col(text))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
