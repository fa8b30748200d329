"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to whole numbers and dealt to blocks. A block keeps, for every dimension, the bit slices of its
coarse values (value less the block's minimum, lowest bits dropped) as bitmaps over its rows. For a query, slices are added
with carry-save bitmap arithmetic into the slices of one weighted sum; a walk from the most significant slice downward
finds the k-th largest sum; rows whose sum may still reach it are compared exactly. Queries meet blocks in chunks.

Defined cases: a vector that is null, or that holds a null or a non-finite component, takes no part; scores that could leave 64
bits are computed in whole numbers of any size, and a result beyond 64 bits is an error, as is a component of size 2**60 after
scaling; vectors of another length than the query's are no candidates; rows with the same id
count once, with the smallest vector; a null id takes no part; equal scores go to the smaller id; fewer candidates than k
are all returned; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 2.0**60
PAYLOAD = "dim int, part int, ids binary, vectors binary"


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Id, length and whole-number components of the vectors that take part."""

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def quantise(x: Column) -> Column:
        return F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for the index")))

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", usable))
    whole = F.transform("x", quantise)
    return rows.select("vec_id", whole.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of one hash part and length as one row of two binary columns."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        values = np.array(group["x"].tolist(), np.int64)
        narrow = values.size == 0 or max(-int(values.min()), int(values.max())) < 1 << 31
        values = values.astype(np.int32 if narrow else np.int64).tobytes()
        return pd.DataFrame([(group["dim"].iloc[0], group["part"].iloc[0], group["vec_id"].to_numpy(np.int64).tobytes(), values)], columns=["dim", "part", "ids", "vectors"])

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    return dealt.groupBy("dim", "part").applyInPandas(pack, PAYLOAD)


class Block:
    """Bit slices of one block: ``slices[d, b]`` is the bitmap of bit b of the coarse value in dimension d."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, drop_bits: int):
        self.ids, self.vectors, self.drop = ids, vectors, drop_bits
        self.low = vectors.min(0) if vectors.size else np.zeros(vectors.shape[1], np.int64)
        coarse = (vectors - self.low) >> drop_bits
        self.bits = max(int(coarse.max(initial=0)).bit_length(), 1)
        self.words = -(-len(ids) // 64)
        self.all = np.zeros(self.words * 8, np.uint8)
        self.all[: -(-len(ids) // 8)] = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
        self.all = self.all.view(np.uint64)
        self.slices = np.zeros((vectors.shape[1], self.bits, self.words), np.uint64)
        for b in range(self.bits):
            bitmap = np.packbits(((coarse >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            self.slices[:, b].view(np.uint8)[:, : bitmap.shape[1]] = bitmap

    def weighted_sum(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum of |q| times the coarse value, counted from the top where q < 0."""
        levels: list[list[np.ndarray]] = []
        weight = np.abs(query)
        for j in range(int(weight.max(initial=0)).bit_length()):
            plus, minus = np.flatnonzero((weight >> j) & 1 & (query > 0)), np.flatnonzero((weight >> j) & 1 & (query < 0))
            for b in range(self.bits):
                while len(levels) <= j + b:
                    levels.append([])
                levels[j + b] += [self.slices[plus, b], ~self.slices[minus, b] & self.all]
        out, carried, at = [], np.zeros((0, self.words), np.uint64), 0
        while at < len(levels) or len(carried):
            rows = np.concatenate([carried, *(levels[at] if at < len(levels) else [])])
            carries = []
            while len(rows) > 1:
                a, b, c = rows[0::3], rows[1::3], rows[2::3]
                n = len(c)
                half = a[:n] ^ b[:n]
                carries.append((a[:n] & b[:n]) | (c & half))
                rest = rows[3 * n:]
                if n == 0:
                    carries.append((rows[0] & rows[1])[None])
                    rows = (rows[0] ^ rows[1])[None]
                else:
                    rows = np.concatenate([half ^ c, rest])
            out.append(rows[0] if len(rows) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(carries) if carries else np.zeros((0, self.words), np.uint64)
            at += 1
        return out

    def reaching(self, query: np.ndarray, k: int) -> np.ndarray:
        """Row numbers that can be among the k largest scores."""
        if len(self.ids) <= k:
            return np.arange(len(self.ids))
        total = self.weighted_sum(query)
        above, equal, kth = 0, self.all, 0
        for at in range(len(total) - 1, -1, -1):
            met = equal & total[at]
            n = int(np.bitwise_count(met).sum())
            if above + n >= k:
                equal, kth = met, kth | 1 << at
            else:
                above, equal = above + n, equal & ~total[at]
        spread = sum(map(abs, query.tolist())) * ((1 << self.drop) - 1)
        least = kth - (spread >> self.drop) - 1
        over, equal = np.zeros_like(self.all), self.all
        for at in range(len(total) - 1, -1, -1):
            if max(least, 0) >> at & 1:
                equal = equal & total[at]
            else:
                over, equal = over | (equal & total[at]), equal & ~total[at]
        return np.flatnonzero(np.unpackbits((over | equal).view(np.uint8), bitorder="little")[: len(self.ids)])

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        rows = self.reaching(query, k + 1)
        rows = rows[self.ids[rows] != query_id]
        vectors = self.vectors[rows]
        if int(np.abs(vectors).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(len(query), 1) < 1 << 62:
            scores = vectors @ query
            first = np.lexsort((self.ids[rows], -scores))[:k].tolist()
        else:
            scores = vectors.astype(object) @ query.astype(object)
            first = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
            if any(not -(2**63) <= scores[i] < 2**63 for i in first):
                raise OverflowError(f"a score of vector {query_id} is beyond 64 bits")
        return [(query_id, int(self.ids[rows[i]]), int(scores[i])) for i in first]


def matrix(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    kind = np.int64 if len(vectors) == 8 * len(found) * dim else np.int32
    return found, np.frombuffer(vectors, kind).reshape(len(found), dim).astype(np.int64)


def top_k(vectors: DataFrame, query_of: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block_rows: int = 16384, chunk_rows: int = 512, drop_bits: int = 3) -> DataFrame:
    """The k best other rows of every row for which ``query_of`` (over ``vec_id``) holds: query_id, rank, vec_id, score."""
    rows = quantised(vectors, key, vector, scale)
    counts = rows.agg(F.count("*").alias("all"), F.count_if(query_of).alias("asked")).first()
    blocks, chunks = max(-(-counts["all"] // block_rows), 1), max(-(-counts["asked"] // chunk_rows), 1)
    index = packed(rows, blocks).withColumnRenamed("part", "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = packed(rows.where(query_of), chunks).toDF("dim", "chunk", "query_ids", "queries").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples():
                block = Block(*matrix(pair.ids, pair.vectors, pair.dim), drop_bits)
                query_ids, queries = matrix(pair.query_ids, pair.queries, pair.dim)
                found = [hit for one, query in zip(query_ids.tolist(), queries, strict=True) for hit in block.best(one, query, k)]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype=np.int64)

    found = index.join(asked, ["dim", "block", "chunk"]).mapInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
