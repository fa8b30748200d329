"""Documents in blocks, each with a dictionary of its own distinct words.

A block holds neighbouring documents of one task, up to a number of text bytes; a longer document is a block alone. It is
one row: keys, number of words of each document, the words' numbers (``places``, compressed), and the distinct words.
Tables are then joined with the distinct words of blocks instead of with every word of every document.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks of a task and numbers in a block have so many bits; a slot is both in one long.
NUMBER_BITS = 28
BLOCK_BITS = 16


class Numbers(dict):
    """Numbers by first occurrence."""

    def __missing__(self, item) -> int:
        found = self[item] = len(self)
        return found


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.ravel())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def blocks(docs: DataFrame, split: Callable[[], Callable[[str], list]], word_type: str, describe: Callable[[list], list] = list, key: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """``split()`` is called once per task and gives the splitter; ``describe`` turns the distinct words into column values."""
    arrow = {"string": pa.string(), "bigint": pa.int64()}[word_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, first = split(), TaskContext.get().partitionId() << BLOCK_BITS
        made = 0

        def block(keys: list, kind: pa.DataType, counts: array, places: array, numbers: Numbers) -> pa.RecordBatch:
            values = [first + made, keys, packed(np.frombuffer(counts, np.uint32)), packed(np.frombuffer(places, np.uint32)), describe(list(numbers))]
            kinds = [pa.int64(), pa.list_(kind), pa.binary(), pa.binary(), pa.list_(arrow)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["block", "keys", "counts", "places", "words"])

        keys, counts, places, numbers, size, kind = [], array("I"), array("I"), Numbers(), 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py() or ""
                if keys and size + len(body) > block_bytes:
                    yield block(keys, kind, counts, places, numbers)
                    made += 1
                    keys, counts, places, numbers, size = [], array("I"), array("I"), Numbers(), 0
                words = splitter(body)
                keys.append(one)
                counts.append(len(words))
                places.extend(map(numbers.__getitem__, words))
                size += len(body)
        if keys:
            yield block(keys, kind, counts, places, numbers)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"block bigint, keys array<{rows.schema['key'].dataType.simpleString()}>, counts binary, places binary, words array<{word_type}>")


def text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20, rest: bool = False) -> DataFrame:
    """Neighbouring documents of a task as they are: keys, digests and sizes of their texts in UTF-8 (null: empty), and the texts, compressed.

    A document is found again by its block and its number in it. With ``rest`` the block has the documents' other columns, and ``nulls``,
    the numbers of null texts.
    """
    others = [F.col(f"`{name}`") for name in docs.columns if name != text] if rest else []
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(*others).alias("rest") if others else F.lit(0).alias("rest"))
    held = T.StructField("rest" if rest else "keys", T.ArrayType(rows.schema["rest" if rest else "key"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, first, made = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << BLOCK_BITS, 0

        def block() -> pa.RecordBatch:
            held = pa.concat_arrays(slices)
            columns = [
                pa.array([first + made]), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
                pa.array([[xxhash.xxh3_128_digest(one) for one in texts]], pa.list_(pa.binary())), pa.array([[len(one) for one in texts]], pa.list_(pa.int32())),
                pa.array([nulls], pa.list_(pa.int32())), pa.array([compressor.compress(b"".join(texts))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "rest" if rest else "keys", "digests", "sizes", "nulls", "body"])

        slices, texts, nulls, size = [], [], [], 0
        for batch in batches:
            own = batch.column("rest" if rest else "key")
            for n, body in enumerate(batch.column("text")):
                data = (body.as_py() or "").encode()
                if texts and size + len(data) > block_bytes:
                    yield block()
                    made, slices, texts, nulls, size = made + 1, [], [], [], 0
                if not body.is_valid:
                    nulls.append(len(texts))
                slices.append(own.slice(n, 1))
                texts.append(data)
                size += len(data)
        if texts:
            yield block()

    texts_held = T.StructType.fromDDL("digests array<binary>, sizes array<int>, nulls array<int>, body binary")
    return rows.mapInArrow(run, T.StructType([T.StructField("block", T.LongType()), held, *texts_held.fields]))


def texts_of(body: bytes, sizes: list[int]) -> list[bytes]:
    """The texts of a block."""
    data, ends = zstandard.ZstdDecompressor().decompress(body), np.cumsum([0, *sizes]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]
