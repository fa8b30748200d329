"""BPE encoding and decoding with a table of distinct words.

Texts are split into words as the tokenizer's pre-tokenizer does; merges never cross a word, so each distinct word is
encoded once. Its ids go back to the documents by a join on block and word, and are put in the words' order. The ids of a
block are joined with an id-to-piece table, and the pieces are put together to the decoded text.

Defined cases: a null text is the empty text, which has no ids and decodes to the empty text; strings of special tokens in a
text are those tokens, as the tokenizers library has it by default; repeated rows and null keys have a row each; columns
other than key and text take no part; no rows give no rows. Bytes that are not UTF-8 decode to the replacement character.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gazette.llm.blocks import NUMBER_BITS, blocks, packed, unpacked
from gazette.llm.common import bucketed, small

#: Fixed value: the public word pattern of byte-level BPE.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_BROADCAST_PIECES = 500_000
MAX_WORDS_KEPT = 400_000
OUTPUT_BYTES = 4 << 20


def word_splitter(path: str):
    """Function from a text to its words; special tokens are words."""
    with open(path, encoding="utf-8") as file:
        special = [one["content"] for one in json.load(file)["added_tokens"]]
    find = regex.compile(WORD).findall
    if not special:
        return find
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split

    def words(text: str) -> list[str]:
        if not any(one in text for one in special):
            return find(text)
        return [word for at, part in enumerate(cut(text)) for word in ([part] if at % 2 else find(part))]

    return words


def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Encoder(dict):
    """Ids of words as bytes, remembered up to a bound, and of texts."""

    def __init__(self, path: str):
        self.tokenizer, self.split = tokenizer(path), word_splitter(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_WORDS_KEPT:
            self.clear()
        found = self[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return found

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text or "")))


@cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def of_task(encode: Encoder) -> Encoder:
    """The encoder without the words of earlier tasks: a word meets one task alone."""
    encode.clear()
    return encode


def byte_of_letter() -> dict[str, int]:
    """Letters that stand for bytes in byte-level pieces: printable bytes for themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + at): byte for at, byte in enumerate(others)}


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """The tokenizer's id-to-piece table: ``id`` and the piece's bytes."""
    letters = byte_of_letter()

    def to_bytes(piece: str) -> bytes:
        return bytes(map(letters.__getitem__, piece)) if all(c in letters for c in piece) else piece.encode()

    rows = [(id, to_bytes(piece)) for piece, id in tokenizer(path).get_vocab(with_added_tokens=True).items()]
    return docs.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece binary")


def encoded_words(dealt: DataFrame, path: str) -> DataFrame:
    """``block`` and compressed ``numbers``, ``sizes`` and ``ids`` of distinct words of the block, a row per block and task.

    A word's rows, one per block at most, meet in one task, which encodes it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = of_task(encoder(path))
        for batch in batches:
            codes = list(map(encode.__getitem__, batch.column("word").to_pylist()))
            sizes, ids = np.fromiter(map(len, codes), np.int64, len(codes)) // 4, np.frombuffer(b"".join(codes), "<u4")
            slots = batch.column("slot").to_numpy(zero_copy_only=False)
            for block in np.unique(slots >> NUMBER_BITS).tolist():
                mine = slots >> NUMBER_BITS == block
                values = [block, packed(slots[mine] & ((1 << NUMBER_BITS) - 1)), packed(sizes[mine]), packed(ids[np.repeat(mine, sizes)])]
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["block", "numbers", "sizes", "ids"])

    words = dealt.select("block", F.posexplode("words").alias("number", "word"))
    words = words.select((F.shiftleft("block", NUMBER_BITS) + F.col("number")).alias("slot"), "word").repartition("word").sortWithinPartitions("slot")
    return words.mapInArrow(run, "block bigint, numbers binary, sizes binary, ids binary")


def codes_of(parts: list[dict]) -> list[bytes]:
    """Ids of a block's words as bytes, in order of the words' numbers."""
    codes: list[bytes] = [b""] * sum(len(unpacked(part["sizes"])) for part in parts)
    for part in parts:
        data, at = unpacked(part["ids"]).tobytes(), 0
        for number, size in zip(unpacked(part["numbers"]).tolist(), (unpacked(part["sizes"]) * 4).tolist(), strict=True):
            codes[number] = data[at:at + size]
            at += size
    return codes


def pieces_of(found: pa.ListScalar) -> dict[int, bytes]:
    """A block's pieces by id."""
    if not found.is_valid:
        return {}
    return dict(zip(found.values.field("id").to_pylist(), found.values.field("piece").to_pylist(), strict=True))


def used_pieces(tables: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """The pieces of the ids that each block has, by a join with the id-to-piece table."""

    @F.pandas_udf("array<int>")
    def distinct(ids: pd.Series) -> pd.Series:
        return ids.map(lambda one: np.unique(unpacked(one)).astype(np.int32))

    table = pieces(docs, path)
    each = tables.select("block", F.explode("parts.ids").alias("ids")).select("block", F.explode(distinct("ids")).alias("id")).distinct().join(small(table, table.count(), MAX_BROADCAST_PIECES), "id")
    return each.groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """One row per row: the key, ``ids`` (little-endian unsigned 32-bit numbers) and ``decoded`` text."""
    dealt = bucketed(blocks(docs, partial(word_splitter, path), "string", key=key, text=text, block_bytes=block_bytes), "bpe-blocks", "block")
    tables = encoded_words(dealt, path).groupBy("block").agg(F.collect_list(F.struct("numbers", "sizes", "ids")).alias("parts"))

    def output(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.binary(), pa.string()), strict=True)], ["key", "ids", "decoded"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("keys").type.value_type
            for row in range(batch.num_rows):
                keys, counts, places, codes = (batch.column(name)[row].as_py() for name in ("keys", "counts", "places", "parts"))
                codes, piece = codes_of(codes or []), pieces_of(batch.column("pieces")[row])
                parts = [b"".join(map(piece.__getitem__, np.frombuffer(code, "<u4").tolist())) for code in codes]
                places, at, rows, size = unpacked(places), 0, [], 0
                for one, count in zip(keys, unpacked(counts).tolist(), strict=True):
                    here = places[at:at + count].tolist()
                    at += count
                    ids = b"".join(map(codes.__getitem__, here))
                    rows.append((one, ids, b"".join(map(parts.__getitem__, here)).decode("utf-8", "replace")))
                    size += len(ids)
                    if size > OUTPUT_BYTES:
                        yield output(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield output(rows, kind)

    kind = dealt.schema["keys"].dataType.elementType.simpleString()
    whole = dealt.drop("words").join(tables, "block", "left").join(used_pieces(tables, docs, path), "block", "left")
    return whole.select("keys", "counts", "places", "parts", "pieces").mapInArrow(join_up, f"key {kind}, ids binary, decoded string").withColumnRenamed("key", key)
