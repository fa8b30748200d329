"""Alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizers give each text tokens whose bytes join up to the same text, so a tokenizer is a sorted list of byte ends. The
texts of a task follow each other in two long lists of ends, A's and B's, and merging them visits every overlap. The merge
is cut on diagonals at equal distances: a binary search on each finds how many ends of A and of B come before it. The pieces
are rows of equal work, whatever the lengths of the texts in them, and are merged independently of each other: a piece emits
the overlaps that end in it, and the groups between the ends that A and B share. Texts that several pieces hold are stitched:
what a piece holds of a group that is open at its border is put together, in the order of the pieces, with what the next holds.

Pairs of ids are counted over the whole corpus. Every piece sends each of its distinct pairs once, to be counted and to be
looked up, and the counts come back to the piece by its number.

Defined cases: a null or empty text, or one whose tokens of A or B do not join up to a blank and the text, has no tokens:
zeros and an empty ``groups``; strings of special tokens in texts are plain text; repeated rows and null keys have a row each,
and repeated rows count again in the counts of pairs; columns other than key and text take no part, whatever their names; no
rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import bucketed, stage
from gazette.llm.ranks import piece_bytes, text_ids

#: Bits of numbers inside a task: its documents (40) and its pieces (24).
DOCUMENT_BITS, PIECE_BITS = 40, 24
OUTPUT_BYTES = 4 << 20


class ByteLevel:
    """A byte-level BPE file of the tokenizers library, its special tokens' strings plain text."""

    def __init__(self, path: str):
        self.pieces, self.ids = piece_bytes(path), text_ids(path, plain_specials=True)


class Pieces:
    """A sentencepiece model with byte fallback: the library puts the blank before the text itself."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.pieces = [bytes([int(name[3:5], 16)]) if library.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.ids = lambda text: library.encode(text[1:])


@cache
def tokenizers(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """One pair for all tasks of a worker."""
    return ByteLevel(path_a), Pieces(path_b)


@cache
def byte_sizes(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    a, b = tokenizers(path_a, path_b)
    return tuple(np.array([len(piece) for piece in one.pieces], np.int32) for one in (a, b))


@cache
def written_ids(path_a: str, path_b: str) -> list[str]:
    """How ids are written in groups: A's with ``,`` or ``|`` after them, then B's with ``,`` or ``;``."""
    a, b = tokenizers(path_a, path_b)
    return [f"{one}{mark}" for tokens, marks in ((a, ",|"), (b, ",;")) for one in range(len(tokens.pieces)) for mark in marks]


def tokens_of(text: str | None, a: ByteLevel, b: Pieces) -> tuple[list[int], list[int]]:
    if not text:
        return [], []
    whole = (" " + text).encode()
    ids_a, ids_b = a.ids(" " + text), b.ids(" " + text)
    if b"".join(map(a.pieces.__getitem__, ids_a)) != whole or b"".join(map(b.pieces.__getitem__, ids_b)) != whole:
        return [], []
    return ids_a, ids_b


def diagonal(ends_a: np.ndarray, ends_b: np.ndarray, at: int) -> tuple[int, int]:
    """How many ends of A and of B are merged first, ``at`` of them in all; one more where a shared end would be cut apart."""
    low, high = max(0, at - len(ends_b)), min(at, len(ends_a))
    while low < high:
        middle = (low + high) // 2
        if ends_a[middle] <= ends_b[at - middle - 1]:
            low = middle + 1
        else:
            high = middle
    i, j = low, at - low
    return i, j + int(0 < i and j < len(ends_b) and ends_a[i - 1] == ends_b[j])


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


PIECE = "piece bigint, documents array<bigint>, keys array<{kind}>, counts_a binary, counts_b binary, a binary, b binary, lead int, next_a int, next_b int, open_first boolean, open_last boolean"


def pieces(docs: DataFrame, path_a: str, path_b: str, key: str, text: str, steps: int) -> DataFrame:
    """Pieces of the merges, ``steps`` long: what they hold of each document, ids, and the ids that the border cuts.

    ``lead`` is how far A's first token begins after B's first one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), sizes = tokenizers(path_a, path_b), byte_sizes(path_a, path_b)
        task, made, documents = TaskContext.get().partitionId(), 0, 0
        kept: list[tuple[object, np.ndarray, np.ndarray]] = []
        work, arrow = 0, None

        def cut() -> Iterator[pa.RecordBatch]:
            nonlocal made, documents
            ids = [np.concatenate([row[side] for row in kept]) for side in (1, 2)]
            starts = [np.cumsum([0, *(len(row[side]) for row in kept)]) for side in (1, 2)]
            ends = [np.cumsum(size[one], dtype=np.int64) for size, one in zip(sizes, ids, strict=True)]
            whole = sum(map(len, ids))
            count = max(round(whole / steps), 1)
            borders = [diagonal(*ends, whole * n // count) for n in range(count)] + [(len(ids[0]), len(ids[1]))]
            path = starts[0] + starts[1]
            for n, (low, high) in enumerate(zip(borders, borders[1:])):
                first = max(int(np.searchsorted(path, sum(low), "right")) - 1, 0) if n else 0
                last = int(np.searchsorted(path, sum(high), "left")) if n < count - 1 else len(kept)
                # Documents without tokens at a border are the later piece's.
                while n and path[first] == sum(low) == path[first - 1]:
                    first -= 1
                counts = [np.diff(np.clip(one[first:last + 1], low[side], high[side])) for side, one in enumerate(starts)]
                before = [int(one[at - 1]) if at else 0 for one, at in zip(ends, low, strict=True)]
                following = [int(one[at]) if at < len(one) else -1 for one, at in zip(ids, high, strict=True)]
                values = [
                    (task << PIECE_BITS) + made, [(task << DOCUMENT_BITS) + documents + at for at in range(first, last)], [row[0] for row in kept[first:last]],
                    packed(counts[0]), packed(counts[1]), packed(ids[0][low[0]:high[0]]), packed(ids[1][low[1]:high[1]]), before[0] - before[1], *following,
                    bool(path[first] < sum(low)), bool(path[last] > sum(high)),
                ]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(arrow), *[pa.binary()] * 4, *[pa.int32()] * 3, pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)
                made += 1
            documents += len(kept)

        for batch in batches:
            arrow = batch.schema.field(0).type
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                kept.append((one, *(np.array(ids, np.int32) for ids in tokens_of(body.as_py(), a, b))))
                work += len(kept[-1][1]) + len(kept[-1][2]) + 1
                if work >= steps:
                    yield from cut()
                    kept, work = [], 0
        if kept:
            yield from cut()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = PIECE.format(kind=rows.schema["key"].dataType.simpleString())
    names = [one.split()[0] for one in schema.replace(", ", "\n").split("\n")]
    return rows.mapInArrow(run, schema)


class Merge:
    """A piece, merged: ``shared_a`` and ``shared_b`` are its tokens at whose ends both tokenizers end."""

    def __init__(self, row: dict, sizes: tuple[np.ndarray, np.ndarray]):
        self.a, self.b = (unpacked(row[name]).astype(np.int32) for name in ("a", "b"))
        self.counts_a, self.counts_b = (unpacked(row[name]).astype(np.int64) for name in ("counts_a", "counts_b"))
        self.next_a, self.next_b = row["next_a"], row["next_b"]
        self.ends_a = np.cumsum(sizes[0][self.a], dtype=np.int64) + row["lead"]
        self.ends_b = np.cumsum(sizes[1][self.b], dtype=np.int64)
        if len(self.a) and len(self.b):
            at = np.minimum(np.searchsorted(self.ends_b, self.ends_a), len(self.b) - 1)
            self.shared_a = np.flatnonzero(self.ends_b[at] == self.ends_a)
            self.shared_b = at[self.shared_a]
        else:
            self.shared_a = self.shared_b = np.zeros(0, np.int64)

    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B of every overlap that ends in the piece, in order, and whether both tokens end there."""
        alone = np.ones(len(self.a), bool)
        alone[self.shared_a] = False
        at_b = np.searchsorted(self.ends_b, self.ends_a[alone])
        at_a = np.searchsorted(self.ends_a, self.ends_b)
        ids_a, ids_b = np.append(self.a, self.next_a), np.append(self.b, self.next_b)
        together = np.zeros(len(self.b), bool)
        together[self.shared_b] = True
        order = np.argsort(np.concatenate([self.ends_a[alone], self.ends_b]), kind="stable")
        return (
            np.concatenate([self.a[alone], ids_a[at_a]])[order], np.concatenate([ids_b[at_b], self.b])[order],
            np.concatenate([np.zeros(int(alone.sum()), bool), together])[order],
        )

    def links(self) -> np.ndarray:
        """Pairs of ids (A's and B's in one number) of the overlaps whose tokens end together, in order."""
        a, b, together = self.overlaps()
        return (a[together].astype(np.int64) << 32) | b[together]

    def in_groups(self, width: int) -> np.ndarray:
        """Numbers in ``written_ids`` of all tokens, group by group, A's before B's; ``width`` is the number of A's ids."""
        codes_a, codes_b = self.a.astype(np.int64) * 2, (self.b.astype(np.int64) + width) * 2
        codes_a[self.shared_a] += 1
        codes_b[self.shared_b] += 1
        group_a, group_b = np.searchsorted(self.shared_a, np.arange(len(self.a))), np.searchsorted(self.shared_b, np.arange(len(self.b)))
        out = np.empty(len(codes_a) + len(codes_b), np.int64)
        out[np.arange(len(codes_a)) + np.concatenate([[0], self.shared_b + 1])[group_a]] = codes_a
        out[np.arange(len(codes_b)) + np.append(self.shared_a + 1, len(codes_a))[group_b]] = codes_b
        return out


def distinct_links(cut: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each piece's distinct pairs, numbered in their order, with how many of its links hold them: ``pair, piece, slot, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = byte_sizes(path_a, path_b)
        for batch in batches:
            for row in batch.to_pylist():
                pairs, n = np.unique(Merge(row, sizes).links(), return_counts=True)
                for at in range(0, len(pairs), 65536):
                    some = pairs[at:at + 65536]
                    columns = [some, np.full(len(some), row["piece"]), np.arange(at, at + len(some), dtype=np.int32), n[at:at + 65536].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pair", "piece", "slot", "n"])

    names = ["piece", "counts_a", "counts_b", "a", "b", "lead", "next_a", "next_b"]
    return cut.select(*names).mapInArrow(run, "pair bigint, piece bigint, slot int, n int")


def pair_counts(links: DataFrame) -> DataFrame:
    """Pairs of ids with their number of links in the corpus, and whether it is the highest of their B id: ``pair, links, best``."""
    counts = links.groupBy("pair").agg(F.sum("n").alias("links")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    highest = counts.groupBy("b").agg(F.max("links").alias("highest"))
    return counts.join(highest, "b").select("pair", "links", (F.col("links") == F.col("highest")).alias("best"))


PART = "document bigint, piece bigint, key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, whole boolean, groups string, open_a binary, open_b binary, shared boolean, last_a binary, last_b binary"


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", steps: int = 1 << 20) -> DataFrame:
    """One row per row: the key, ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups``.

    ``n_best`` are the links whose pair has the highest count of its B id, ``count_sum`` adds the counts of all links' pairs, and
    ``groups`` is written ``a1,a2|b1;a3|b2,b3`` with decimal ids.
    """
    cut = bucketed(pieces(docs, path_a, path_b, key, text, steps), "align-pieces", "piece")
    links = stage(distinct_links(cut, path_a, path_b), "align-links")
    rated = links.select("pair", "piece", "slot").join(pair_counts(links), "pair")
    found = rated.groupBy("piece").agg(F.collect_list(F.struct("slot", "links", "best")).alias("found"))
    kind = docs.schema[key].dataType.simpleString()
    schema = PART.format(kind=kind)
    names = [one.split()[0] for one in schema.replace(", ", "\n").split("\n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, written = byte_sizes(path_a, path_b), written_ids(path_a, path_b)
        for batch in batches:
            arrow = batch.schema.field("keys").type.value_type
            kinds = [pa.int64(), pa.int64(), arrow, *[pa.int64()] * 6, pa.bool_(), pa.string(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()]
            for number in range(batch.num_rows):
                row = {name: batch.column(name)[number].as_py() for name in batch.schema.names if name != "found"}
                merge, cells = Merge(row, sizes), batch.column("found")[number].values
                pairs, each = np.unique(merge.links(), return_inverse=True)
                counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
                if cells is not None:
                    slots = cells.field("slot").to_numpy(zero_copy_only=False)
                    counts[slots], best[slots] = cells.field("links").to_numpy(zero_copy_only=False), cells.field("best").to_numpy(zero_copy_only=False)
                counts, best = (np.concatenate([[0], np.cumsum(one[each.ravel()], dtype=np.int64)]) for one in (counts, best))
                ends_a, ends_b = np.concatenate([[0], np.cumsum(merge.counts_a)]), np.concatenate([[0], np.cumsum(merge.counts_b)])
                border = np.searchsorted(merge.shared_a, ends_a)
                codes, rows, size, last = merge.in_groups(len(sizes[0])), [], 0, len(row["documents"]) - 1
                for at, (document, one) in enumerate(zip(row["documents"], row["keys"], strict=True)):
                    low, high = int(border[at]), int(border[at + 1])
                    whole = not (at == 0 and row["open_first"]) and not (at == last and row["open_last"])
                    (from_a, to_a), (from_b, to_b) = ((int(ends[at]), int(ends[at + 1])) for ends in (ends_a, ends_b))
                    shared, parts = high > low, [None] * 4
                    if whole:
                        own = codes[from_a + from_b:to_a + to_b]
                    elif shared:
                        in_a, in_b = ((int(one[low]) + 1, int(one[high - 1]) + 1) for one in (merge.shared_a, merge.shared_b))
                        parts = [merge.a[from_a:in_a[0]], merge.b[from_b:in_b[0]], merge.a[in_a[1]:to_a], merge.b[in_b[1]:to_b]]
                        own = codes[in_a[0] + in_b[0]:in_a[1] + in_b[1]]
                    else:
                        parts, own = [merge.a[from_a:to_a], merge.b[from_b:to_b], *[np.zeros(0, np.int32)] * 2], codes[:0]
                    groups = "".join(map(written.__getitem__, own.tolist()))
                    parts = [one if one is None else one.astype("<i4").tobytes() for one in parts]
                    sums = (high - low, high - low, int(best[high] - best[low]), int(counts[high] - counts[low]))
                    rows.append((document, row["piece"], one, to_a - from_a, to_b - from_b, *sums, whole, groups[:-1] if whole else groups, parts[0], parts[1], shared, parts[2], parts[3]))
                    size += len(groups) + 100
                    if size > OUTPUT_BYTES or at == last:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0

    result = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    closed, opened = (cut.where(one).join(found, "piece", "left").mapInArrow(run, schema) for one in ("NOT open_first AND NOT open_last", "open_first OR open_last"))
    return closed.select(*result).union(stitched(opened).select(*result)).withColumnRenamed("key", key)


def stitched(parts: DataFrame) -> DataFrame:
    """Documents of pieces that are open at a border: sums over the pieces, and the groups put together in the pieces' order."""

    @F.pandas_udf("string")
    def joined(documents: pd.Series) -> pd.Series:
        def ids(data: bytes) -> list[str]:
            return [str(one) for one in np.frombuffer(data, "<i4").tolist()]

        def one(rows: list[dict]) -> str:
            if rows[0]["whole"]:
                return rows[0]["groups"]
            out, open_a, open_b = [], [], []
            for row in rows:
                open_a += ids(row["open_a"])
                open_b += ids(row["open_b"])
                if row["shared"]:
                    out.append(",".join(open_a) + "|" + ",".join(open_b) + ";" + row["groups"])
                    open_a, open_b = ids(row["last_a"]), ids(row["last_b"])
            return "".join(out)[:-1]

        return documents.map(one)

    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    whole = parts.groupBy("document").agg(
        F.first("key").alias("key"), *[F.sum(name).alias(name) for name in sums],
        F.sort_array(F.collect_list(F.struct("piece", "whole", "groups", "open_a", "open_b", "shared", "last_a", "last_b"))).alias("parts"),
    )
    return whole.withColumn("groups", joined("parts"))
