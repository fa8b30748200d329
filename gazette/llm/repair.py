"""Token ids in grammar-compressed binary files (Re-Pair).

Documents are range-partitioned and sorted by id, encoded, and cut into shards of neighbouring documents. In a shard,
frequent pairs of symbols inside a document are replaced by nonterminals, many pairs at a time that cannot overlap, and
again until no pair is frequent. The shard's payload stores the rules, the length of each nonterminal's expansion, the
documents' ends and the symbols at a fixed width, so that any range of a document's ids is decoded without the rest.

Payload, little-endian: ``RPR1``; numbers of terminals, rules, documents and symbols and the symbol width in bytes (5 x
u32); rules (2 x u32 each); expansion lengths (u32); symbols before each document's end (u32); ids before each document's
end (u32); symbols.

Defined cases: a null text is the empty text and holds the end id alone; documents with one id follow each other in order
of their texts; a null id comes first; a document longer than a shard is a shard alone; no rows give no shards; columns other
than key and text take no part.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import partitions, stage
from gazette.llm.ranks import text_ids

MAGIC = b"RPR1"


@cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """One encoder for all tasks of a worker."""
    return text_ids(path, arrays=True)


def frequent(pairs: np.ndarray, least: int, most: int) -> list[int]:
    """Pairs (two symbols in one number) that occur at least ``least`` times and cannot overlap, most frequent first."""
    values, counts = np.unique(pairs, return_counts=True)
    many = np.flatnonzero(counts >= least)
    many = many[np.lexsort((values[many], -counts[many]))]
    firsts, seconds, chosen = set(), set(), []
    for pair in values[many].tolist():
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a in seconds or b in firsts or (a == b and (a in firsts or b in seconds)):
            continue
        firsts.add(a)
        seconds.add(b)
        chosen.append(pair)
        if len(chosen) == most:
            break
    return chosen


def pair_cells(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Cells of pairs in a small table."""
    return ((first * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77)) >> np.uint32(14)).astype(np.intp)


def grammar(symbols: np.ndarray, ends: np.ndarray, terminals: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules, symbols and document ends after replacement; ``ends`` are the symbols before each document's end."""
    symbols, rules, size = symbols.astype(np.uint32), [], terminals
    last = np.zeros(len(symbols), bool)
    last[ends - 1] = True
    # A pair that was rare stays so: later rounds look at those that were frequent and at those that have a new symbol.
    alive = ~last
    while len(symbols) > 1:
        # A frequent pair is in a well-filled cell of a small table: only the pairs of such cells are sorted and counted.
        at = np.flatnonzero(alive)
        cells = pair_cells(symbols[at], symbols[at + 1])
        filled = (np.bincount(cells, minlength=1 << 18) >= least)[cells]
        at, cells = at[filled], cells[filled]
        pairs = symbols[at].astype(np.int64) << 32 | symbols[at + 1]
        chosen = frequent(pairs, least, most)
        if not chosen:
            break
        known = np.array(sorted(chosen), np.int64)
        wanted = np.zeros(1 << 18, bool)
        wanted[pair_cells((known >> 32).astype(np.uint32), known.astype(np.uint32))] = True
        alive[:] = False
        alive[at] = True
        some = wanted[cells]
        at, pairs = at[some], pairs[some]
        which = np.searchsorted(known, pairs)
        hit = known[np.minimum(which, len(known) - 1)] == pairs
        at, which = at[hit], which[hit]
        # Hits follow each other without a gap only in a run of one symbol: there every second one counts.
        run_starts = np.concatenate([[True], np.diff(at) != 1])
        in_run = np.arange(len(at)) - np.maximum.accumulate(np.where(run_starts, np.arange(len(at)), 0))
        at, which = at[in_run % 2 == 0], which[in_run % 2 == 0]
        symbols[at] = size + which
        last[at] = last[at + 1]
        alive[at] = alive[at[at > 0] - 1] = True
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last, alive = symbols[keep], last[keep], alive[keep]
        alive &= ~last
        rules.append(np.stack([known >> 32, known & 0xFFFFFFFF], 1))
        size += len(known)
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), symbols, np.flatnonzero(last) + 1


def pack(texts: list[bytes], least: int = 64, most: int = 4096) -> bytes:
    """Payload of the documents of a shard, each the bytes of its ids; every document has an id at least."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    ends = np.cumsum([len(one) // 4 for one in texts])
    terminals = int(ids.max()) + 1
    rules, symbols, symbol_ends = grammar(ids, ends, terminals, least, most)
    lengths = [1] * terminals
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    width = 2 if len(lengths) <= 1 << 16 else 3 if len(lengths) <= 1 << 24 else 4
    body = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    head = struct.pack("<5I", terminals, len(rules), len(texts), len(symbols), width)
    parts = [rules.ravel(), lengths[terminals:], symbol_ends, ends]
    return MAGIC + head + b"".join(np.asarray(part, "<u4").tobytes() for part in parts) + body


class Shard:
    """A payload for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.terminals, rules, self.docs, count, width = struct.unpack_from("<5I", payload, 4)
        numbers = np.frombuffer(payload, "<u4", 3 * rules + 2 * self.docs, 24).astype(np.int64)
        self.rules, self.lengths, self.symbol_ends, self.ends = np.split(numbers, np.cumsum([2 * rules, rules, self.docs]))
        cells = np.zeros((count, 4), np.uint8)
        cells[:, :width] = np.frombuffer(payload, np.uint8, count * width, 24 + 4 * len(numbers)).reshape(count, width)
        self.symbols = cells.view("<u4").ravel().astype(np.int64)
        self.expansions: list[bytes] = []

    def document(self, number: int) -> bytes:
        """All ids of a document as bytes."""
        if not self.expansions:
            self.expansions = [struct.pack("<I", one) for one in range(self.terminals)]
            for a, b in self.rules.reshape(-1, 2).tolist():
                self.expansions.append(self.expansions[a] + self.expansions[b])
        first = self.symbol_ends[number - 1] if number else 0
        return b"".join(map(self.expansions.__getitem__, self.symbols[first:self.symbol_ends[number]].tolist()))

    def ids(self, number: int, start: int, stop: int) -> list[int]:
        """The ids ``start`` to ``stop`` of a document: expansion lengths lead to them, nothing else is expanded."""
        first = self.symbol_ends[number - 1] if number else 0
        symbols = self.symbols[first:self.symbol_ends[number]]
        size = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])
        ends = np.cumsum(size[symbols])
        at = int(np.searchsorted(ends, start, "right"))
        place, found = int(ends[at - 1]) if at else 0, []
        todo = symbols[at:int(np.searchsorted(ends, stop, "left")) + 1][::-1].tolist()
        while todo and place < stop:
            symbol = todo.pop()
            if place + size[symbol] <= start:
                place += int(size[symbol])
            elif symbol < self.terminals:
                found.append(symbol)
                place += 1
            else:
                a, b = self.rules[2 * (symbol - self.terminals):][:2].tolist()
                todo += [b, a]
        return found


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, shard_ids: int = 1 << 20, least: int = 64, files: int | None = None) -> DataFrame:
    """Encode, compress and write; the archive as read back: ``file`` and ``shard`` (in order of the keys), keys, payload."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.repartitionByRange(files or partitions(docs.sparkSession), "key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, made = encoder(path), TaskContext.get().partitionId(), 0
        end = struct.pack("<I", end_id)
        keys, texts, size, arrow = [], [], 0, None

        def shard() -> pa.RecordBatch:
            values = [file, made, keys, sum(map(len, texts)) // 4, pack(texts, least)]
            kinds = [pa.int32(), pa.int32(), pa.list_(arrow), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["file", "shard", "keys", "n_ids", "payload"])

        for batch in batches:
            arrow = batch.schema.field(0).type
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(encode(body.as_py() or ""), "<u4").tobytes() + end
                if keys and size + len(ids) > 4 * shard_ids:
                    yield shard()
                    made, keys, texts, size = made + 1, [], [], 0
                keys.append(one)
                texts.append(ids)
                size += len(ids)
        if keys:
            yield shard()

    return stage(rows.mapInArrow(run, f"file int, shard int, keys array<{kind}>, n_ids bigint, payload binary"), "token-ids")


def shard_starts(archive: DataFrame) -> DataFrame:
    """Ids before each shard: a running sum over the shards of a file, and one over the files, of which there are few."""
    files = archive.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("file").orderBy("shard")) - F.col("n_ids")
    return archive.select("file", "shard", inside.alias("inside")).join(before, "file").select("file", "shard", (F.col("before") + F.col("inside")).alias("shard_start"))


def read(archive: DataFrame) -> DataFrame:
    """One row per document: file, shard, key, offset in the shard, ``n_ids``, ``ids`` (little-endian unsigned 32-bit numbers)."""
    kind = archive.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file, number, keys, payload = (batch.column(name)[row].as_py() for name in ("file", "shard", "keys", "payload"))
                shard, at = Shard(payload), 0
                for first in range(0, len(keys), 64):
                    some = keys[first:first + 64]
                    ids = [shard.document(first + i) for i in range(len(some))]
                    sizes = [len(one) // 4 for one in ids]
                    offsets = [at + sum(sizes[:i]) for i in range(len(some))]
                    at += sum(sizes)
                    columns = [[file] * len(some), [number] * len(some), some, offsets, sizes, ids]
                    kinds = [pa.int32(), pa.int32(), batch.column("keys").type.value_type, pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "shard", "key", "offset", "n_ids", "ids"])

    return archive.select("file", "shard", "keys", "payload").mapInArrow(run, f"file int, shard int, key {kind}, offset bigint, n_ids bigint, ids binary")
