"""Substring dedup over a partitioned suffix array.

A byte goes if some string of ``width`` bytes covers it that also starts in a document of a smaller rank. The strings are the
leading bytes of suffixes, which are sorted across the cluster: sampled splitters range-partition them by leading bytes, a
bucket sorts its own by multikey quicksort (eight bytes at a time), equal neighbours give the smallest rank of each string, and
what may go on in another bucket is compared across the boundaries.

Suffixes travel together. The smallest of a string's hashed 16-byte grams is its anchor, the same in each equal string, so the
suffixes that share an anchor are one row, its bytes once, and the range partitioning goes by the bytes at the anchor: equal
strings are neighbours there too. An anchor is sent only if the bytes around it occur again: its strings reach half of the
remaining width to its left, or to its right, and the hash of that reach is looked up among those of all blocks. Both are
exact reductions; a hash that is met by chance costs a row and no more. Rows go on to the splitters with their rank, so that a
gram which holds a large part of all suffixes is dealt over many buckets.

Documents of one text are one: those of a rank above the smallest go whole, and only the smallest takes part.

Defined cases: a null text is the empty text; texts shorter than ``width`` bytes have no strings and stay; matches never cross
documents; rows with one id have one rank and do not remove from each other; a null id ranks below all others; repeated rows
have a row each; what is kept may end inside a character and is therefore binary; columns other than key and text take no
part, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.blocks import text_blocks
from gazette.llm.common import bucketed, partitions, stage

GRAM = 16
SLICE = 1 << 20
CHUNK = 8192
SALTS = 32
OUTPUT_BYTES = 4 << 20
LOW = np.uint64((1 << 40) - 1)
#: Bits of a place in a slice and the strings that begin in it.
PLACES = np.uint64(2 * SLICE - 1)
STIR = np.uint64(0x9E3779B97F4A7C15)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, first byte highest: numbers sort as the bytes do."""
    words = data.astype(np.uint64)
    for width in (1, 2, 4):
        words = (words[:-width] << np.uint64(8 * width)) | words[width:]
    return words


def ranks() -> Column:
    """Ranks of a block's documents: their ids, the null one below all others."""
    return F.transform("keys", lambda one: F.coalesce(one.cast("long"), F.lit(-(2**63))))


def copies(dealt: DataFrame) -> DataFrame:
    """Numbers, by block, of the documents whose text a document of a smaller rank has."""
    each = dealt.select("block", F.posexplode(F.arrays_zip(ranks().alias("ranks"), "digests")).alias("number", "one")).select("block", "number", "one.ranks", "one.digests")
    least = each.groupBy("digests").agg(F.min("ranks").alias("least"), F.max("ranks").alias("most")).where("most > least").select("digests", "least")
    # The texts of large groups are dealt over several tasks.
    least = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("block", "number"), F.lit(SALTS)).cast("int"))
    return each.join(least, ["digests", "salt"]).where("ranks > least").groupBy("block").agg(F.collect_list("number").alias("copies"))


class Texts:
    """The documents of a block that take part, one after the other: long enough, and no copies."""

    def __init__(self, row: dict, width: int):
        self.width, self.sizes = width, np.array(row["sizes"], np.int64)
        self.body = zstandard.ZstdDecompressor().decompress(row["body"])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        part = self.sizes >= width
        part[row["copies"] or []] = False
        self.part = np.flatnonzero(part)
        self.data = np.frombuffer(b"".join(self.body[self.starts[n]:self.starts[n + 1]] for n in self.part.tolist()), np.uint8)
        self.ends = np.cumsum(self.sizes[self.part])

    def anchors(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Slice by slice: the first and last of the strings that share an anchor, the anchor, and hashes of its two reaches (0: none)."""
        width, span = self.width, self.width - GRAM + 1
        half, count = (width - GRAM) // 2, len(self.data) - width + 1
        crossing = np.zeros(max(count, 0) + width, np.int8)
        for end in self.ends[:-1].tolist():
            crossing[end - width + 1:end] = 1
        for low in range(0, max(count, 0), SLICE):
            high = min(low + SLICE, count)
            words = eights(self.data[low:high + width - 1])
            grams = stirred(words[:-8] * STIR + words[8:])
            # The high bits of a hash and its place are one number: the smallest is the leftmost gram of the smallest hash.
            least, reach = grams & ~PLACES | np.arange(len(grams), dtype=np.uint64), 1
            while reach < span:
                step = min(reach, span - reach)
                least = np.minimum(least[:-step], least[step:])
                reach += step
            place = (least & PLACES).astype(np.int32)
            whole = crossing[low:high] == 0
            change = np.concatenate([[True], (place[1:] != place[:-1]) | ~whole[:-1]])
            firsts = np.flatnonzero(whole & change)
            lasts = np.flatnonzero(whole & np.concatenate([change[1:] | ~whole[1:], [True]]))
            anchor = place[firsts].astype(np.int64)
            left, right = firsts <= anchor - half, lasts >= anchor - half + 1
            reaches = []
            for own, offsets, salt in ((left, [*range(-half, 0, GRAM), 0], 1), (right, [*range(0, width - half + 1 - GRAM, GRAM), width - half + 1 - GRAM], 2)):
                mixed = np.full(int(own.sum()), salt, np.uint64)
                for offset in offsets:
                    mixed = stirred(mixed * STIR + grams[anchor[own] + offset])
                found = np.zeros(len(anchor), np.uint64)
                found[own] = np.maximum(mixed, 1)
                reaches.append(found)
            yield firsts + low, lasts + low, anchor + low, *reaches

    def document(self, places: np.ndarray) -> np.ndarray:
        """Numbers in the block of the documents at these places."""
        return self.part[np.searchsorted(self.ends, places, "right")]


def bucket_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A hash's bucket, from its high bits, and 40 low bits, in one number."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) << np.uint64(40)) | (hashes & LOW)


def increasing(numbers: np.ndarray) -> bytes:
    """Increasing numbers below 2**40 as compressed byte planes of their steps."""
    steps = np.diff(numbers, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def numbers_of(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(5, -1)
    cells = np.zeros((planes.shape[1], 8), np.uint8)
    cells[:, :5] = planes.T
    return np.cumsum(cells.view(np.uint64).ravel(), dtype=np.uint64)


def block_keys(texts: Texts, anchors: list[tuple], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block's reaches, increasing, and which of them several of its documents have."""
    pairs = []
    for firsts, _, _, *reaches in anchors:
        document = texts.document(firsts)
        for hashes in reaches:
            own = hashes > 0
            pairs.append(np.stack([bucket_keys(hashes[own], buckets), document[own].astype(np.uint64)]))
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys, document = np.concatenate(pairs, axis=1)
    order = np.argsort(keys)
    keys, document = keys[order], document[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    other = np.concatenate([[False], (keys[1:] == keys[:-1]) & (document[1:] != document[:-1])]) if len(keys) else fresh
    starts = np.flatnonzero(fresh)
    return keys[starts], np.add.reduceat(other, starts) > 0 if len(starts) else other


def shared_reaches(whole: DataFrame, width: int, buckets: int) -> DataFrame:
    """For each block, a bit for each of its distinct keys, bucket by bucket: whether another block has the key too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = Texts(row, width)
                keys, _ = block_keys(texts, list(texts.anchors()), buckets)
                own = (keys >> np.uint64(40)).astype(np.int64)
                for part in np.split(keys, np.flatnonzero(np.diff(own)) + 1) if len(keys) else []:
                    values = [int(part[0] >> np.uint64(40)), row["block"], increasing(part & LOW)]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "block", "keys"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [numbers_of(one) for one in table.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        met = np.zeros(len(keys), bool)
        met[order[1:][same]] = met[order[:-1][same]] = True
        flags = [np.packbits(one).tobytes() for one in np.split(met, np.cumsum([len(one) for one in parts])[:-1])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "flags": pa.array(flags, pa.binary())})

    sent = whole.select("block", "sizes", "body", "copies").mapInArrow(send, "bucket int, block bigint, keys binary")
    return sent.groupBy("bucket").applyInArrow(meet, "block bigint, bucket int, flags binary").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "flags"))).alias("met"))


ROW = "lead binary, bytes binary, rank bigint, block bigint, at int"


def suffix_rows(whole: DataFrame, width: int, buckets: int) -> DataFrame:
    """Strings around anchors whose reach occurs again: the anchor's gram, their bytes, rank, and place of the first in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = Texts(row, width)
                anchors = list(texts.anchors())
                keys, again = block_keys(texts, anchors, buckets)
                counts = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=buckets)
                if row["met"]:
                    again = again | np.concatenate([np.unpackbits(np.frombuffer(one["flags"], np.uint8))[:counts[one["bucket"]]].astype(bool) for one in row["met"]])
                again = np.append(again, False)
                rank = np.array(row["ranks"], np.int64)
                for firsts, lasts, anchor, *reaches in anchors:
                    own = np.zeros(len(firsts), bool)
                    for hashes in reaches:
                        own |= again[np.where(hashes > 0, np.searchsorted(keys, bucket_keys(hashes, buckets)), len(keys))]
                    for some in np.array_split(np.flatnonzero(own), max(int(own.sum()) // 16384, 1)):
                        sizes = lasts[some] - firsts[some] + width
                        offsets = np.concatenate([[0], np.cumsum(sizes)])
                        flat = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - firsts[some], sizes)
                        lead = (anchor[some][:, None] + np.arange(GRAM)).ravel()
                        yield pa.RecordBatch.from_arrays([
                            binary(texts.data[lead], np.arange(len(some) + 1) * GRAM), binary(texts.data[flat], offsets), pa.array(rank[texts.document(firsts[some])]),
                            pa.array(np.full(len(some), row["block"])), pa.array(firsts[some].astype(np.int32)),
                        ], ["lead", "bytes", "rank", "block", "at"])

    return whole.select("block", "sizes", "body", "copies", ranks().alias("ranks"), "met").mapInArrow(run, ROW)


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def multikey_order(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings in the order of their bytes, and where a string differs from the one before it.

    Eight bytes are a key; the next key is looked at only where strings are equal up to it.
    """
    first = words[starts]
    order = np.argsort(first)
    fresh = np.concatenate([[True], np.diff(first[order]) != 0])
    for offset in [*range(8, width - 8, 8), width - 8]:
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        if not len(tied):
            break
        group, some = np.cumsum(fresh)[tied], order[tied]
        keys = words[starts[some] + offset]
        # A group whose strings agree here too is left as it is.
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        differs = np.concatenate([[False], (keys[1:] != keys[:-1]) & (group[1:] == group[:-1])])
        mixed = np.repeat(np.logical_or.reduceat(differs, begins), np.diff(np.append(begins, len(group))))
        tied, group, some, keys = tied[mixed], group[mixed], some[mixed], keys[mixed]
        if not len(tied):
            continue
        inside = np.lexsort((keys, group))
        keys, order[tied] = keys[inside], some[inside]
        fresh[tied] |= np.concatenate([[True], (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])])
    return order, fresh


MARK = "block bigint, at int, bits bigint, string binary, rank bigint"


def compared(rows: DataFrame, width: int) -> DataFrame:
    """What a bucket finds of its rows: bits of the strings that a smaller rank has, and strings that other buckets may have too."""

    def chunk(table: pa.Table) -> pa.RecordBatch:
        column = table.column("bytes").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        leads = table.column("lead").to_pylist()
        rank, block, at = (table.column(name).to_numpy() for name in ("rank", "block", "at"))
        count = np.diff(offsets) - width + 1
        begin = np.concatenate([[0], np.cumsum(count)])
        owner, number = np.repeat(np.arange(len(count)), count), np.arange(begin[-1]) - np.repeat(begin[:-1], count)
        starts = offsets[owner] + number
        order, fresh = multikey_order(eights(data[:offsets[-1]]), starts, width)
        least = np.empty(len(order), np.int64)
        least[order] = np.minimum.reduceat(rank[owner[order]], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        bits = np.bitwise_or.reduceat(np.where(rank[owner] > least, np.int64(1) << number, 0), begin[:-1])
        # The first and the last gram may go on in the chunk or bucket before or after.
        edge = np.array([one == leads[0] or one == leads[-1] for one in leads], bool)
        ask = np.flatnonzero(edge[owner] & (rank[owner] == least))
        strings = [xxhash.xxh3_128_digest(data[one:one + width].tobytes()) for one in starts[ask].tolist()]
        hit, asker = np.flatnonzero(bits), owner[ask]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([block[hit], block[asker]])), pa.array(np.concatenate([at[hit], at[asker]]).astype(np.int32)),
            pa.array(np.concatenate([bits[hit], np.int64(1) << number[ask]])), pa.array([None] * len(hit) + strings, pa.binary()),
            pa.array(np.concatenate([np.zeros(len(hit), np.int64), rank[asker]])),
        ], ["block", "at", "bits", "string", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                kept.append(batch.slice(low, CHUNK))
                size += kept[-1].num_rows
                if size >= CHUNK:
                    yield chunk(pa.Table.from_batches(kept))
                    kept, size = [], 0
        if size:
            yield chunk(pa.Table.from_batches(kept))

    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "lead", "rank", "block", "at").sortWithinPartitions("lead", "rank")
    return ranged.mapInArrow(run, MARK)


def across(found: DataFrame) -> DataFrame:
    """Bits of the strings that buckets hold in common: all but those of the smallest rank."""
    asked = found.where("string IS NOT NULL")
    least = asked.groupBy("string").agg(F.min("rank").alias("least"))
    return asked.join(least, "string").where("rank > least").select("block", "at", "bits")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row: the key, ``n_bytes`` of its text, the ``spans`` (start, length) that go, and the ``kept`` bytes."""
    if not 2 * GRAM < width <= GRAM + 62:
        raise ValueError(f"strings are longer than {2 * GRAM} bytes and have at most {GRAM + 62}")
    buckets = partitions(docs.sparkSession)
    dealt = bucketed(text_blocks(docs, key, text, block_bytes), "suffix-blocks", "block")
    whole = dealt.join(stage(copies(dealt), "suffix-copies"), "block", "left")
    met = stage(shared_reaches(whole, width, buckets), "suffix-reaches")
    found = stage(compared(suffix_rows(whole.join(met, "block", "left"), width, buckets), width), "suffix-marks")
    marks = found.where("string IS NULL").select("block", "at", "bits").union(across(found)).groupBy("block").agg(F.collect_list(F.struct("at", "bits")).alias("marks"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            arrow = batch.schema.field("keys").type.value_type
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names if name != "marks"}
                texts, cells = Texts(row, width), batch.column("marks")[n].values
                gone = covered(texts, cells)
                begins = dict(zip(texts.part.tolist(), np.concatenate([[0], texts.ends[:-1]]).astype(int).tolist(), strict=False))
                dropped, rows, size = set(row["copies"] or []), [], 0
                for number, one in enumerate(row["keys"]):
                    data = texts.body[texts.starts[number]:texts.starts[number + 1]]
                    spans: list[tuple[int, int]] = []
                    if number in dropped and len(data) >= width:
                        spans, kept = [(0, len(data))], b""
                    elif number in begins and (own := gone[begins[number]:begins[number] + len(data)]).any():
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                        spans, kept = list(zip(edges[0::2].tolist(), np.diff(edges)[0::2].tolist())), np.frombuffer(data, np.uint8)[~own].tobytes()
                    else:
                        kept = data
                    rows.append((one, len(data), [{"start": a, "length": b} for a, b in spans], kept))
                    size += len(kept) + 64
                    if size > OUTPUT_BYTES or number == len(row["keys"]) - 1:
                        columns = zip(zip(*rows, strict=True), (arrow, pa.int64(), span, pa.binary()), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["key", "n_bytes", "spans", "kept"])
                        rows, size = [], 0

    marked = whole.join(marks, "block", "left").select("keys", "sizes", "body", "copies", "marks")
    return marked.mapInArrow(run, f"key {kind}, n_bytes bigint, spans array<struct<start:bigint,length:bigint>>, kept binary").withColumnRenamed("key", key)


def covered(texts: Texts, cells: pa.Array | None) -> np.ndarray:
    """Bytes of the documents that take part that a marked string covers."""
    edges = np.zeros(len(texts.data) + 1, np.int32)
    if cells is not None and len(cells):
        at, bits = (cells.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("at", "bits"))
        for number in range(texts.width - GRAM + 1):
            some = np.unique(at[(bits >> number) & 1 > 0]) + number
            np.add.at(edges, some, 1)
            np.subtract.at(edges, some + texts.width, 1)
    return np.cumsum(edges[:-1]) > 0
