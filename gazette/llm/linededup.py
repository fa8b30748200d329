"""Substring dedup by hashing lines and the clauses in them.

A unit is a clause (up to a stop, comma, colon or semicolon) with the blanks after it, or the rest of a line with its line end;
``unit`` may also be ``"sentence"`` or ``"line"``. Units are normalised (letters, marks and digits in lower case, anything else between
them one space) and their digests are grouped over the whole corpus. The document of the smallest rank (its id) that holds a unit
keeps it; in every other it is a repeat. With ``inside``, the first place in that document alone keeps it. Repeats that follow each
other in a document, with nothing but empty units between, are a stretch, and a stretch of at least ``min_words`` words is cut, with
its offsets in the original text. Shorter repeats (license lines, greetings) stay.

Documents travel in blocks (see ``blocks``), and stay there: a block sends the digests of its distinct units, each with its smallest rank,
in sorted and compressed packets, one for each bucket, and gets a bit back for each, whether a smaller rank has the unit elsewhere.

Words are counted between blanks; in scripts written without blanks every two characters count as a word more.

Defined cases: units without a letter, mark or digit are empty; repeats inside one document stay unless ``inside``; a null text
stays null and has no units; a document may be left with an empty text; documents with one id have one rank and take nothing
from each other; a null id ranks before any other; the other columns of the input stay as they are,
whatever their names, but for columns named like the two that are added, which these replace; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.blocks import text_blocks, texts_of
from gazette.llm.common import bucketed, partitions
from gazette.llm.katz import increasing, increasing_of, numbers_of, packed, rows_of

MIN_WORDS = 25
OUTPUT_BYTES = 4 << 20
#: Where units end; the end of the text is one too.
ENDS = {
    "clause": r"""[.!?…,;:]["'”’»)\]]?[ \t]+|[。！？｡，；]|\n""",
    "sentence": r"""[.!?…]["'”’»)\]]?[ \t]+|[。！？｡]|\n""",
    "line": r"\n",
}
#: Letters of scripts that are written without blanks between words.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
BETWEEN, BETWEEN_MARKED, MARK = re.compile(r"[\W_]+"), regex.compile(r"[^\p{L}\p{M}\p{N}]+"), regex.compile(r"\p{M}")
ADDED = ["cut_starts", "cut_lengths"]


class Units:
    """The units of a block's texts that are not empty: document, offsets, words and digest (two numbers of 64 bits)."""

    def __init__(self, texts: list[str], unit: str):
        ends, document, starts, stops, words, digests, first = re.compile(ENDS[unit]).finditer, [], [], [], [], [], [0]
        for number, text in enumerate(texts):
            between = BETWEEN_MARKED if MARK.search(text) else BETWEEN
            unspaced = None if text.isascii() or not UNSPACED.search(text) else UNSPACED
            at = 0
            for end in [*(found.end() for found in ends(text)), len(text)]:
                body = between.sub(" ", text[at:end].lower()).strip()
                if body:
                    document.append(number)
                    starts.append(at)
                    stops.append(end)
                    words.append(body.count(" ") + 1 + (len(unspaced.findall(body)) // 2 if unspaced else 0))
                    digests.append(xxhash.xxh3_128_digest(body))
                at = end
            first.append(len(starts))
        self.document, self.first = np.array(document, np.int64), first
        self.starts, self.stops, self.words = starts, stops, np.array(words, np.int64)
        self.high, self.low = np.ascontiguousarray(np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).T).astype(np.uint64)

    def distinct(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct digests in order, the smallest rank of each in the block, and which one each unit has."""
        order = np.lexsort((self.low, self.high))
        high, low = self.high[order], self.low[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        starts, which = np.flatnonzero(fresh), np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        least = np.minimum.reduceat(ranks[self.document][order], starts) if len(starts) else np.zeros(0, np.int64)
        return high[starts], low[starts], least, which

    def again(self, which: np.ndarray) -> np.ndarray:
        """Units that their own document has before."""
        order = np.lexsort((np.arange(len(which)), self.document, which))
        found = np.zeros(len(which), bool)
        found[order[1:]] = (which[order[1:]] == which[order[:-1]]) & (self.document[order[1:]] == self.document[order[:-1]])
        return found


def buckets_of(high: np.ndarray, buckets: int) -> np.ndarray:
    return (((high >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def ranked(ranks: np.ndarray) -> np.ndarray:
    """Ranks as numbers from 0 on, for packets."""
    return ranks.view(np.uint64) ^ np.uint64(1 << 63)


def elsewhere(dealt: DataFrame, unit: str, buckets: int) -> DataFrame:
    """For each block, a bit for each of its distinct digests, bucket by bucket: whether another block has it with a smaller rank."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                units = Units([one.decode() for one in texts_of(row["body"], row["sizes"])], unit)
                high, low, least, _ = units.distinct(np.array(row["ranks"], np.int64))
                bucket = buckets_of(high, buckets)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist() if len(bucket) else []
                for a, b in zip(cuts, cuts[1:]):
                    values = [int(bucket[a]), row["block"], increasing(high[a:b]), packed(low[a:b]), packed(ranked(least[a:b]))]
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["bucket", "block", "high", "low", "least"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [increasing_of(one) for one in table.column("high").to_pylist()]
        high = np.concatenate(parts)
        low, rank = (np.concatenate([numbers_of(one) for one in table.column(name).to_pylist()]) for name in ("low", "least"))
        order = np.lexsort((rank, low, high))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
        least = rank[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        smaller = np.zeros(len(order), bool)
        smaller[order] = least < rank[order]
        flags = [np.packbits(one).tobytes() for one in np.split(smaller, np.cumsum([len(one) for one in parts])[:-1])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "size": pa.array([len(one) for one in parts], pa.int32()), "flags": pa.array(flags, pa.binary())})

    sent = dealt.select("block", "ranks", "sizes", "body").mapInArrow(send, "bucket int, block bigint, high binary, low binary, least binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "block bigint, bucket int, size int, flags binary")
    return met.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "size", "flags"))).alias("met"))


def stretches(repeated: np.ndarray, words: np.ndarray, first: int, last: int, min_words: int) -> list[tuple[int, int]]:
    """First and last units of the long enough stretches among a document's units ``first`` to ``last``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated[first:last].view(np.int8), [0]]))).tolist()
    return [(first + a, first + b - 1) for a, b in zip(edges[0::2], edges[1::2]) if words[first + a:first + b].sum() >= min_words]


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "clause", min_words: int = MIN_WORDS, inside: bool = False, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents, with all their columns, in their cut texts; ``cut_starts`` and ``cut_lengths`` (in characters) are added."""
    buckets = partitions(docs.sparkSession)
    dealt = bucketed(text_blocks(docs, key, text, block_bytes, rest=True), "line-blocks", "block")
    rank = F.transform("rest", lambda one: F.coalesce(one.getField(key).cast("long"), F.lit(-(2**63))))
    dealt = dealt.withColumn("ranks", rank)
    kind = dealt.schema["rest"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in ("ranks", "sizes", "nulls", "body", "met")}
                rest, nulls = batch.column("rest")[n].values, set(row["nulls"])
                texts, ranks = [one.decode() for one in texts_of(row["body"], row["sizes"])], np.array(row["ranks"], np.int64)
                units = Units(texts, unit)
                _, _, least, which = units.distinct(ranks)
                flags = [np.unpackbits(np.frombuffer(one["flags"], np.uint8))[:one["size"]] for one in row["met"] or []]
                smaller = np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)
                repeated = smaller[which] | (least[which] < ranks[units.document])
                repeated = repeated | units.again(which) if inside else repeated
                rows, size, begun = [], 0, 0
                for number, body in enumerate(texts):
                    cuts = stretches(repeated, units.words, units.first[number], units.first[number + 1], min_words)
                    spans = [(units.starts[a], units.stops[b]) for a, b in cuts]
                    # Empty units between two units of a stretch go with it.
                    kept = "".join(body[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(body)])) if spans else body
                    rows.append((None if number in nulls else kept, [a for a, _ in spans], [b - a for a, b in spans]))
                    size += len(kept)
                    if size > OUTPUT_BYTES or number == len(texts) - 1:
                        columns = zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)
                        yield pa.RecordBatch.from_arrays([rest.slice(begun, len(rows)), *(pa.array(c, t) for c, t in columns)], ["rest", "text", "starts", "lengths"])
                        rows, size, begun = [], 0, number + 1

    found = dealt.join(elsewhere(dealt, unit, buckets), "block", "left").select("rest", "ranks", "sizes", "nulls", "body", "met")
    cut = found.mapInArrow(run, f"rest {kind}, text string, starts array<int>, lengths array<int>")
    columns = [F.col("text").alias(text) if name == text else F.col(f"rest.`{name}`").alias(name) for name in docs.columns if name not in ADDED]
    return cut.select(*columns, F.col("starts").alias(ADDED[0]), F.col("lengths").alias(ADDED[1]))
