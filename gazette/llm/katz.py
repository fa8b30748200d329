"""Language model scores by Katz backoff.

N-grams are counted over the learning documents. A count of at most ``MAX_DISCOUNTED`` is discounted by Good-Turing; what a
history's discounts free goes to the words not seen after it, in proportion to the next lower order, by a backoff weight
that makes the history's probabilities sum to one. The model is tables by order: n-grams (history, word, their own number and count), and
histories (the sum of their counts, and their backoff weight). The score of a token is its discounted share
after its history, or else the history's weight times the score after the shorter history, and so on.

Documents are kept in blocks (see ``blocks``). Order by order, a block sends each of its distinct n-grams once, to be counted and
looked up, in packets of sorted and compressed numbers, one for each bucket; the answer comes back in the same order. Words are 64-bit
hashes when they are sent first, and numbers from then on, small ones for frequent words; an n-gram is the number of its history and
that of its last word. N-grams of frequent histories are dealt over several buckets by their last words, so no bucket holds one alone.

Counts of counts are taken as they are where all their Good-Turing factors are inside (0, 1). Groups of copies lift single ones
above that; such an order takes them from the log-linear fit of simple Good-Turing over all its counts.

Fallbacks, all exactly normalised: an order with fewer than ``MIN_FITTED`` different counts, or whose fitted line falls no faster
than 1/r, takes half a count off each count up to ``MAX_DISCOUNTED``; a history (or the unigram table) whose counts are all
undiscounted frees one count more.

Defined cases: a null text is the empty text, whose one token is the end; a token never learned shares the unigrams' freed
mass with all others like it; without learning documents every probability is one; repeated rows are counted and scored
each; a null id has a row like any other; columns other than key and text take no part, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.blocks import blocks, unpacked
from gazette.llm.common import bucketed, partitions, stage

MAX_DISCOUNTED = 5
MIN_FITTED = 3
END = np.uint64(0xC3A5C85C97CB3127)
STIR = np.uint64(0x9E3779B97F4A7C15)
#: Counts of a history in a bucket, at least, before its n-grams are dealt over more.
HOT_COUNT = 1 << 14
#: Buckets of packets for each partition of a shuffle: a bucket is one group in memory.
BUCKETS = 2
UNKNOWN, BEGIN = -1, 0
#: Places that are scored at once, and rows of a bucket's result that travel as one batch.
SCORED, MET_ROWS = 1 << 16, 1 << 16
RESULT = "key {kind}, n_tokens bigint, n_known bigint, base_score double, score double"


def word_splitter():
    """Function from a text to its words: split at ASCII white space, A-Z in lower case."""
    return lambda text: text.encode().lower().split()


def word_hashes(words: list[bytes]) -> list[int]:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64).tolist()


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, as many as the largest one needs."""
    numbers = np.ascontiguousarray(numbers).astype("<u8", copy=False)
    width = max((int(numbers.max(initial=0)).bit_length() + 7) // 8, 1)
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.ravel())


def numbers_of(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    cells = np.zeros((planes.shape[1], 8), np.uint8)
    cells[:, :data[0]] = planes.T
    return cells.view(np.uint64).ravel()


def increasing(numbers: np.ndarray) -> bytes:
    return packed(np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)))


def increasing_of(data: bytes) -> np.ndarray:
    return np.cumsum(numbers_of(data), dtype=np.uint64)


def floats(values: np.ndarray) -> bytes:
    return packed(np.ascontiguousarray(values, np.float64).view(np.uint64))


def floats_of(data: bytes) -> np.ndarray:
    return numbers_of(data).view(np.float64)


def hash_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def narrow(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers, none under that of an unknown word, in as few bytes as they need."""
    return numbers.astype(np.int32) if int(numbers.max(initial=0)) < (1 << 31) - 1 else numbers


def before_each(values: np.ndarray) -> np.ndarray:
    """What the place before has, an unknown word before the first."""
    return np.concatenate([np.array([UNKNOWN], values.dtype), values[:-1]])


def pair_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Order of pairs of whole numbers from 0 on; pairs that fit are sorted as one number."""
    bits = int(low.max(initial=0)).bit_length()
    if bits + int(high.max(initial=0)).bit_length() < 64:
        return np.argsort(high << bits | low)
    return np.lexsort((low, high))


def bucket_order(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Order of the buckets, what is in one as it was."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


def fitted_slope(of_counts: dict[int, int]) -> float | None:
    """Slope of simple Good-Turing's line through log r and log n_r, each n_r spread over the gap to its neighbours; None for too few."""
    r = np.array(sorted(c for c, number in of_counts.items() if number), float)
    if len(r) < MIN_FITTED:
        return None
    before, after = np.concatenate([[0.0], r[:-1]]), np.concatenate([r[1:], [2 * r[-1] - r[-2]]])
    spread = np.array([of_counts[int(c)] for c in r]) / ((after - before) / 2)
    return float(np.polyfit(np.log(r), np.log(spread), 1)[0])


def discounts(of_counts: dict[int, int]) -> list[float]:
    """Factors of the counts 1 to MAX_DISCOUNTED from the numbers of n-grams with each count."""
    return factors([of_counts.get(r, 0) for r in range(MAX_DISCOUNTED + 2)], fitted_slope(of_counts))


def factors(n: list[int], slope: float | None) -> list[float]:
    """The same from the numbers of the counts 0 to MAX_DISCOUNTED + 1 and the slope of the fitted line."""
    k = MAX_DISCOUNTED
    if all(n[1:]):
        common = (k + 1) * n[k + 1] / n[1]
        if common < 1:
            found = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
            if all(0 < one < 1 for one in found):
                return found
    if slope is not None and slope < -1:
        # With n_r on the line, (r + 1) n_(r+1) / (r n_r) is ((r + 1) / r) ** (slope + 1): every factor is inside (0, 1).
        common = (k + 1) ** (slope + 1)
        return [(((r + 1) / r) ** (slope + 1) - common) / (1 - common) for r in range(1, k + 1)]
    return [1 - 0.5 / r for r in range(1, k + 1)]


def profile(grams: DataFrame) -> tuple[list[int], float | None]:
    """Numbers of n-grams with the counts 0 to MAX_DISCOUNTED + 1, and the slope; only sums over the different counts leave Spark."""
    each = grams.groupBy("c").agg(F.count("*").alias("n"))
    around = Window.orderBy("c")
    before, after = F.coalesce(F.lag("c").over(around), F.lit(0)), F.lead("c").over(around)
    gap = F.coalesce(after, 2 * F.col("c") - before) - before
    each = each.withColumns({"gap": gap, "x": F.log("c")}).withColumn("y", F.log(F.col("n") / (F.col("gap") / 2)))
    sums = [F.sum(F.when(F.col("c") == r, F.col("n"))).alias(f"n{r}") for r in range(1, MAX_DISCOUNTED + 2)]
    row = each.agg(F.count("*").alias("k"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), *sums).first()
    slope = row.xy / row.xx if row.k >= MIN_FITTED else None
    return [0, *(row[f"n{r}"] or 0 for r in range(1, MAX_DISCOUNTED + 2))], slope


def discounted(c: np.ndarray, factors: list[float]) -> np.ndarray:
    table = np.array([1.0, *factors])
    return c * table[np.where(c <= len(factors), c, 0).astype(np.int64)]


def discounted_column(factors: list[float]) -> Column:
    value = F.col("c").cast("double")
    for r, factor in enumerate(factors, 1):
        value = F.when(F.col("c") == r, factor * r).otherwise(value)
    return value


class Model:
    """Scalars of the unigrams and the orders' factors travel with the tasks; ``grams`` and ``histories`` are tables by order."""

    def __init__(self, order: int):
        self.order, self.grams, self.histories = order, {}, {}
        self.tokens = self.types = self.documents = 0
        self.denominator, self.unknown = 1.0, 0.0
        self.factors: list[list[float]] = [[]]

    def scalars(self) -> "Model":
        found = Model(self.order)
        for name in ("tokens", "types", "documents", "denominator", "unknown", "factors"):
            setattr(found, name, getattr(self, name))
        return found

    @property
    def table(self) -> DataFrame:
        """All n-grams: ``n, history, word, number, c`` and the discounted count ``d``."""
        parts = [rows.select(F.lit(n).alias("n"), "history", "word", "number", "c", discounted_column(self.factors[n]).alias("d")) for n, rows in self.grams.items()]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        return whole


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one, as each may be large."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


class Block:
    """A block's places, each with the numbers, counts and shares of the n-grams that end there, as far as the answers say."""

    def __init__(self, row: dict, model: Model, buckets: int):
        self.model, self.buckets, self.keys = model, buckets, row["keys"]
        places, counts, pads = unpacked(row["places"]).astype(np.int64), unpacked(row["counts"]).astype(np.int64), max(model.order - 1, 1)
        self.words = np.append(np.array(row["words"], np.int64).view(np.uint64), END)
        owner = np.repeat(np.arange(len(counts)), counts)
        size = len(places) + len(counts) * (pads + 1)
        self.token, self.document = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        at = np.arange(len(places)) + owner * (pads + 1) + pads
        ends = np.cumsum(counts + pads + 1) - 1
        self.token[at], self.document[at] = places, owner
        self.token[ends], self.document[ends] = len(self.words) - 1, np.arange(len(counts))
        self.inside = self.document >= 0
        learn = np.array([one["learn"] for one in self.keys], bool)
        self.learned = self.inside & learn[self.document]
        self.number: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.total: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        for n in range(1, model.order + 1):
            if f"answer{n}" not in row or (n > 1 and f"back{n}" not in row):
                break
            self.take(n, row[f"answer{n}"] or [], row.get(f"back{n}") or [])

    def word_order(self) -> np.ndarray:
        """Local words as they are sent."""
        return np.argsort(self.words, kind="stable")

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.token[self.learned], minlength=len(self.words))

    def grams(self, n: int) -> tuple[np.ndarray, ...]:
        """Places whose n-gram may be known, which of the distinct n-grams each has, and these as they are sent: bucket, history, word, an own place."""
        before = before_each(self.number[n - 2])
        at = np.flatnonzero(self.inside & (before >= 0) & (self.number[0] > 0))
        history, word = before[at].astype(np.int64), self.number[0][at].astype(np.int64)
        order = pair_order(history, word)
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(history[order]) != 0) | (np.diff(word[order]) != 0)
        first, each = order[fresh], np.cumsum(fresh) - 1
        history, word, first = history[first], word[first], at[first]
        often = np.where(history == BEGIN, self.model.documents, before_each(self.count[n - 2])[first].astype(np.int64))
        salts = 1 + often // max(self.model.tokens // (4 * self.buckets), HOT_COUNT)
        sub = stirred(word.astype(np.uint64) * STIR) % salts.astype(np.uint64)
        bucket = (stirred(history.astype(np.uint64) * STIR + sub) % np.uint64(self.buckets)).astype(np.int64)
        sent = bucket_order(bucket, self.buckets)
        place, which = np.empty(len(sent), np.int64), np.empty(len(order), np.int64)
        place[sent] = np.arange(len(sent))
        which[order] = place[each]
        return at, which, bucket[sent], history[sent], word[sent], first[sent]

    def asked_histories(self, n: int) -> np.ndarray:
        """Distinct numbers of histories before the block's tokens, by bucket, as they are sent."""
        if n == 2:
            met = np.zeros(len(self.word_number), bool)
            met[self.token_before()[self.inside]] = True
            before = self.word_number[met]
        else:
            before = before_each(self.number[n - 2])[self.inside]
        found = np.unique(before[before >= 0])
        return found[bucket_order(found % self.buckets, self.buckets)]

    def token_before(self) -> np.ndarray:
        """Local word before each place, the last of ``word_number`` where a document begins."""
        return before_each(self.token)

    def take(self, n: int, answer: list[dict], back: list[dict]) -> None:
        """The answers to what was sent for an order: counts and numbers, and its histories' totals and weights."""
        counts = np.concatenate([numbers_of(one["counts"]) for one in answer] or [np.zeros(0, np.uint64)]).astype(np.int64)
        numbers = np.concatenate([numbers_of(one["numbers"]) for one in answer] or [np.zeros(0, np.uint64)]).astype(np.int64)
        number, count = np.full(len(self.token), UNKNOWN, np.int32), np.zeros(len(self.token), np.int32)
        # Unigrams have no histories.
        total, weight = (np.broadcast_to(value, len(self.token)) for value in (0.0, 1.0)) if n == 1 else (np.zeros(len(self.token)), np.ones(len(self.token)))
        counts, numbers = narrow(counts), narrow(numbers)
        if n == 1:
            own_number, own_count = np.empty(len(self.words), np.int64), np.empty(len(self.words), np.int64)
            number, count = number.astype(numbers.dtype, copy=False), count.astype(counts.dtype, copy=False)
            sent = self.word_order()
            own_number[sent], own_count[sent] = np.where(counts > 0, numbers, UNKNOWN), counts
            number[self.inside], count[self.inside] = own_number[self.token[self.inside]], own_count[self.token[self.inside]]
            self.word_number = np.append(own_number, BEGIN)
        else:
            number, count = number.astype(numbers.dtype, copy=False), count.astype(counts.dtype, copy=False)
            at, which, *_ = self.grams(n)
            count[at] = counts[which] if len(at) else 0
            if len(numbers):
                number[at] = np.where(counts[which] > 0, numbers[which], UNKNOWN)
            asked = self.asked_histories(n)
            place = np.argsort(asked, kind="stable")
            before = before_each(self.number[n - 2])
            known = self.inside & (before >= 0)
            if len(asked):
                if n == 2:
                    where = place[np.minimum(np.searchsorted(asked[place], self.word_number), len(asked) - 1)][self.token_before()[known]]
                else:
                    where = place[np.searchsorted(asked[place], before[known])]
                total[known] = np.concatenate([floats_of(one["totals"]) for one in back])[where]
                weight[known] = np.concatenate([floats_of(one["weights"]) for one in back])[where]
        number[~self.inside] = BEGIN
        self.number.append(number)
        self.count.append(count)
        self.total.append(total)
        self.weight.append(weight)

    def share(self, n: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Discounted shares of the n-grams that end at places."""
        value = discounted(self.count[n - 1][at], self.model.factors[n])
        if n == 1:
            return value / self.model.denominator
        total = self.total[n - 1][at]
        return np.where(total > 0, value / np.where(total > 0, total, 1), 0)

    def scores(self) -> np.ndarray:
        """log10 probability of every place: the longest known n-gram's share, or the weight times the shorter one's."""
        if not self.model.tokens:
            return np.zeros(len(self.token))
        score = np.empty(len(self.token))
        for low in range(0, len(score), SCORED):
            at = slice(low, low + SCORED)
            share = self.share(1, at)
            part = np.log10(np.where(share > 0, share, max(self.model.unknown, 1e-300)))
            for n in range(2, self.model.order + 1):
                shorter, share = part + np.log10(np.where(self.total[n - 1][at] > 0, np.maximum(self.weight[n - 1][at], 1e-300), 1.0)), self.share(n, at)
                part = np.where(share > 0, np.log10(np.where(share > 0, share, 1)), shorter)
            score[at] = part
        return score


SENT = "bucket int, block bigint, history binary, word binary, counts binary, lower binary"
MET = "kind string, block bigint, bucket int, numbers binary, counts binary, history bigint, word bigint, number bigint, c bigint, lower double, " + ", ".join(f"n{r} bigint" for r in range(1, MAX_DISCOUNTED + 1))
MET_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def met_table(rows: int, **columns) -> pa.Table:
    """Rows of the buckets' result; what is not given is null."""
    fields = [one.split() for one in MET.split(", ")]
    given = {name: columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], MET_TYPES[kind]) for name, kind in fields if name in columns}
    empty = {kind: pa.nulls(min(rows, MET_ROWS), MET_TYPES[kind]) for kind in MET_TYPES}
    parts = [(low, min(MET_ROWS, rows - low)) for low in range(0, max(rows, 1), MET_ROWS)]
    return pa.table({name: pa.chunked_array([given[name].slice(*part) if name in given else empty[kind].slice(0, part[1]) for part in parts], MET_TYPES[kind]) for name, kind in fields})


def sent_rows(row: dict, bucket: np.ndarray, *columns: tuple[np.ndarray, object]) -> Iterator[pa.RecordBatch]:
    """A packet for each bucket; rows are in order of the buckets."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist() if len(bucket) else []
    for low, high in zip(cuts, cuts[1:]):
        values = [int(bucket[low]), row["block"], *(None if values is None else code(values[low:high]) for values, code in columns)]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["bucket", "block", "history", "word", "counts", "lower"])


def met_words(table: pa.Table, buckets: int) -> pa.Table:
    """Words of a bucket: numbers by falling count, and the answers to the blocks."""
    parts = [increasing_of(one) for one in table.column("word").to_pylist()]
    hashes, each = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.zeros(len(hashes), np.int64)
    np.add.at(counts, each.ravel(), np.concatenate([numbers_of(one) for one in table.column("counts").to_pylist()]).astype(np.int64))
    bucket = table.column("bucket")[0].as_py()
    number = np.zeros(len(hashes), np.int64)
    falling = np.lexsort((hashes, -counts))
    falling = falling[counts[falling] > 0]
    number[falling] = np.arange(len(falling)) * buckets + bucket + 1
    return pa.concat_tables([
        answers(table, each.ravel(), [len(part) for part in parts], number, counts),
        met_table(len(falling), kind=pa.repeat("gram", len(falling)), history=np.full(len(falling), BEGIN), word=hashes[falling].view(np.int64), number=number[falling], c=counts[falling]),
    ])


def answers(table: pa.Table, each: np.ndarray, sizes: list[int], number: np.ndarray | None, counts: np.ndarray) -> pa.Table:
    parts = np.split(each, np.cumsum(sizes)[:-1])
    numbers = [b"\x01" + zstandard.ZstdCompressor().compress(b"") if number is None else packed(number[part]) for part in parts]
    return met_table(len(parts), kind=["answer"] * len(parts), block=table.column("block").to_pylist(), bucket=table.column("bucket").to_pylist(), numbers=numbers, counts=[packed(counts[part]) for part in parts])


def met_grams(table: pa.Table, buckets: int, last: bool, unigrams: Model | None = None) -> pa.Table:
    """N-grams of a bucket: counts and numbers, sums by history, and the answers to the blocks.

    Of the last words' lower shares, those of ``unigrams`` come as the words' counts.
    """
    parts = [increasing_of(one) for one in table.column("history").to_pylist()]
    history = np.concatenate(parts).astype(np.int64)
    word, own = (np.concatenate([numbers_of(one) for one in table.column(name).to_pylist()]).astype(np.int64) for name in ("word", "counts"))
    lower = table.column("lower").to_pylist()
    if unigrams:
        lower = discounted(np.concatenate([numbers_of(one) for one in lower]).astype(np.int64), unigrams.factors[1]) / unigrams.denominator
    else:
        lower = np.concatenate([floats_of(one) for one in lower])
    order = pair_order(history, word)
    fresh = np.concatenate([[True], (np.diff(history[order]) != 0) | (np.diff(word[order]) != 0)])
    starts, each = np.flatnonzero(fresh), np.empty(len(order), np.int64)
    each[order] = np.cumsum(fresh) - 1
    counts, lower = np.add.reduceat(own[order], starts), np.maximum.reduceat(lower[order], starts)
    history, word, known = history[order][starts], word[order][starts], counts > 0
    number = np.zeros(len(counts), np.int64)
    number[known] = np.arange(int(known.sum())) * buckets + table.column("bucket")[0].as_py() + 1
    found = [answers(table, each, [len(part) for part in parts], None if last else number, counts)]
    history, word, counts, lower, number = (x[known] for x in (history, word, counts, lower, number))
    if len(history):
        numbered = {} if last else {"number": number}
        found.append(met_table(len(history), kind=pa.repeat("gram", len(history)), history=history, word=word, c=counts, **numbered))
        firsts = np.flatnonzero(np.concatenate([[True], np.diff(history) != 0]))
        sums = {f"n{r}": np.add.reduceat((counts == r).astype(np.int64), firsts) for r in range(1, MAX_DISCOUNTED + 1)}
        found.append(met_table(len(firsts), kind=pa.repeat("history", len(firsts)), history=history[firsts], c=np.add.reduceat(counts, firsts), lower=np.add.reduceat(lower, firsts), **sums))
    return pa.concat_tables(found)


def by_block(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", *columns))).alias(name))


def freed(total: Column, kept: Column) -> Column:
    """Denominator of a history: its counts, and one more if nothing is discounted."""
    return F.when(total - kept > total * 1e-12, total).otherwise(total + 1)


def trained(dealt: DataFrame, order: int) -> tuple[Model, DataFrame]:
    """The model, and the blocks with the answers to all they asked."""
    buckets, model = BUCKETS * partitions(dealt.sparkSession), Model(order)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row, Model(order), buckets)
                sent = block.word_order()
                hashes = block.words[sent]
                yield from sent_rows(row, hash_buckets(hashes, buckets), (None, None), (hashes, increasing), (block.word_counts()[sent], packed), (None, None))

    met = stage(dealt.mapInArrow(send_words, SENT).groupBy("bucket").applyInArrow(lambda table: met_words(table, buckets), MET), "katz-words", "kind")
    model.grams[1] = met.where("kind = 'gram'")
    model.factors.append(factors(*profile(model.grams[1])))
    whole = model.grams[1].agg(F.sum("c").alias("tokens"), F.count("*").alias("types"), F.sum(discounted_column(model.factors[1])).alias("kept")).first()
    end = model.grams[1].where(F.col("word") == int(END.astype(np.int64))).agg(F.max("c").alias("c")).first()
    model.tokens, model.types, model.documents, kept = whole.tokens or 0, whole.types, end.c or 0, whole.kept or 0.0
    model.denominator = float(model.tokens if model.tokens - kept > model.tokens * 1e-12 else model.tokens + 1)
    model.unknown = 1 - kept / model.denominator
    whole = dealt.join(by_block(met.where("kind = 'answer'"), "answer1", "numbers", "counts"), "block", "left")
    for n in range(2, order + 1):
        whole = with_order(whole, model, n, buckets)
    return model, whole


def with_order(whole: DataFrame, model: Model, n: int, buckets: int) -> DataFrame:
    """The blocks with the answers of order n; its tables are added to the model."""
    scalars, last = model.scalars(), n == model.order
    unigrams = scalars if n == 2 else None

    def send_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block = Block(row, scalars, buckets)
                at, which, bucket, history, word, own = block.grams(n)
                counts = np.bincount(which[block.learned[at]], minlength=len(history))
                lower = (block.count[0][own], packed) if n == 2 else (block.share(n - 1, own), floats)
                yield from sent_rows(row, bucket, (history, increasing), (word, packed), (counts, packed), (np.where(counts > 0, lower[0], 0), lower[1]))

    met = stage(whole.mapInArrow(send_grams, SENT).groupBy("bucket").applyInArrow(lambda table: met_grams(table, buckets, last, unigrams), MET), "katz-grams", "kind")
    model.grams[n] = met.where("kind = 'gram'")
    model.factors.append(factors(*profile(model.grams[n])))
    # Discounts take r (1 - factor) off each n-gram of count r.
    lost = sum((F.sum(f"n{r}") * (r * (1 - factor)) for r, factor in enumerate(model.factors[n], 1)), F.lit(0.0))
    sums = met.where("kind = 'history'").groupBy("history").agg(F.sum("c").cast("double").alias("seen"), lost.alias("lost"), F.sum("lower").alias("lower"))
    sums = sums.withColumn("total", freed(F.col("seen"), F.col("seen") - F.col("lost")))
    weight = (1 - (F.col("seen") - F.col("lost")) / F.col("total")) / F.greatest(1 - F.col("lower"), F.lit(1e-12))
    model.histories[n] = stage(sums.select("history", "total", weight.alias("weight"), F.pmod("history", F.lit(buckets)).cast("int").alias("bucket")), "katz-histories")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                asked = Block(row, scalars, buckets).asked_histories(n)
                yield from sent_rows(row, asked % buckets, (asked, increasing), (None, None), (None, None), (None, None))

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        history = known.column("history").to_numpy()
        order = np.argsort(history)
        values = [np.append(known.column(name).to_numpy()[order], empty) for name, empty in (("total", 0.0), ("weight", 1.0))]
        history, rows = history[order], [increasing_of(one).astype(np.int64) for one in asked.column("history").to_pylist()]
        found = []
        for part in rows:
            at = np.searchsorted(history, part)
            hit = np.append(history, -1)[at] == part
            found.append([floats(own[np.where(hit, at, len(history))]) for own in values])
        return pa.table({
            "block": asked.column("block"), "bucket": asked.column("bucket"),
            "totals": pa.array([one[0] for one in found], pa.binary()), "weights": pa.array([one[1] for one in found], pa.binary()),
        })

    asked = whole.mapInArrow(ask, SENT).select("bucket", "block", "history")
    back = asked.groupBy("bucket").cogroup(model.histories[n].groupBy("bucket")).applyInArrow(look_up, "block bigint, bucket int, totals binary, weights binary")
    answered = whole.join(by_block(met.where("kind = 'answer'"), f"answer{n}", "numbers", "counts"), "block", "left")
    return answered.join(stage(by_block(back, f"back{n}", "totals", "weights"), "katz-back"), "block", "left")


def score(docs: DataFrame, learn: Column, order: int = 2, key: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> tuple[DataFrame, Model]:
    """Score all documents by a model of those where ``learn`` holds: key, n_tokens, n_known, base_score, score; and the model."""
    rows = docs.select(F.struct(F.col(key).alias("key"), F.coalesce(learn, F.lit(False)).alias("learn")).alias("key"), F.col(text).alias("text"))
    dealt = bucketed(blocks(rows, word_splitter, "bigint", word_hashes, "key", "text", block_bytes), "katz-blocks", "block")
    buckets = BUCKETS * partitions(dealt.sparkSession)
    model, whole = trained(dealt, order)
    scalars, kind = model.scalars(), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = batch.schema.field("keys").type.value_type.field("key").type
            for row in rows_of(batch):
                block, n = Block(row, scalars, buckets), len(row["keys"])
                at = np.flatnonzero(block.inside)
                owner, c, each = block.document[at], block.count[0][at].astype(np.int64), block.scores()
                base = np.log10((c + 1) / (scalars.tokens + scalars.types + 1))
                columns = [
                    pa.array([one["key"] for one in row["keys"]], arrow), pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner, c > 0, n).astype(np.int64)),
                    pa.array(np.bincount(owner, base, n)), pa.array(np.bincount(owner, each[at], n)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "n_known", "base_score", "score"])

    return whole.mapInArrow(run, RESULT.format(kind=kind)).withColumnRenamed("key", key), model
