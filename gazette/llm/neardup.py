"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its word shingles. Documents with one set are one class. Each class has minwise tokens; a tree
deals classes to nodes by the values of tokens that the node chooses, and branches again where a node is too large:
every node offers its members with two of them as centres, small nodes compare all their members, and of the large nodes
whose members are not yet in one component those with few pairs across components compare these, and the others branch on
``fanout`` further tokens. Independent trees repeat this, so that a pair at the
threshold misses all its meetings with probability (1 - s)**trees, s >= 1 - (1 - threshold * s)**fanout.

Candidates pass bounds that no pair at the threshold fails, the dearer ones later: sizes and 512 parities of bucket counts as
members meet, then the bucket counts themselves, folded to the smaller set's width: first a bucket for about eight shingles, so that little
travels with a pair, then one for about two. Pairs inside one component are dropped, one pair of each class is confirmed before the others,
and full sets, which decide, are made for what is left alone. Nothing but the trees can miss a link.

Nodes that stay large at the last level are compared exhaustively across components, in as many slices as their size asks for, so
nothing is dropped; the largest component of a node is never compared with itself.

Defined cases: a document without words, or a null text, has an empty set, is linked with nothing and is its own component;
fewer words than a shingle are one shingle; rows are judged each by its text, also those that share an id; rows with a null id
have a result, and their component the smallest other id, or null where there is none; columns other than key and text take no
part, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.blocks import text_blocks, texts_of
from gazette.llm.common import bucketed, bucketed_and_plain, stage
from gazette.llm.components import components
from gazette.operators.dedup import first_writer

TOKENS = 64
SKETCH = [f"x{i}" for i in range(8)]
SIGNATURE = "block bigint, number int, doc_id bigint, text_key binary, n_shingles bigint, set_key binary, tokens binary, coarse binary, counts binary, " + ", ".join(f"{name} bigint" for name in SKETCH)
MAX_WORDS_KEPT = 400_000
OUTPUT_BYTES = 4 << 20
SLICE_ROWS = 1024

_random = np.random.default_rng(20240229)
FACTORS = _random.integers(1, 2**63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 2**63, TOKENS, np.uint64)
STIR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS_KEPT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; words are split at ASCII white space, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    count = max(len(each) - k + 1, 1)
    rolled = np.full(count, len(words) if len(words) < k else k, np.uint64)
    for j in range(min(k, len(each))):
        rolled = stirred(rolled * STIR + each[j:j + count])
    return np.unique(rolled)


def signature(shingles: np.ndarray) -> tuple[bytes, list[int]]:
    """Minwise tokens, and the sketch: parities of the counts of shingles by hash bucket."""
    if not len(shingles):
        return b"", [0] * len(SKETCH)
    least = np.empty(TOKENS, np.uint64)
    for at in range(0, TOKENS, 16):
        least[at:at + 16] = (shingles * FACTORS[at:at + 16, None] + OFFSETS[at:at + 16, None]).min(axis=1)
    least = stirred(least)
    cells = 64 * len(SKETCH)
    buckets = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % cells, minlength=cells)
    sketch = np.packbits((buckets & 1).astype(np.uint8), bitorder="little").view(np.int64)
    return (least >> np.uint64(32)).astype(np.uint32).tobytes(), sketch.tolist()


def bucket_counts(shingles: np.ndarray, each: int = 2) -> bytes:
    """Numbers of shingles by the high bits of their hashes, a bucket for about ``each`` shingles, compressed; empty if one is over a byte."""
    bits = max((len(shingles) // each).bit_length(), 6)
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint8).tobytes()) if counts.max() < 256 else b""


def may_be_alike(left: bytes, right: bytes, size: int, percent: int) -> bool:
    """Bucket counts differ by no more than the sets do, at any width; ``size`` is that of both sets together."""
    if not left or not right:
        return True
    x, y = (np.frombuffer(zstandard.ZstdDecompressor().decompress(one), np.uint8).astype(np.int64) for one in (left, right))
    width = min(len(x), len(y))
    apart = int(np.abs(x.reshape(width, -1).sum(1) - y.reshape(width, -1).sum(1)).sum())
    return apart * (100 + percent) <= size * (100 - percent)


def signatures(dealt: DataFrame, ids: Column, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        names = [one.split()[0] for one in SIGNATURE.split(", ")]
        kinds = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[one.split()[1]] for one in SIGNATURE.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                for number, (one, text) in enumerate(zip(row["ids"], texts_of(row["body"], row["sizes"]), strict=True)):
                    shingles = shingle_set(text, k, hashes)
                    tokens, sketch = signature(shingles)
                    coarse, counts = (bucket_counts(shingles, 8), bucket_counts(shingles)) if len(shingles) else (b"", b"")
                    rows.append((row["block"], number, one, md5(text).digest(), len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), tokens, coarse, counts, *sketch))
                    size += len(counts) + len(coarse) + 400
                    if size > OUTPUT_BYTES or number == len(row["ids"]) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0

    return dealt.select("block", ids.alias("ids"), "sizes", "body").mapInArrow(run, SIGNATURE)


FIELDS = ["class", "n_shingles", *SKETCH]
MEMBER = ["node", *FIELDS]


def side(rows: DataFrame, name: str, *more: str | Column, of: str = "") -> DataFrame:
    """The fields of members, or of a struct of them, with a side's name after them."""
    return rows.select(*more, F.col(f"{of}class").alias(name), *[F.col(f"{of}{c}").alias(f"{c}_{name}") for c in FIELDS[1:]])


def alike(percent: int) -> Column:
    """Whether sizes and sketches of sides a and b allow the similarity.

    Bucket parities differ in no more places than the sets differ in shingles, so that bound loses nothing.
    """
    a, b = F.col("n_shingles_a"), F.col("n_shingles_b")
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH), F.lit(0))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (apart * (100 + percent) <= (a + b) * (100 - percent))


def first_nodes(classes: DataFrame, trees: int, fanout: int) -> DataFrame:
    """Members of each tree's first nodes: the root chooses tokens that no other tree's root has."""
    chosen = classes.withColumn("place", F.explode(F.array(*map(F.lit, range(min(trees * fanout, TOKENS))))))
    return chosen.withColumn("node", F.xxhash64("place", F.substring(F.col("tokens"), F.col("place") * 4 + 1, F.lit(4)))).select(MEMBER)


def branched(members: DataFrame, classes: DataFrame, fanout: int) -> DataFrame:
    """Members of the children of nodes: a node chooses ``fanout`` tokens, members go by their values."""
    turns = members.join(classes.select("class", "tokens"), "class").withColumn("turn", F.explode(F.array(*map(F.lit, range(fanout)))))
    place = F.pmod(F.xxhash64("node", "turn"), F.lit(TOKENS)).cast("int")
    return turns.withColumn("node", F.xxhash64("node", "turn", F.substring(F.col("tokens"), place * 4 + 1, F.lit(4)))).select(MEMBER)


def met(members: DataFrame, node_rows: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of the nodes, and the members of nodes of more than ``node_rows``.

    Every node offers its members with its smallest member and with one hashed member; small nodes offer all pairs.
    """
    sizes = members.groupBy("node").agg(F.count("*").alias("rows"), F.min("class").alias("smallest"), F.min_by("class", F.xxhash64(F.lit(1), "class")).alias("hashed")).where("rows > 1")
    # Small nodes are compared where they were written; rows of a large one, which may be hot, are left to the planner to deal.
    inside, plain = bucketed_and_plain(members.join(sizes, "node").select(*MEMBER, "rows", "smallest", "hashed"), "near-members", "node")
    large = plain.where(F.col("rows") > node_rows)
    centres = side(large.where("class = smallest OR class = hashed"), "b", "node")
    stars = side(large, "a", "node").join(centres, "node").where(F.col("a") != F.col("b")).where(alike(percent))
    few = inside.where(F.col("rows") <= node_rows)
    pairs = side(few, "a", "node").join(side(few, "b", "node"), "node").where("a < b").where(alike(percent))
    return stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(pairs.select("a", "b")).distinct(), large.select(MEMBER)


def undecided(large: DataFrame, found: DataFrame, classes: DataFrame, node_pairs: int) -> DataFrame:
    """Members, with their component, of nodes whose members are in several components, and whether such a node is ``thin``.

    A thin node has at most ``node_pairs`` pairs across its components for each of its members. Members travel by
    node and class alone; those that stay take their fields from the classes.
    """
    marked = large.select("node", "class").join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    parts = marked.groupBy("node", "component").agg(F.count("*").alias("rows"))
    rows = F.sum("rows").cast("double")
    sizes = parts.groupBy("node").agg(F.count("*").alias("parts"), ((rows * rows - F.sum(F.col("rows").cast("double") * F.col("rows"))) / 2 <= rows * node_pairs).alias("thin"))
    return marked.join(sizes.where("parts > 1").select("node", "thin"), "node").join(classes.select(*FIELDS), "class").select(*MEMBER, "component", "thin")


def across(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs between the components of a node.

    One side of such a pair is outside the node's largest component: only those members are repeated, for each slice of about
    ``SLICE_ROWS`` members, so the rows follow the pairs to be compared and not the square of the node.
    """
    parts = members.groupBy("node", "component").agg(F.count("*").alias("rows"))
    sizes = parts.groupBy("node").agg(F.ceil(F.sum("rows") / SLICE_ROWS).alias("slices"), F.max(F.struct("rows", "component")).alias("largest"))
    dealt = members.join(sizes.select("node", "slices", F.col("largest.component").alias("largest")), "node")
    outside = F.col("component") != F.col("largest")
    left = side(dealt, "a", "node", "component", outside.alias("outside"), F.pmod(F.xxhash64("class"), F.col("slices")).alias("slice"))
    right = side(dealt.where(outside), "b", "node", F.col("component").alias("other"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    pairs = left.join(right, ["node", "slice"]).where("component <> other AND (a < b OR NOT outside)").where(alike(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def full_sets(keys: DataFrame, dealt: DataFrame, k: int) -> DataFrame:
    """Full sets, ``class`` and ``items``, of classes by block and number of one of their documents; texts stay where they are."""
    wanted = keys.groupBy("block").agg(F.collect_list(F.struct("class", "number")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for row in batch.to_pylist():
                texts, rows, size = texts_of(row["body"], row["sizes"]), [], 0
                for n, one in enumerate(row["wanted"], 1):
                    rows.append((one["class"], shingle_set(texts[one["number"]], k, hashes).view(np.int64)))
                    size += rows[-1][1].nbytes
                    if size > OUTPUT_BYTES or n == len(row["wanted"]):
                        ends = pa.array(np.cumsum([0, *(len(own) for _, own in rows)]), pa.int32())
                        items = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([own for _, own in rows])))
                        yield pa.RecordBatch.from_arrays([pa.array([own for own, _ in rows], pa.int64()), items], ["class", "items"])
                        rows, size = [], 0

    return dealt.join(wanted, "block").select("sizes", "body", "wanted").mapInArrow(run, "class bigint, items array<bigint>")


def confirmed(pairs: DataFrame, classes: DataFrame, dealt: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets have the similarity. Sets are made once per class that is in a pair; the JVM intersects them row by row."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = stage(full_sets(classes.join(keys, "class").select("class", "block", "number"), dealt, k), "near-sets")
    joined = pairs.join(sets.toDF("a", "items_a"), "a").join(sets.toDF("b", "items_b"), "b")
    both = F.size(F.array_intersect("items_a", "items_b"))
    return joined.where(both * 100 >= (F.size("items_a") + F.size("items_b") - both) * percent).select("a", "b")


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose classes are not in one component yet."""
    marked = pairs.join(found.toDF("a", "component_a"), "a", "left").join(found.toDF("b", "component_b"), "b", "left")
    return marked.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")


def joined_up(news: DataFrame, found: DataFrame) -> DataFrame:
    """Components after further links: those of the graph whose nodes are the components so far."""
    marked = news.join(found.toDF("a", "component_a"), "a", "left").join(found.toDF("b", "component_b"), "b", "left")
    moved = stage(components(marked.select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))), "near-moved")
    old = found.join(moved.withColumnRenamed("component", "new"), F.col("component") == F.col("node"), "left")
    fresh = moved.join(found, moved["node"] == found["class"], "left_anti")
    return stage(old.select("class", F.coalesce("new", "component").alias("component")).union(fresh.select("node", "component")), "near-components")


def grown(pairs: DataFrame, found: DataFrame, classes: DataFrame, dealt: DataFrame, k: int, percent: int, firsts: bool) -> DataFrame:
    """Components with the links among candidate pairs: with ``firsts`` one pair of each class is confirmed before what then still lies between components."""

    @F.pandas_udf("boolean")
    def may(left: pd.Series, right: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([may_be_alike(*one, percent) for one in zip(left, right, size, strict=True)], dtype=bool)

    left = apart(pairs, found)
    for name in ("coarse", "counts"):
        counts = classes.select("class", name, "n_shingles")
        rows = left.join(counts.toDF("a", "counts_a", "size_a"), "a").join(counts.toDF("b", "counts_b", "size_b"), "b")
        left = stage(rows.where(may("counts_a", "counts_b", F.col("size_a") + F.col("size_b"))).select("a", "b"), f"near-{name}")
    for some in (left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), None) if firsts else (None,):
        some = stage(apart(left, found) if some is None else some, "near-some")
        if some.head(1):
            news = stage(confirmed(some, classes, dealt, k, percent), "near-links")
            found = joined_up(news, found) if news.head(1) else found
    return found


def placed(dealt: DataFrame, ids: Column, fields: list[str], k: int, percent: int, trees: int, fanout: int, node_rows: int, node_pairs: int, levels: int) -> DataFrame:
    """Every document's ``fields`` of its signature and its component, a number; null for an empty set."""
    signed = stage(signatures(dealt, ids, k), "near-signatures")
    alone = signed.where("n_shingles > 0").groupBy("set_key").agg(
        F.min(F.struct("block", "number")).alias("one"), *[F.first(c).alias(c) for c in ("n_shingles", "tokens", "coarse", "counts", *SKETCH)],
    )
    classes = stage(alone.select(F.monotonically_increasing_id().alias("class"), "one.*", "set_key", "n_shingles", "tokens", "coarse", "counts", *SKETCH), "near-classes")
    found = dealt.sparkSession.createDataFrame([], "class bigint, component bigint")
    pairs, large = met(first_nodes(classes, trees, fanout), node_rows, percent)
    found = grown(pairs, found, classes, dealt, k, percent, True)
    for level in range(levels):
        open_nodes = stage(undecided(large, found, classes, node_pairs), "near-open")
        if not open_nodes.head(1):
            break
        last = level == levels - 1
        pairs = across(open_nodes if last else open_nodes.where("thin"), percent)
        if not last:
            more, large = met(branched(open_nodes.where("NOT thin").select(MEMBER), classes, fanout), node_rows, percent)
            pairs = pairs.union(more).distinct()
        found = grown(pairs, found, classes, dealt, k, percent, False)
    member = signed.select(*fields, "set_key").join(classes.select("set_key", "class"), "set_key", "left")
    return member.join(found, "class", "left").select(*fields, F.coalesce("component", "class").alias("component"))


def documents_of(found: DataFrame, columns: list[str], text: str, listed: bool) -> DataFrame:
    """Documents of blocks, with all their columns, block and number: those in the block's list ``numbers``, or those that are not."""
    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("number", T.IntegerType()), T.StructField("rest", found.schema["rest"].dataType.elementType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in ("block", "sizes", "nulls", "body", "numbers")}
                rest, nulls, named = batch.column("rest")[n].values, set(row["nulls"]), set(row["numbers"] or [])
                chosen = [number for number in range(len(row["sizes"])) if (number in named) == listed]
                texts, own, size = texts_of(row["body"], row["sizes"]) if chosen else [], [], 0
                for number in chosen:
                    own.append(number)
                    size += len(texts[number])
                    if size > OUTPUT_BYTES or number == chosen[-1]:
                        bodies = pa.array([None if one in nulls else texts[one].decode() for one in own], pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(own), pa.int64()), pa.array(own, pa.int32()), rest.take(pa.array(own)), bodies], ["block", "number", "rest", "text"])
                        own, size = [], 0

    opened = found.select("block", "rest", "sizes", "nulls", "body", "numbers").mapInArrow(run, kind)
    return opened.select(F.struct(*[F.col("text").alias(name) if name == text else F.col(f"rest.`{name}`").alias(name) for name in columns]).alias("row"), "block", "number")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, trees: int = 4, fanout: int = 2, node_rows: int = 24, node_pairs: int = 1500, levels: int = 6) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest id reachable through links), kept (whether that id is its own)."""
    dealt = bucketed(text_blocks(docs, key, text), "near-texts", "block")
    ids = F.transform("keys", lambda one: one.cast("long"))
    rows = stage(placed(dealt, ids, ["doc_id", "n_shingles"], k, percent, trees, fanout, node_rows, node_pairs, levels), "near-placed")
    least = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = rows.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, trees: int = 4, fanout: int = 2, node_rows: int = 24, node_pairs: int = 1500, levels: int = 6) -> DataFrame:
    """The documents, with all their columns, of which one of each group stays: that of the smallest id, a null id last.

    The decision is one about id and text, so rows that share an id go or stay each by its own text; of rows equal in both one stays.
    Documents without words stay all. Texts stay in their blocks, which are told the numbers of the documents that go.
    """
    dealt = bucketed(text_blocks(docs, key, text, rest=True), "near-texts", "block")
    ids = F.transform("rest", lambda one: one.getField(key).cast("long"))
    fields = ["doc_id", "text_key", "block", "number"]
    rows = stage(placed(dealt, ids, fields, k, percent, trees, fanout, node_rows, node_pairs, levels), "near-placed").where("component IS NOT NULL")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    keepers = rows.groupBy("component").agg(F.min(own).alias("keeper"), F.count("*").alias("rows")).where("rows > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_key") == F.col("keeper.text_key"))
    judged = stage(rows.join(keepers, "component").select("component", "block", "number", stays.alias("stays")), "near-judged")
    gone, stay = judged.where("NOT stays").select("block", "number"), judged.where("stays")
    repeated = stay.join(stay.groupBy("component").agg(F.count("*").alias("copies")).where("copies > 1"), "component", "left_semi")
    if repeated.head(1):
        named = repeated.groupBy("block").agg(F.collect_list("number").alias("numbers"))
        copies = documents_of(dealt.join(named, "block"), docs.columns, text, True).join(repeated.select("component", "block", "number"), ["block", "number"])
        one = first_writer(copies.select("component", F.xxhash64(F.to_json("row")).alias("order"), "block", "number"), "component", ["order", "block", "number"])
        gone = gone.union(repeated.select("block", "number").join(one.select("block", "number"), ["block", "number"], "left_anti"))
    numbers = gone.groupBy("block").agg(F.collect_list("number").alias("numbers"))
    return documents_of(dealt.join(numbers, "block", "left"), docs.columns, text, False).select("row.*")
