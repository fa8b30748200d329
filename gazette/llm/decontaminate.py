"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Texts are words; a window is ``n`` consecutive words. The hash of every k-gram is taken, and of each window the smallest of
its k-gram hashes is its fingerprint. Neighbouring windows mostly share one, so a text keeps one row per run of windows with
one fingerprint. A window that occurs in both texts has the same fingerprint in both, so every shared span of ``n`` words
is found by the join; hits are then extended: each start in the run is compared with the benchmark window word by word.

An item shorter than ``n`` words is one window of its own length, and texts are winnowed for each length that items have.

Defined cases: a null or empty text has no words and is never hit; an item without words has no window; items with the same
text are items of their own, with windows in common; rows with one id and one text are judged once and have a result row
each; ids may be null; columns other than key and text take no part; no items leave every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import ascii_lower, small, stage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN = "array<struct<fingerprint:bigint,first:int,last:int>>"

#: Frames of more rows than these are joined by shuffle instead of being broadcast.
MAX_BROADCAST_WINDOWS = 200_000
MAX_BROADCAST_KEYS = 1_000_000


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda word: word != "")


def minima(frame: DataFrame, n: int, k: int = 5) -> DataFrame:
    """Add ``minima``: for each window of ``n`` of the ``hashes``, the smallest hash of its k-grams."""
    k = min(k, n)
    grams = F.transform(F.sequence(F.lit(0), F.size("hashes") - k), lambda i: F.xxhash64(F.lit(n), *[F.get("hashes", i + j) for j in range(k)]))
    frame = frame.withColumn("grams", F.when(F.size("hashes") >= n, grams).otherwise(F.array().cast("array<bigint>")))
    span = n - k + 1
    if span == 1:
        return frame.withColumnRenamed("grams", "minima")
    least = F.transform(F.sequence(F.lit(0), F.size("grams") - span), lambda i: F.least(*[F.get("grams", i + j) for j in range(span)]))
    return frame.withColumn("minima", F.when(F.size("grams") >= span, least).otherwise(F.array().cast("array<bigint>"))).drop("grams")


def runs(frame: DataFrame, n: int) -> DataFrame:
    """Add ``runs``: fingerprint, first and last window start of each run of windows that share their smallest hash."""
    frame = minima(frame, n)
    starts = F.filter(F.sequence(F.lit(0), F.size("minima") - 1), lambda i: (i == 0) | (F.get("minima", i) != F.get("minima", i - 1)))
    frame = frame.withColumn("starts", F.when(F.size("minima") > 0, starts).otherwise(F.array().cast("array<int>")))
    found = F.transform("starts", lambda at, j: F.struct(F.get("minima", at).alias("fingerprint"), at.alias("first"), (F.coalesce(F.get("starts", j + 1), F.size("minima")) - 1).alias("last")))
    return frame.withColumn("runs", found.cast(RUN)).drop("minima", "starts")


def benchmark_windows(items: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """Item, window length, window text and fingerprint of every window of every item."""
    rows = items.select(F.col(key).alias("item_id"), words(F.col(text)).alias("words")).withColumn("n", F.least(F.size("words"), F.lit(n))).where("n > 0")
    rows = stage(rows.withColumn("hashes", F.transform("words", lambda word: F.xxhash64(word))), "benchmark-words")
    lengths = sorted(row.n for row in rows.select("n").distinct().collect())
    parts = []
    for length in lengths:
        own = minima(rows.where(F.col("n") == length), length)
        each = F.transform("minima", lambda least, i: F.struct(least.alias("fingerprint"), F.array_join(F.slice("words", i + 1, length), " ").alias("window")))
        parts.append(own.select("item_id", "n", F.explode(each).alias("one")).select("item_id", "n", "one.*"))
    if not parts:
        return rows.select("item_id", "n", F.lit(0).cast("bigint").alias("fingerprint"), F.lit("").alias("window"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Id, text and a hash of both."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("doc_key", F.xxhash64("doc_id", "text"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: doc_id, doc_key, n_words, hits (start, length and window of each occurrence), item_ids (sorted)."""
    windows = stage(benchmark_windows(items, n, item_key, item_text), "benchmark-windows")
    lengths = sorted(row.n for row in windows.select("n").distinct().collect())
    distinct = windows.select("n", "fingerprint", "window").distinct()
    distinct = small(distinct, distinct.count(), MAX_BROADCAST_WINDOWS)

    rows = keyed(docs, key, text)
    base = rows.withColumn("words", words(F.col("text"))).select("doc_id", "doc_key", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda word: F.xxhash64(word)).alias("hashes"))
    for length in lengths:
        base = runs(base, length).withColumnRenamed("runs", f"runs_{length}")

    def of_length(n: int) -> Column:
        return F.transform(f"runs_{n}", lambda run: F.struct(F.lit(n).alias("n"), run.fingerprint.alias("fingerprint"), run.first.alias("first"), run.last.alias("last")))

    # A run of length 0, which matches nothing, stands for the input row, so that every row has one and copies are counted.
    own = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("fingerprint"), F.lit(0).alias("first"), F.lit(0).alias("last")))
    each = F.concat(own, *map(of_length, lengths))
    exploded = base.select("doc_id", "doc_key", "n_words", F.explode(each).alias("run")).select("doc_id", "doc_key", "n_words", "run.*")
    met = exploded.join(distinct, ["n", "fingerprint"], "left").where(F.col("window").isNotNull() | (F.col("n") == 0))
    candidate = F.when(F.col("window").isNotNull(), F.struct("n", "first", "last", "window"))
    candidates = stage(met.groupBy("doc_key", "doc_id", "n_words").agg(F.collect_set(candidate).alias("candidates"), F.count_if(F.col("n") == 0).cast("int").alias("copies")), "benchmark-hits")

    suspects = candidates.where(F.size("candidates") > 0).select("doc_key", "candidates")
    keys = small(suspects.select("doc_key"), suspects.count(), MAX_BROADCAST_KEYS)
    bodies = rows.join(keys, "doc_key", "left_semi").dropDuplicates(["doc_key"]).withColumn("words", words(F.col("text")))

    def occurrences(one: Column) -> Column:
        starts = F.filter(F.sequence(one.first, one.last), lambda at: F.array_join(F.slice("words", at + 1, one.n), " ") == one.window)
        return F.transform(starts, lambda at: F.struct(at.alias("start"), one.n.alias("n"), one.window.alias("window")))

    hits = bodies.join(suspects, "doc_key").select("doc_key", F.flatten(F.transform("candidates", occurrences)).alias("hits")).where(F.size("hits") > 0)
    hits = stage(hits, "benchmark-occurrences")
    pairs = hits.select("doc_key", F.explode(F.array_distinct(F.transform("hits", lambda hit: F.struct(hit.n.alias("n"), hit.window.alias("window"))))).alias("one")).select("doc_key", "one.*")
    owners = pairs.join(windows.select("n", "window", F.col("item_id").cast("string").alias("item")).distinct(), ["n", "window"]).groupBy("doc_key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    rows_again = candidates.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc_id", "doc_key", "n_words")
    whole = rows_again.join(hits, "doc_key", "left").join(owners, "doc_key", "left")
    nothing = F.array()
    return whole.withColumn("hits", F.coalesce("hits", nothing.cast(dict(hits.dtypes)["hits"]))).withColumn("item_ids", F.coalesce("item_ids", nothing.cast("array<string>")))


def hit_words(hits: Column) -> Column:
    """Number of words that lie inside an occurrence."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda hit: F.sequence(hit.start, hit.start + hit.n - 1))))).cast("long")


def clean(docs: DataFrame, items: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no window of an item."""
    found = stage(contamination(docs, items, n, key, text).where(F.size("hits") > 0).select("doc_key"), "contaminated")
    mark = F.xxhash64(key, text)
    dirty = small(found.withColumnRenamed("doc_key", "__contaminated"), found.count(), MAX_BROADCAST_KEYS)
    return docs.join(dirty, mark == F.col("__contaminated"), "left_anti")
