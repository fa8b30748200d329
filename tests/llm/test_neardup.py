"""Near-duplicate groups and decisions against all pairs, with ids that are null or shared and rows that are equal."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gazette.llm import neardup
from gazette.schemas import struct
from gazette.sources.config import local_frame

SCHEMA = struct("doc_id bigint, text string, component int, copies string, __id string, block int")


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def plain(rows, k, percent=80):
    """For each row its set's size and the numbers of the rows in its group; None without words."""
    sets = [shingles(text, k) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    groups = {i: [j for j in range(len(rows)) if root(j) == root(i)] if sets[i] else None for i in range(len(rows))}
    return [(len(sets[i]), groups[i]) for i in range(len(rows))]


def rows():
    rng = random.Random(8)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(30, 90))] for _ in range(12)]
    texts = [None, "", " \n", "one", "one", None]
    for _ in range(110):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
        texts.append(" ".join(words))
    ids = [None if i % 13 == 5 else rng.randrange(70) for i in range(len(texts))]
    out = list(zip(ids, texts))
    return out + [out[20], out[20], out[30], (7, "a text of its own under a shared id and no other"), (7, out[40][1]), (None, "without an id and alone here"), (None, "without an id and alone here")]


def test_groups_and_decisions(spark):
    data = rows()
    frame = local_frame(spark, [(*row, 1, "c", "i", 2) for row in data], SCHEMA).repartition(3)
    expected, kept = [], Counter()
    for (one, text), (size, group) in zip(data, plain(data, 5)):
        ids = [data[j][0] for j in group or [] if data[j][0] is not None]
        least = one if group is None else min(ids, default=None)
        expected.append((one, size, least, one == least))
    for own in {tuple(group) for _, group in plain(data, 5) if group is not None}:
        # One row stays: of the smallest id; which of its texts is up to a digest.
        kept[min((data[j][0] is None, data[j][0] or 0) for j in own)] += 1
    assert Counter(map(tuple, neardup.groups(frame).collect())) == Counter(expected)
    out = neardup.distinct_documents(frame)
    assert out.columns == frame.columns
    stays = out.collect()
    wordless = [one for one, text in data if not (text or "").split()]
    assert Counter(row.doc_id for row in stays if not (row.text or "").split()) == Counter(wordless)
    assert Counter((row.doc_id is None, row.doc_id or 0) for row in stays if (row.text or "").split()) == kept
    assert "a text of its own under a shared id and no other" in [row.text for row in stays]
    assert [row.text for row in stays].count("without an id and alone here") == 1


def test_bucket_counts_never_drop_a_pair():
    rng = np.random.default_rng(3)
    for size in (1, 5, 70, 900, 6000):
        for share in (0.5, 0.8, 0.81, 0.9, 1.0):
            left = np.unique(rng.integers(0, 2**63, size, np.uint64) * np.uint64(2))
            right = np.unique(np.concatenate([left[:int(len(left) * share)], rng.integers(0, 2**63, rng.integers(0, size // 9 + 1), np.uint64)]))
            both = len(np.intersect1d(left, right))
            if 100 * both >= 80 * (len(left) + len(right) - both):
                assert neardup.may_be_alike(neardup.bucket_counts(left), neardup.bucket_counts(right), len(left) + len(right), 80)
    apart = [neardup.bucket_counts(np.unique(rng.integers(0, 2**63, 700, np.uint64) * np.uint64(2))) for _ in range(2)]
    assert not neardup.may_be_alike(*apart, 1400, 80)


def test_large_nodes_are_compared_in_slices(spark, monkeypatch):
    """One hot token set: nodes never become small, the last level compares what is left across components."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(60)]
    data = [(i, " ".join(rng.sample(common, 40))) for i in range(120)]
    monkeypatch.setattr(neardup, "SLICE_ROWS", 7)
    frame = spark.createDataFrame(data, "doc_id bigint, text string")
    found = {row.doc_id: row.component_id for row in neardup.groups(frame, k=1, percent=55, node_rows=3, node_pairs=0, levels=1).collect()}
    assert found == {i: min(data[j][0] for j in group) for i, (_, group) in enumerate(plain(data, 1, 55))}


def test_sketches_never_drop_a_pair(spark):
    rng = np.random.default_rng(4)
    rows, near = [], 0
    for _ in range(1500):
        left = np.unique(rng.integers(0, 2**63, rng.integers(1, 900), np.uint64) * np.uint64(2))
        other = rng.integers(0, 2**63, rng.integers(0, len(left) // 4 + 2), np.uint64)
        right = np.unique(np.concatenate([left[:int(len(left) * rng.uniform(0.75, 1))], other])) if rng.random() < 0.8 else np.unique(rng.integers(0, 2**63, len(left), np.uint64))
        both = len(np.intersect1d(left, right))
        is_near = 100 * both >= 80 * (len(left) + len(right) - both)
        rows.append((bool(is_near), len(left), len(right), *neardup.signature(left)[1], *neardup.signature(right)[1]))
    names = [f"{name}_{side}" for side in "ab" for name in neardup.SKETCH]
    frame = spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in rows], "near boolean, n_shingles_a bigint, n_shingles_b bigint, " + ", ".join(f"{name} bigint" for name in names))
    judged = frame.select("near", neardup.alike(80).alias("passes")).collect()
    assert sum(row.near for row in judged) > 200 and all(row.passes for row in judged if row.near)
    assert sum(row.passes for row in judged if not row.near) < 0.5 * sum(not row.near for row in judged)


def test_components_are_compared_by_their_pairs_alone(spark, monkeypatch):
    """One large component with a few members beside it: the rows repeated follow the pairs between components."""
    monkeypatch.setattr(neardup, "SLICE_ROWS", 10)
    component = {c: 0 if c < 300 else c // 2 * 2 for c in range(306)}
    rows = [(node, c, 50, *[0] * len(neardup.SKETCH), component[c]) for node in (1, 2) for c in component]
    frame = spark.createDataFrame(rows, "node bigint, class bigint, n_shingles bigint, " + ", ".join(f"{name} bigint" for name in neardup.SKETCH) + ", component bigint")
    pairs = neardup.across(frame, 80)
    assert Counter(map(tuple, pairs.collect())) == Counter((a, b) for a, b in itertools.combinations(component, 2) if component[a] != component[b])
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "largest" in plan.split("Generate explode")[1], "members of the largest component are repeated"


def test_coarse_counts_never_drop_a_pair_and_are_narrower():
    rng = np.random.default_rng(5)
    for size in (70, 900, 6000):
        left = np.unique(rng.integers(0, 2**63, size, np.uint64) * np.uint64(2))
        right = np.unique(np.concatenate([left[:int(len(left) * 0.9)], rng.integers(0, 2**63, size // 20, np.uint64)]))
        both = len(np.intersect1d(left, right))
        assert 100 * both >= 80 * (len(left) + len(right) - both)
        assert neardup.may_be_alike(neardup.bucket_counts(left, 8), neardup.bucket_counts(right, 8), len(left) + len(right), 80)
    apart = [np.unique(rng.integers(0, 2**63, 4000, np.uint64) * np.uint64(2)) for _ in range(2)]
    assert not neardup.may_be_alike(*(neardup.bucket_counts(one, 8) for one in apart), 8000, 80)
    assert len(neardup.bucket_counts(apart[0], 8)) * 2 < len(neardup.bucket_counts(apart[0]))


def test_members_of_nodes_do_not_travel_with_their_sketches(spark):
    """Small nodes' members were shuffled again to be compared, and open nodes' members took their sketches to every join."""
    wide = ", ".join(f"{name} bigint" for name in neardup.SKETCH)
    classes = spark.createDataFrame([(c, 50, *[c % 2] * len(neardup.SKETCH)) for c in range(40)], f"class bigint, n_shingles bigint, {wide}")
    members = classes.select((F.col("class") % 2).alias("node"), *neardup.FIELDS).union(classes.where("class < 6").select(F.col("class").alias("node") % 3 + 10, *neardup.FIELDS))
    pairs, large = neardup.met(members, 5, 80)
    assert {node for node, in large.select("node").distinct().collect()} == {0, 1}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    found = spark.createDataFrame([(c, 0) for c in range(0, 30, 2)], "class bigint, component bigint")
    open_nodes = neardup.undecided(large, found, classes, 100)
    scans = open_nodes._jdf.queryExecution().executedPlan().toString().split("FileScan parquet ")[1:]
    assert scans and not any("x0" in scan.splitlines()[0] for scan in scans)
    fields = {c: (50, *[c % 2] * len(neardup.SKETCH)) for c in range(40)}
    expected = {(c % 2, c, *fields[c], 0 if c % 2 == 0 and c < 30 else c, True) for c in range(40)}
    assert set(map(tuple, open_nodes.collect())) == expected and open_nodes.count() == 40


def test_documents_that_stay_are_not_shuffled(spark):
    """Whole documents were shuffled to meet the decisions; of rows equal in id and text one stays, by the same order as ever."""
    texts = [" ".join(f"w{i}x{j % 40}" for j in range(60)) for i in range(30)]
    data = [(i, texts[i], i, "en") for i in range(30)] + [(40 + i, texts[i], i, "de") for i in range(10)] + [(3, texts[3], n, None) for n in (7, 8, 9)] + [(None, None, 1, "x"), (90, "", 2, "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string, `n, of: rows` int, lang string").repartition(3)
    out = neardup.distinct_documents(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert "near_texts" in plan and not any("text" in line for line in moved)
    copies = docs.where("doc_id = 3").withColumn("h", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{name}`") for name in docs.columns]))))
    expected = {row for row in data if row[0] != 3 and (row[0] is None or row[0] < 40 or row[0] == 90)} | {tuple(copies.orderBy("h").first())[:-1]}
    assert out.columns == docs.columns and out.count() == len(expected) and set(map(tuple, out.collect())) == expected
