"""Suffix-array dedup against all strings of all documents in a dictionary."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from gazette.llm import queries, suffixes
from gazette.schemas import struct
from gazette.sources.config import local_frame

SCHEMA = struct("doc_id bigint, text string, block int, bytes string, rank string, kept int")


def plain(rows, width=50):
    ranks = [-(2**63) if one is None else one for one, _ in rows]
    texts = [(text or "").encode() for _, text in rows]
    least: dict[bytes, int] = {}
    for rank, data in zip(ranks, texts):
        for i in range(len(data) - width + 1):
            own = data[i:i + width]
            least[own] = min(least.get(own, rank), rank)
    found = []
    for (one, _), rank, data in zip(rows, ranks, texts):
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - width + 1):
            if least[data[i:i + width]] < rank:
                gone[i:i + width] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8))).tolist()
        spans = list(zip(edges[0::2], (b - a for a, b in zip(edges[0::2], edges[1::2]))))
        found.append((one, len(data), spans, bytes(b for b, out in zip(data, gone) if not out)))
    return found


def rows():
    rng = random.Random(11)
    words = ["the", "cat", "été", "ß", "run", "0123456789", "a", "of", "x" * 30]
    base = [" ".join(rng.choices(words, k=rng.randint(10, 120))) for _ in range(25)]
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 51, "x" * 400, "ab" * 200, "ab" * 30, None]
    for i in range(150):
        text = rng.choice(base)
        cut = rng.randrange(len(text))
        kind = rng.random()
        if kind < 0.3:
            text = text[cut:cut + rng.randint(40, 60)] + rng.choice(base)
        elif kind < 0.6:
            text = text[:cut] + "!" + text[cut:]
        elif kind < 0.7:
            text = text + text
        elif kind < 0.8:
            text = "".join(rng.choices("abcdefgh ", k=300))
        texts.append(text)
    keys = [rng.randint(0, 120) if i % 11 else None for i in range(len(texts))]
    return [(one, text, 1, "b", "r", 2) for one, text in zip(keys, texts)] + [(3, base[0], 1, "", "", 0)] * 2


def as_rows(out):
    return sorted(((row.doc_id, row.n_bytes, [tuple(one) for one in row.spans], bytes(row.kept)) for row in out.collect()), key=repr)


def test_every_string(spark, monkeypatch):
    frame, expected = local_frame(spark, rows(), SCHEMA).repartition(3), sorted(plain([row[:2] for row in rows()]), key=repr)
    out = suffixes.without_repeats(frame, block_bytes=3000)
    assert out.columns == ["doc_id", "n_bytes", "spans", "kept"]
    assert as_rows(out) == expected


def test_other_width_and_whole_blocks(spark):
    frame = local_frame(spark, rows(), SCHEMA).repartition(2)
    assert as_rows(suffixes.without_repeats(frame, width=33)) == sorted(plain([row[:2] for row in rows()], 33), key=repr)
    with pytest.raises(ValueError):
        suffixes.without_repeats(frame, width=20)


def test_small_slices_and_chunks(monkeypatch):
    """Slices, chunks and buckets of a few rows find what whole ones find."""
    texts = [(i, text) for i, (_, text, *_) in enumerate(rows()) if text]
    row = {"sizes": [len(text.encode()) for _, text in texts], "body": suffixes.zstandard.ZstdCompressor().compress("".join(text for _, text in texts).encode()), "copies": None}
    whole = list(suffixes.Texts(row, 50).anchors())
    monkeypatch.setattr(suffixes, "SLICE", 100)
    parts = list(suffixes.Texts(row, 50).anchors())

    def strings(found):
        return {(int(i), int(p)) for first, last, anchor, *_ in found for a, b, p in zip(first, last, anchor) for i in range(a, b + 1)}

    assert strings(whole) == strings(parts) and len(strings(whole)) == sum(max(len(text.encode()) - 49, 0) for _, text in texts)


def test_multikey_order():
    rng = random.Random(2)
    data = np.array([rng.choice(b"ab") for _ in range(3000)], np.uint8)
    starts = np.arange(2900)
    order, fresh = suffixes.multikey_order(suffixes.eights(data), starts, 50)
    strings = [data[i:i + 50].tobytes() for i in order]
    assert strings == sorted(strings)
    assert [True] + [a != b for a, b in zip(strings, strings[1:])] == fresh.tolist()


def test_buckets_meet_at_boundaries(spark):
    """One passage in far more documents than a chunk has rows: most of it is compared across boundaries."""
    passage = "this passage is the same in each of the documents and holds no other words, which makes its grams hot ones "
    frame = spark.range(3000).selectExpr("id AS doc_id", f"concat(id, ' own words ', id * 7919, ' {passage * 2}', id) AS text")
    out = {row.doc_id: row for row in suffixes.without_repeats(frame, block_bytes=20000).collect()}
    texts = {row.doc_id: row.text for row in frame.collect()}
    assert not out[0].spans
    assert all(passage * 2 not in bytes(out[i].kept).decode() and sum(one.length for one in out[i].spans) >= 2 * len(passage) for i in range(1, 3000))
    some = [(i, texts[i]) for i in range(40)]
    assert [(i, len(texts[i]), [tuple(one) for one in out[i].spans], bytes(out[i].kept)) for i in range(40)] == plain(some)


def test_query(spark, tmp_path):
    local_frame(spark, rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op13_suffix_array_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(one, size, sum(n for _, n in spans), len(spans), hashlib.sha256(kept).hexdigest()) for one, size, spans, kept in plain([row[:2] for row in rows()])], key=repr)


def test_empty_table(spark):
    assert suffixes.without_repeats(local_frame(spark, [], SCHEMA)).collect() == []


def test_strings_that_agree_are_not_sorted_again(monkeypatch):
    """Groups of equal strings are left as they are, others are in the order of their bytes."""
    rng = np.random.default_rng(6)
    data = np.frombuffer(bytes(rng.integers(97, 99, 400, np.uint8).tolist()) * 5, np.uint8)
    words, starts = suffixes.eights(data), rng.permutation(len(data) - 60)
    order, fresh = suffixes.multikey_order(words, starts, 50)
    strings = [data[starts[n]:starts[n] + 50].tobytes() for n in order.tolist()]
    assert strings == sorted(strings) and len(set(order.tolist())) == len(starts)
    assert fresh.tolist() == [n == 0 or strings[n] != strings[n - 1] for n in range(len(strings))]
    sorts, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(len(keys[0])) or lexsort(keys))
    same = np.frombuffer(b"0123456789" * 60, np.uint8)
    suffixes.multikey_order(suffixes.eights(same), np.arange(500), 50)
    assert not sum(sorts)
