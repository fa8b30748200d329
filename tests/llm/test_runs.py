"""Runs against a brute-force search over all periods, and the query against a plain reading of its definition."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gazette.llm import queries, runs
from gazette.sources.config import local_frame
from gazette.schemas import struct

SCHEMA = struct("doc_id bigint, text string, runs string")


def brute_runs(words, least=24, times=3):
    """A run of a period is a longest stretch of places that equal the place one period on; it counts under its smallest period."""
    found, n = {}, len(words)
    for period in range(1, n // times + 1):
        start = 0
        while start + period < n:
            end = start
            while end + period < n and words[end] == words[end + period]:
                end += 1
            length = end + period - start
            if end > start and length >= max(least, times * period):
                found.setdefault((start, length), period)
            start = end + 1
    return sorted((start, length, period) for (start, length), period in found.items())


def brute_row(doc_id, text):
    words = [word for word in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    kept = b" ".join(word for i, word in enumerate(words) if i not in gone)
    lines = "".join("%d,%d,%d\n" % r for r in found)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts():
    rng = random.Random(7)
    out = [None, "", "  \n\t ", "a", "a " * 23, "a " * 24, "a b " * 12, "a b c d e f g h " * 3, "A a " * 40, "é é é é " * 30, "x\x0by\x0cz\r" * 20]
    for _ in range(120):
        base = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            at, width = rng.randrange(len(base)), rng.randint(1, 14)
            base[at:at] = base[at:at + width] * rng.randint(2, 9)
        out.append(" ".join(base))
    fibonacci = ["a", "b"]
    while len(fibonacci) < 12:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    return out + [" ".join(fibonacci[-1].split()), "one two three " * 5000]


def test_lyndon_lengths():
    rng = random.Random(3)
    for _ in range(400):
        word = [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randint(0, 40))]
        word = np.unique(word, return_inverse=True)[1].tolist() if word else []
        # The longest Lyndon word ends where the next smaller suffix begins.
        plain = [next((j for j in range(i + 1, len(word)) if word[j:] < word[i:]), len(word)) - i for i in range(len(word))]
        assert runs.lyndon_lengths(word) == plain


def test_runs_of_batches():
    words = [(text or "").encode().split() for text in texts()]
    words = [one for one in words if len(one) < 2000]
    found = runs.batch_runs(words, {}, 24, 3)
    assert [list(map(tuple, one.tolist())) for one in found] == [brute_runs(one) for one in words]
    assert [list(map(tuple, one.tolist())) for one in runs.batch_runs(words, {}, 30, 4)] == [brute_runs(one, 30, 4) for one in words]


def test_query(spark, tmp_path):
    """Nulls, empty texts, repeated rows, null and shared ids, a column with a clashing name."""
    rows = [(i * 7 if i else None, text, "other") for i, text in enumerate(texts())]
    rows += [(i, " ".join("w%d" % (i * k % 61) for k in range(i % 90)), None) for i in range(400, 700)]
    rows += rows[30:33] + [(rows[40][0], "a b " * 40, "")]
    local_frame(spark, rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(one, *brute_row(one, text)) for one, text, _ in rows if len(text or "") < 50000] + [row for row in got if row[0] == 7 * (len(texts()) - 1)], key=repr)
    long = next(row for row in got if row[0] == 7 * (len(texts()) - 1))
    assert long[1:5] == (1, 0, 15000, 3)


def test_empty_table(spark):
    assert runs.find(local_frame(spark, [], SCHEMA)).collect() == []


def test_smaller_bounds_are_refused(spark):
    with pytest.raises(ValueError):
        runs.find(local_frame(spark, [], SCHEMA), least=10)
