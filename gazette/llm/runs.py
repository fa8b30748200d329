"""Runs of words: maximal periodic stretches, found by their Lyndon roots.

Phase one of Baier's suffix sorter groups suffixes by the longest Lyndon word they begin with. It is run under an order of the
words and under the reverse one; the lengths of the groups' words are the Lyndon arrays of both. Every run has a Lyndon word of
one of them as a period, so each place and its Lyndon word are a candidate, which is extended to both sides as far as the words
repeat (longest common extensions, from names of all stretches of 2**k words). Candidates long enough for their period are runs.

A run of ``least`` words with ``least >= 24`` and three periods has no place that is not in a stretch of 16 words which its document has
elsewhere too. Only what such stretches cover is sorted; nothing is lost, as a run and the words beside it that would extend it
lie in one covered stretch.

Defined cases: a null text and one without words have no words and no runs; words are split at ASCII white space and compared
byte by byte; repeated rows and null keys have a row each; columns other than key and text take no part; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 16
BATCH_BYTES = 4 << 20
MAX_WORDS_KEPT = 400_000
STIR = np.uint64(0x9E3779B97F4A7C15)
RESULT = "key {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place; symbols are all the numbers from 0 to their largest.

    Groups of places are passed from the highest to the lowest. The places before a group's members, each the nearest that is
    in a lower group, have the group's word after their own, as often as the group holds members for them: they move to new
    groups right above their own ones.
    """
    group, words = symbols[:], max(symbols, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(words)]
    for place, symbol in enumerate(symbols):
        members[symbol].append(place)
    length, below, above = [1] * words, list(range(-1, words - 1)), [*range(1, words), -1]
    # nearest[place + 1] leads to the nearest place at or before this one that is not passed; 0 is none.
    nearest = list(range(len(symbols) + 1))
    now = words - 1
    while now >= 0:
        inside = [place for place in members[now] if group[place] == now]
        for place in inside:
            nearest[place + 1] = place
        counts: dict[int, int] = {}
        for place in inside:
            at = place
            while nearest[at] != at:
                nearest[at] = nearest[nearest[at]]
                at = nearest[at]
            if at:
                counts[at - 1] = counts.get(at - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for place, count in counts.items():
            moved.setdefault((-count, group[place]), []).append(place)
        for (count, old), places in sorted(moved.items()):
            new = len(members)
            members.append(places)
            length.append(length[old] - count * length[now])
            below.append(old)
            above.append(above[old])
            below[above[old]] = new
            above[old] = new
            for place in places:
                group[place] = new
        now = below[now]
    return [length[one] for one in group]


def stretch_names(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """For every k, numbers that are equal for equal stretches of 2**k symbols, by the place where they begin."""
    names = [symbols]
    while 2 << (len(names) - 1) <= longest:
        last, width = names[-1], 1 << (len(names) - 1)
        pairs = last[:-width] * np.int64(len(symbols) + 1) + last[width:]
        names.append(np.unique(pairs, return_inverse=True)[1].ravel())
    return names


def common(names: list[np.ndarray], x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols from x and from y on are equal; backward, how many that end right before x and y."""
    x, y, found = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width, own = 1 << k, names[k]
        if forward:
            can = np.maximum(x, y) + width <= len(names[0])
            same = can & (own[np.where(can, x, 0)] == own[np.where(can, y, 0)])
            step = width
        else:
            can = np.minimum(x, y) >= width
            same = can & (own[np.where(can, x - width, 0)] == own[np.where(can, y - width, 0)])
            step = -width
        found += np.where(same, width, 0)
        x, y = np.where(same, x + step, x), np.where(same, y + step, y)
    return found


def runs_of(symbols: np.ndarray, longest: int, least: int, times: int) -> np.ndarray:
    """Start, length and period of the runs of a sequence in which 0 stands between parts of at most ``longest`` symbols, and at both ends."""
    if len(symbols) < least:
        return np.zeros((0, 3), np.int64)
    symbols = np.unique(symbols, return_inverse=True)[1].ravel().astype(np.int64)
    names, found = stretch_names(symbols, longest), []
    reverse = np.where(symbols == 0, 0, symbols.max() + 1 - symbols)
    places = np.flatnonzero(symbols)
    for order in (symbols, reverse):
        period = np.array(lyndon_lengths(order.tolist()), np.int64)[places]
        right = common(names, places, places + period, True)
        left = common(names, places, places + period, False)
        length = period + right + left
        keep = length >= np.maximum(least, times * period)
        found.append(np.stack([places - left, length, period], 1)[keep])
    return np.unique(np.concatenate(found), axis=0)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def covered(numbers: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Places in stretches of ``GRAM`` words that the same document has again."""
    count = len(numbers) - GRAM + 1
    mask = np.zeros(len(numbers), bool)
    if count < 2:
        return mask
    hashes, width = stirred(numbers.astype(np.uint64) * STIR + document.astype(np.uint64)), 1
    while width < GRAM:
        hashes = stirred(hashes[:-width] * STIR + hashes[width:])
        width *= 2
    inside = np.flatnonzero(document[:count] == document[GRAM - 1:])
    order = inside[np.argsort(hashes[inside])]
    again = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.unique(np.concatenate([order[1:][again], order[:-1][again]]))
    edges = np.zeros(len(numbers) + 1, np.int64)
    edges[twice] += 1
    np.subtract.at(edges, twice + GRAM, 1)
    return np.cumsum(edges[:-1]) > 0


def batch_runs(words: list[list[bytes]], numbers: dict[bytes, int], least: int, times: int) -> list[np.ndarray]:
    """Runs of each document, by start and then period."""
    sizes = np.array([len(one) for one in words], np.int64)
    flat = np.fromiter((numbers.setdefault(word, len(numbers)) for one in words for word in one), np.int64, int(sizes.sum()))
    document = np.repeat(np.arange(len(words)), sizes)
    part = np.flatnonzero(covered(flat, document))
    if not len(part):
        return [np.zeros((0, 3), np.int64)] * len(words)
    fresh = np.concatenate([[True], (np.diff(part) != 1) | (np.diff(document[part]) != 0)])
    firsts = np.flatnonzero(fresh)
    # Parts follow each other with a 0 between, which is below every word in both orders.
    place = np.arange(len(part)) + np.cumsum(fresh)
    symbols = np.zeros(len(part) + len(firsts) + 1, np.int64)
    symbols[place] = flat[part] + 1
    found = runs_of(symbols, int(np.diff(np.append(firsts, len(part))).max()), least, times)
    at = part[np.searchsorted(place, found[:, 0])]
    owner, starts = document[at], np.concatenate([[0], np.cumsum(sizes)])
    found[:, 0] = at - starts[owner]
    return np.split(found, np.searchsorted(owner, np.arange(1, len(words))))


def kept_words(count: int, runs: np.ndarray) -> np.ndarray:
    """Which words no run has after its first period."""
    edges = np.zeros(count + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(edges, runs[:, 0] + runs[:, 1], 1)
    return np.cumsum(edges[:-1]) == 0


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """One row per row: the key, its ``runs`` (start, length and period in words, by start and period) and the ``collapsed`` text.

    A run has ``least`` words and ``times`` periods at least; the collapsed text is the words outside runs and those of each run's first period,
    joined by one blank.
    """
    if least < 24 or times < 3:
        raise ValueError("the stretches that runs are looked for in are for 24 words and 3 periods or more")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}

        def done(keys: list, words: list[list[bytes]], arrow: pa.DataType) -> pa.RecordBatch:
            if len(numbers) > MAX_WORDS_KEPT:
                numbers.clear()
            found = batch_runs(words, numbers, least, times)
            texts = [b" ".join(compress(one, kept_words(len(one), runs).tolist()) if len(runs) else one).decode() for one, runs in zip(words, found, strict=True)]
            flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            each = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.ListArray.from_arrays(pa.array(ends), each), pa.array(texts, pa.string())], ["key", "runs", "collapsed"])

        for batch in batches:
            arrow, keys, words, size = batch.schema.field(0).type, [], [], 0
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = (body.as_py() or "").encode()
                keys.append(one)
                words.append(body.split())
                size += len(body)
                if size > BATCH_BYTES:
                    yield done(keys, words, arrow)
                    keys, words, size = [], [], 0
            if keys:
                yield done(keys, words, arrow)

    return rows.mapInArrow(run, RESULT.format(kind=kind)).withColumnRenamed("key", key)
