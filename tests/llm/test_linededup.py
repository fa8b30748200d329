"""Line dedup against a plain pass over the units in order of their ranks, and the query against its SQL."""

from __future__ import annotations

import random

import duckdb
import regex

from gazette.llm import linededup, queries
from gazette.schemas import struct
from gazette.sources.config import local_frame

SCHEMA = struct("doc_id bigint, text string, rank int, doc_key string, places string, cut_starts int, row int")


def plain(rows, unit="clause", min_words=linededup.MIN_WORDS, inside=False):
    """Cut texts with the offsets of the cuts; ids are distinct."""
    pattern, owner, out = regex.compile(rf"[^\n]*?(?:{linededup.ENDS[unit]}|\Z)"), {}, {}
    unspaced = linededup.UNSPACED
    for one, text in sorted(rows, key=lambda row: (row[0] is not None, row[0])):
        if text is None:
            out[one] = (None, [], [])
            continue
        stretches, stretch = [], None
        for found in pattern.finditer(text):
            body = regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", found.group().lower()).strip()
            if not body:
                continue
            words = len(body.split(" ")) + len(unspaced.findall(body)) // 2
            if body in owner and (inside or owner[body] != one):
                if stretch is None:
                    stretch = [found.start(), 0, 0]
                    stretches.append(stretch)
                stretch[1], stretch[2] = found.end(), stretch[2] + words
            else:
                stretch = None
            owner.setdefault(body, one)
        spans = [(a, b) for a, b, words in stretches if words >= min_words]
        kept = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in spans))
        out[one] = (kept, [a for a, _ in spans], [b - a for a, b in spans])
    return out


def rows():
    rng = random.Random(4)
    words = ["The", "cat", "été", "ÄÖ", "of", "it", "12", "ran"]
    sentences = [" ".join(rng.choices(words, k=rng.randint(1, 14))) + rng.choice([". ", "! ", '." ', ".\n", "\n", ".  ", " ... ", "? \n\n"]) for _ in range(30)]
    passage = "".join(sentences[:8])
    chinese = "".join(chr(0x4E00 + i) for i in range(110))
    texts = [None, "", " \n", "...", passage, "Own words at the start. " + passage + "And own ones at the end.", passage.upper(), chinese, "Own. " + chinese + "\nend",
             "license line of five words\nown text of one", "license line of five words\nown text of another", passage.rstrip(), "第一句话在这里。第二句话在这里。", "a\n" * 60, "a b c d e... !!"]
    texts += ["".join(rng.choices(sentences, k=rng.randint(1, 25))) for _ in range(60)]
    return list(enumerate(texts)) + [(None, passage)]


def test_stretches(spark):
    frame = local_frame(spark, [(*row, 1, "k", "p", 7, 2) for row in rows()], SCHEMA)
    for unit, least, inside in (("clause", 25, False), ("line", 5, True), ("sentence", 1, True), ("line", 40, False), ("clause", 3, True)):
        out = linededup.without_repeats(frame, unit=unit, min_words=least, inside=inside, block_bytes=500 if inside else 8 << 20)
        assert out.columns == ["doc_id", "text", "rank", "doc_key", "places", "row", "cut_starts", "cut_lengths"]
        assert {row.doc_id: (row.text, row.cut_starts, row.cut_lengths) for row in out.collect()} == plain(rows(), unit, least, inside), (unit, least)
    cut = plain(rows())
    assert cut[5][0] == "Own words at the start. And own ones at the end." and cut[8][0] == "Own. end" and cut[10][1] == [] and cut[None][1] == []


def test_shared_ids_and_repeated_rows(spark):
    long = "one two three four five six seven eight nine ten " * 3
    frame = local_frame(spark, [(one, text, 1, "", "", 1, 1) for one, text in [(7, long + "a"), (7, long + "a"), (7, "b\n" + long + "a"), (8, long + "a")]], SCHEMA)
    for block_bytes in (100, 8 << 20):
        out = linededup.without_repeats(frame, block_bytes=block_bytes).collect()
        assert sorted(len(row.cut_starts) for row in out if row.doc_id == 7) == [0, 0, 0] and [row.text for row in out if row.doc_id == 8] == [""]
    assert linededup.without_repeats(frame.where("false")).collect() == []


def test_query_is_its_sql(spark, tmp_path):
    local_frame(spark, [(*row, 1, "k", "p", 7, 2) for row in rows() if row[0] is not None], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op7_line_dedup(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = duck.execute(queries.ORACLES["op7_line_dedup"])
    order = [[one[0] for one in found.description].index(name) for name in out.columns]
    assert sorted(map(repr, (tuple(row) for row in out.collect()))) == sorted(repr(tuple(row[i] for i in order)) for row in found.fetchall())
