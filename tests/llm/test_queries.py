"""What queries may learn from: values of held-out documents are changed and nothing else may change."""

from __future__ import annotations

import zlib

from gazette.llm import queries
from gazette.schemas import struct
from gazette.sources.config import local_frame

DOCS = struct("doc_id bigint, text string, lang string, source string, n_chars bigint")
LABELS = struct("doc_id bigint, quality int, toxic int")
ENGLISH, GERMAN = "the house is near the river and we like it number {}", "das Haus steht nahe am Fluss und wir mögen es Nummer {}"


def crc(one, modulus):
    return zlib.crc32(str(one).encode()) % modulus


def write(spark, folder, held_lang, held_quality, held_text=""):
    rows = []
    for i in range(80):
        text = (ENGLISH if i % 2 else GERMAN).format(i) + (" BUY | NOW | BUY" * 4 if i % 5 == 0 else "")
        rows.append((i, text + (held_text if crc(i, 7) == 2 else ""), held_lang if crc(i, 4) == 2 else "en" if i % 2 else "de", "s", len(text)))
    rows += [(80, None, "en", "s", 0), (81, "", None, "s", 0)]
    local_frame(spark, rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    local_frame(spark, [(i, held_quality if crc(i, 3) == 1 else int(i % 5 != 0), 0) for i in range(60)], LABELS).write.parquet(f"{folder}/labels.parquet")
    return rows


def test_held_out_values_are_not_learned(spark, tmp_path):
    rows = write(spark, str(tmp_path / "a"), "en", 0)
    write(spark, str(tmp_path / "b"), "xx", 1)
    for query, modulus, held in ((queries.op1_language_id, 4, 2), (queries.op8_quality_classifier, 3, 1)):
        first, second = (sorted(map(tuple, query(spark, str(tmp_path / name)).select("doc_id", "held_out", "score").collect())) for name in "ab")
        assert first == second and [one[:2] for one in first] == [(row[0], crc(row[0], modulus) == held) for row in rows]
        assert all(0 <= one[2] <= 1 for one in first)
    found = {row.doc_id: row for row in queries.op1_language_id(spark, str(tmp_path / "b")).collect()}
    assert [found[i].lang_pred for i in range(80)] == ["en" if i % 2 else "de" for i in range(80)] and found[80].lang_pred == found[81].lang_pred == "und"
    assert (found[80].score, found[81].score) == (0, 0)


def test_katz_learns_from_the_others_alone(spark, tmp_path):
    rows = write(spark, str(tmp_path / "a"), "en", 0)
    write(spark, str(tmp_path / "b"), "en", 0, " words that only these documents have")
    first, second = ({row.doc_id: row for row in queries.op10_katz(spark, str(tmp_path / name)).collect()} for name in "ab")
    learned = [row for row in rows if crc(row[0], 7) != 2]
    assert {row.train_tokens for row in (*first.values(), *second.values())} == {sum(len((row[1] or "").split()) + 1 for row in learned)}
    assert all(first[row[0]] == second[row[0]] for row in learned) and all(first[one].held_out == (crc(one, 7) == 2) for one in first)
    assert all(second[row[0]].n_tokens == first[row[0]].n_tokens + 6 and second[row[0]].n_known == first[row[0]].n_known for row in rows[:80] if crc(row[0], 7) == 2)
