"""Alignment against a plain walk over both tokenizers' byte ends."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from gazette.llm import align, queries
from gazette.llm.bpe import byte_of_letter
from gazette.schemas import struct
from gazette.sources.config import local_frame

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = struct("doc_id bigint, text string, document string, groups string, piece int")


def plain_tokens(text):
    """Ids and bytes of both tokenizers' tokens, by the libraries on the whole text."""
    tokenizer, library, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of_letter()
    tokenizer.encode_special_tokens = True
    a = [(one.ids, one.tokens) for one in [tokenizer.encode(" " + text, add_special_tokens=False)]][0]
    a = [(one, bytes(letters[c] for c in piece)) for one, piece in zip(*a)]
    b = []
    for one in library.encode(text):
        piece = library.id_to_piece(one)
        b.append((one, bytes([int(piece[3:5], 16)]) if library.is_byte(one) else piece.replace("▁", " ").encode()))
    return a, b


def plain(rows):
    every, counts = [], Counter()
    for doc_id, text in rows:
        a, b = plain_tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        ends_a, ends_b = ([sum(len(x) for _, x in side[:i + 1]) for i in range(len(side))] for side in (a, b))
        links = [(a[i][0], b[j][0]) for i, end in enumerate(ends_a) for j, other in enumerate(ends_b) if end == other]
        shared, groups, low = sorted(set(ends_a) & set(ends_b)), [], 0
        for end in shared:
            groups.append("|".join(",".join(str(one) for (one, _), at in zip(side, ends) if low < at <= end) for side, ends in ((a, ends_a), (b, ends_b))))
            low = end
        every.append((doc_id, len(a), len(b), len(shared), links, ";".join(groups)))
        counts.update(links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(one, n_a, n_b, n, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), groups)
            for one, n_a, n_b, n, links, groups in every]


def rows():
    rng = random.Random(5)
    alphabet = ["a", "the ", " cat", "é", "ß", "\n", "  ", "\t", "😀", "中文", "<|endoftext|>", "</s>", "▁", "1", "23", ".", "'s ", "́", "\x00", "Straße "]
    texts = [None, "", " ", "a", "▁", "x▁y", "The cat sat on the mat."] * 2 + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(60)]
    texts += ["", None, "unbelievably long " * 150, "", "😀é中" * 120, None]
    return [(i if i % 9 else None, text, "x", "y", 3) for i, text in enumerate(texts)] + [(5, "a", "x", "y", 3)]


def test_pieces_of_every_size(spark):
    frame = local_frame(spark, rows(), SCHEMA).coalesce(2)
    expected = sorted(plain([row[:2] for row in rows()]), key=repr)
    for steps in (1, 7, 64, 1 << 20):
        out = align.aligned(frame, A, B, steps=steps)
        assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        assert sorted(map(tuple, out.collect()), key=repr) == expected, steps


def test_pieces_have_equal_work(spark):
    frame = local_frame(spark, [(1, "some words of a text " * 400, "", "", 1)], SCHEMA)
    cut = align.pieces(frame, A, B, "doc_id", "text", 100).collect()
    work = [len(align.unpacked(row.a)) + len(align.unpacked(row.b)) for row in cut]
    assert len(cut) > 20 and max(work) - min(work) <= 2


def test_overlaps():
    """Ends of A at 2, 5, 6 and of B at 1, 5, 6."""
    row = {"a": align.packed(np.array([0, 1, 2])), "b": align.packed(np.array([0, 1, 2])), "counts_a": align.packed(np.array([3])),
           "counts_b": align.packed(np.array([3])), "lead": 0, "next_a": -1, "next_b": -1}
    a, b, together = align.Merge(row, (np.array([2, 3, 1]), np.array([1, 4, 1]))).overlaps()
    assert list(zip(a.tolist(), b.tolist(), together.tolist())) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, True)]


def test_query(spark, tmp_path):
    local_frame(spark, rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op11_tokenizer_alignment(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(*row[:7], hashlib.sha256(row[7].encode()).hexdigest() if row[1] else "") for row in plain([row[:2] for row in rows()])], key=repr)
    assert not [one for one in spark.catalog.listTables() if one.name.startswith("align")]


def test_empty_table(spark):
    assert align.aligned(local_frame(spark, [], SCHEMA), A, B).collect() == []
