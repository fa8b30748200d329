"""The numbered operators against brute force, on small inputs with the odd cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gazette.llm import blocks, bpe, decontaminate, katz, language_id, neardup, quality, repair, topk, warc
from gazette.llm.common import bucketed, stage

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, key string, words string, block int, rank string, number string"
TEXTS = [
    None, "", " ", "one", "It's  the\n\n first\tline, isn't it? 42 ÄÖ ß x \U0001F600", "a<|endoftext|> b <|endoftext|>", "\x00\x1c\x85 é   'S 'll",
    "the cat sat on the mat today\nsecond line of five words here\nthe cat sat on the mat today", "The cat, sat on the mat; TODAY!\nshort\nown words are in this line", "the cat sat on the mat " * 4000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, "en") for i, text in enumerate(TEXTS)] + [(4, TEXTS[4], "en"), (None, "without an id and with some words", "en")]
    return spark.createDataFrame([(*row, "x", "y", 1, "z", "n") for row in rows], DOCS)


def test_bpe_round_trip(spark, docs):
    tokenizer = Tokenizer.from_file(PATH)
    random.seed(3)
    letters = "ab 'sT\n\t\r\x1c\x85 　é1²,!_😀́ǅ"
    more = spark.createDataFrame([(100 + i, "".join(random.choices(letters, k=40))) for i in range(200)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").union(more)
    expected = Counter()
    for one, text in every.collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected[one, struct.pack(f"<{len(ids)}I", *ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    found = Counter((row.doc_id, bytes(row.ids), row.decoded) for row in bpe.round_trip(every, PATH, block_bytes=500).collect())
    assert found == expected
    assert bpe.round_trip(docs.where("false"), PATH).count() == 0


def test_repair_grammar_is_lossless():
    random.seed(5)
    for size, symbols in [(1, 1), (9, 1), (400, 2), (3000, 5), (5000, 70000)]:
        texts = [struct.pack(f"<{n}I", *random.choices(range(symbols), k=n)) for n in [size, 1, 2 * size]]
        payload = repair.pack(texts, least=2, most=3)
        shard = repair.Shard(payload)
        assert [shard.document(i) for i in range(3)] == texts
        for number, text in enumerate(texts):
            ids = list(struct.unpack(f"<{len(text) // 4}I", text))
            for start in {0, len(ids) // 3, len(ids) - 1}:
                for stop in {start, start + 1, start + 7, len(ids)}:
                    assert repair.Shard(payload).ids(number, start, stop) == ids[start:stop]
    assert len(repair.pack([struct.pack("<4000I", *[7] * 4000)], least=2)) < 400


def test_repair_sorts_and_searches_frequent_pairs_alone(monkeypatch):
    """Of the pairs in filled cells, only those in the cells of the chosen ones are searched for; ids come as arrays."""
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 40, 20_000).astype("<u4")
    searched, searchsorted = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda known, pairs, *more: searched.append(np.isin(pairs, known).mean()) or searchsorted(known, pairs, *more))
    payload = repair.pack([ids.tobytes()], least=8, most=20)
    assert searched and min(searched) > 0.9
    monkeypatch.undo()
    assert repair.Shard(payload).document(0) == ids.tobytes()
    assert isinstance(repair.encoder(public_tokenizers.path("byte_bpe_50k.json"))("some text"), np.ndarray)


def test_repair_files(docs):
    tokenizer = Tokenizer.from_file(PATH)
    archive = repair.write(docs, PATH, shard_ids=50, least=2, files=3)
    found = repair.read(archive).join(repair.shard_starts(archive), ["file", "shard"]).withColumn("start", F.col("shard_start") + F.col("offset")).orderBy("start").collect()
    start = 0
    rows = sorted(((row.doc_id, row.text) for row in docs.collect()), key=lambda row: (row[0] is not None, row[0] or 0))
    for (one, text), row in zip(rows, found, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.key, row.start, bytes(row.ids)) == (one, start, struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert repair.read(repair.write(docs.where("false"), PATH)).count() == 0


def katz_by_hand(texts: list[list[str]], learned: list[list[str]], order: int) -> list[float]:
    counts = [Counter() for _ in range(order + 1)]
    for words in learned:
        padded = ["<"] * (order - 1) + words + [">"]
        for n in range(1, order + 1):
            for at in range(order - 1, len(padded)):
                counts[n][tuple(padded[at - n + 1:at + 1])] += 1
    kept = []
    for n in range(order + 1):
        factors = katz.discounts(Counter(counts[n].values()))
        kept.append({gram: c * (factors[c - 1] if c <= len(factors) else 1) for gram, c in counts[n].items()})

    def total(grams: list) -> float:
        seen, left = sum(counts[len(g)][g] for g in grams), sum(kept[len(g)][g] for g in grams)
        return seen if seen - left > seen * 1e-12 else seen + 1

    everything = list(counts[1])
    types = {gram[0] for gram in everything}

    def probability(gram: tuple) -> float:
        if len(gram) == 1:
            whole = total(everything)
            return kept[1][gram] / whole if gram in kept[1] else 1 - sum(kept[1].values()) / whole
        after = [one for one in counts[len(gram)] if one[:-1] == gram[:-1]]
        if not after:
            return probability(gram[1:])
        if gram in counts[len(gram)]:
            return kept[len(gram)][gram] / total(after)
        free = 1 - sum(kept[len(gram)][one] for one in after) / total(after)
        return free / (1 - sum(probability(one[1:]) for one in after)) * probability(gram[1:])

    if order > 1:
        history = ("<",) * (order - 1)
        assert math.isclose(sum(probability((*history, word)) for word in [*types, "never seen"]), 1, rel_tol=1e-9)
    return [sum(math.log10(probability(tuple((["<"] * (order - 1) + words + [">"])[at - order + 1:at + 1]))) for at in range(order - 1, order + len(words))) for words in texts]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, order):
    random.seed(order)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(random.choices(words, [1 / (i + 1) for i in range(30)], k=random.randint(0, 25))) for _ in range(60)] + ["", "Unknown w1 unknown"]
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    scores, model = katz.score(frame, F.col("doc_id") % 4 != 1, order, block_bytes=200)
    split = [text.lower().split() for text in texts]
    expected = katz_by_hand(split, [one for i, one in enumerate(split) if i % 4 != 1], order)
    rows = {row.doc_id: row for row in scores.collect()}
    assert model.tokens == sum(len(one) + 1 for i, one in enumerate(split) if i % 4 != 1)
    for i, value in enumerate(expected):
        assert math.isclose(rows[i].score, value, rel_tol=1e-9) and rows[i].n_tokens == len(split[i]) + 1


def test_katz_discounts_with_groups_of_copies(spark):
    """Five copies of each of some texts lift n5, as in the given tables: the factors are Good-Turing's all the same, by a fit made here."""
    random.seed(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(random.choices(words, [1 / (i + 1) for i in range(3000)], k=30)) for _ in range(200)]
    texts += [f"{text} c{i} c{i}x c{i}y" for i, text in enumerate(texts[:20])] * 5
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id bigint, text string")
    _, model = katz.score(frame, F.lit(True), 2)
    learned = [["<", *text.split(), ">"] for text in texts]
    for n in (1, 2):
        grams = Counter(tuple(one[at - n + 1:at + 1]) for one in learned for at in range(1, len(one)))
        of_counts = Counter(grams.values())
        r = sorted(of_counts)
        assert 5 * of_counts[5] > 4 * of_counts[4]  # unsmoothed, the fourth factor is above one
        gaps = [((r[i + 1] if i + 1 < len(r) else 2 * r[i] - r[i - 1]) - (r[i - 1] if i else 0)) / 2 for i in range(len(r))]
        x, y = [math.log(c) for c in r], [math.log(of_counts[c] / gap) for c, gap in zip(r, gaps, strict=True)]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)
        smooth = {c: c**slope for c in range(1, 7)}
        common = 6 * smooth[6] / smooth[1]
        found = {row.c: row.d / row.c for row in model.table.where(F.col("n") == n).where("c <= 5").select("c", "d").distinct().collect()}
        assert sorted(found) == [1, 2, 3, 4, 5]
        for c, factor in found.items():
            expected = ((c + 1) * smooth[c + 1] / (c * smooth[c]) - common) / (1 - common)
            assert 0 < factor < 1 and math.isclose(factor, expected, rel_tol=1e-9) and abs(factor - (1 - 0.5 / c)) > 1e-3
    assert katz.discounts({}) == katz.discounts({1: 3, 2: 1}) == [1 - 0.5 / c for c in range(1, 6)]


def test_katz_sends_counts_and_sorts_pairs_as_one_number(monkeypatch):
    rng = np.random.default_rng(9)
    high, low = rng.integers(0, 50, 500), rng.integers(0, 2**20, 500)
    expected = sorted(zip(high.tolist(), low.tolist()))
    assert [(high[n], low[n]) for n in katz.pair_order(high, low)] == expected
    wide = high << 50
    assert [(wide[n], low[n]) for n in katz.pair_order(wide, low)] == [(a << 50, b) for a, b in expected]
    model = katz.Model(2)
    model.factors, model.denominator = [[], [0.4, 0.5, 0.6, 0.7, 0.8]], 1000.0
    pack = lambda values: katz.packed(np.array(values))
    table = katz.pa.table({
        "bucket": [0], "block": [1], "history": [katz.increasing(np.array([1, 1, 2]))], "word": [pack([3, 4, 3])], "counts": [pack([2, 1, 0])], "lower": [pack([7, 2, 0])],
    })
    rows = [row for row in katz.met_grams(table, 1, True, model).to_pylist() if row["kind"] == "history"]
    assert [(row["history"], row["c"]) for row in rows] == [(1, 3)] and math.isclose(rows[0]["lower"], 0.007 + 0.001)


def test_katz_odd_rows(docs):
    scores, model = katz.score(docs, F.col("doc_id") != 0)
    assert scores.count() == len(TEXTS) + 2 and scores.where("score IS NULL OR isnan(score) OR score > 0").count() == 0
    nothing, model = katz.score(docs, F.lit(False))
    assert model.tokens == 0 and nothing.where("score <> 0").count() == 0
    assert katz.score(docs.where("false"), F.lit(True))[0].count() == 0


def shingles(text: str | None, k: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def test_near_duplicates(spark, docs):
    random.seed(11)
    rows = []
    for _ in range(25):
        base = [f"v{random.randrange(400)}" for _ in range(random.randint(5, 60))]
        for _ in range(random.randint(1, 6)):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 4, 20])):
                copy[random.randrange(len(copy))] = f"v{random.randrange(400)}"
            rows.append((len(rows), " ".join(copy)))
    sets = [shingles(text, 2) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {row.doc_id: row for row in neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2).collect()}
    assert [(found[i].n_shingles, found[i].component_id) for i in range(len(rows))] == [(len(sets[i]), root(i)) for i in range(len(rows))]
    odd = {(row.doc_id, row.n_shingles, row.component_id) for row in neardup.groups(docs, k=2).collect()}
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3)} <= odd
    assert neardup.distinct_documents(docs).columns == docs.columns
    assert neardup.groups(docs.where("false")).count() == 0


def test_near_duplicates_whose_token_parities_differ(spark):
    """Eight of ten words in common; 29 of 128 parities of minwise values, once a bound at 27, differ."""
    words = [f"p52485x{j}" for j in range(10)]
    frame = spark.createDataFrame([(1, " ".join(words[:9])), (2, " ".join(words[1:]))], "doc_id bigint, text string")
    assert {row.component_id for row in neardup.groups(frame, k=1).collect()} == {1}


def test_decontamination(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([("a", item), ("b", "Cat sat"), ("c", None), ("d", "")], "item_id string, text string")
    more = spark.createDataFrame([(50, f"before {item.upper()}, after"), (51, item[:-12])], "doc_id bigint, text string")
    found = {row.doc_id: row for row in decontaminate.contamination(docs.select("doc_id", "text").union(more), items).withColumn("n", decontaminate.hit_words(F.col("hits"))).collect()}
    assert (found[50].n, found[50].item_ids) == (11, ["a"]) and (found[51].n, found[0].n_words, found[0].n) == (0, 0, 0)
    assert (found[7].n, found[7].item_ids) == (4, ["b"])
    assert decontaminate.clean(docs, items.where("false")).count() == docs.count()
    assert decontaminate.contamination(docs.where("false"), items).count() == 0


def test_decontamination_of_repeated_rows(spark):
    items = spark.createDataFrame([("a", "the cat sat"), ("b", "the cat sat"), ("c", "a dog")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "so the cat sat with a dog")] * 3 + [(2, "clean")] * 2 + [(None, None)] * 2 + [(4, "the cat sat")], "doc_id bigint, text string")
    found = decontaminate.contamination(docs, items).select("doc_id", decontaminate.hit_words(F.col("hits")).alias("n"), F.size("item_ids").alias("items"))
    assert Counter(map(tuple, found.collect())) == {(1, 5, 3): 3, (2, 0, 0): 2, (None, 0, 0): 2, (4, 3, 2): 1}


def test_top_k(spark):
    random.seed(2)
    vectors = [[random.uniform(-2, 2) for _ in range(8)] for _ in range(300)] + [None, [None] * 8, [float("nan")] * 8, [1.0] * 8, [1.0] * 8]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    whole = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v)}
    expected = set()
    for q in whole:
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ whole[v]), v) for v in whole if v != q)[:5]
            expected |= {(q, rank, v, -score) for rank, (score, v) in enumerate(best, 1)}
    assert {tuple(row) for row in topk.top_k(frame, F.col("vec_id") % 50 == 0, block_rows=64).collect()} == expected
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_keeps_every_finite_vector(spark):
    """Components of every size, ties, fewer candidates than k, columns with clashing names."""
    random.seed(6)
    vectors = {0: [40000.0, 1.0], 50: [1.0, 2.0], 51: [2.0, 2.0], 52: [33000.0, 0.0], 53: [2.0, 2.0], 100: [-4e6, 3.5], 101: [4e6, -2e6], 102: [0.0, -0.001], 150: [7.0]}
    vectors |= {i: [random.uniform(-10**random.randint(0, 6), 10**random.randint(0, 6)) for _ in range(2)] for i in range(200, 260)}
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors.items()], "vec_id bigint, embedding array<double>, dim int, part string, score int")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    expected = set()
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[v])), v) for v in whole if v != q and len(whole[v]) == len(whole[q]))[:5]
            expected |= {(q, rank, v, -score) for rank, (score, v) in enumerate(best, 1)}
    for block_rows in (8, 4096):
        assert {tuple(row) for row in topk.top_k(frame, F.col("vec_id") % 50 == 0, block_rows=block_rows).collect()} == expected
    huge = spark.createDataFrame([(0, [1e15, 1e15]), (1, [1e15, 1e15])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(huge, F.col("vec_id") == 0).collect()


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/ b", "é"), (2, None, "é"), (3, "u", None), (4, "v", "")], "page_id bigint, url string, html string")
    archive = warc.write(pages)
    found = {row.key: row for row in warc.catalogue(archive).collect()}
    assert [(found[i].record_type, found[i].refers_to, found[i].payload_bytes) for i in (1, 2, 3, 4)] == [("revisit", 2, 2), ("response", None, 2), ("revisit", 4, 0), ("response", None, 0)]
    assert {row.key: bytes(row.payload) for row in warc.records(archive).collect()} == {1: "é".encode(), 2: "é".encode(), 3: b"", 4: b""}
    assert warc.catalogue(warc.write(pages.where("false"))).count() == 0
    damaged = warc.Archive(archive.headers, archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))))
    with pytest.raises(Exception, match="damaged payload"):
        warc.catalogue(damaged).collect()
    shorter = warc.Archive(archive.headers.withColumn("header", F.encode(F.replace(F.decode("header", "UTF-8"), F.lit("Content-Length: 2"), F.lit("Content-Length: 3")), "UTF-8")), archive.payloads)
    with pytest.raises(Exception, match="header and record differ"):
        warc.catalogue(shorter).collect()


def test_language_and_quality(spark, docs):
    english, german = "the house is near the river and we like it", "das Haus steht nahe am Fluss und wir mögen es"
    labelled = spark.createDataFrame([(f"{english} {i}", "en") for i in range(20)] + [(f"{german} {i}", "de") for i in range(20)], "text string, lang string")
    found = {row.doc_id: row for row in language_id.identify(spark.createDataFrame([(1, english), (2, german), (3, None), (4, "123 !")], "doc_id bigint, text string"), language_id.train(labelled)).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    odd = spark.createDataFrame([(1, "\u0301\u0301"), (2, ""), (3, f"{english} " * 4000), (3, english)], "doc_id bigint, text string")
    model = language_id.train(labelled)
    assert sorted((row.doc_id, row.lang_pred) for row in language_id.identify(odd, model).collect()) == [(1, "und"), (2, "und"), (3, "en"), (3, "en")]
    assert language_id.identify(odd, language_id.train(labelled.where("false"))).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert {(row.lang_pred, row.score) for row in language_id.identify(odd.where("doc_id = 3"), language_id.train(labelled.where("lang = 'de'"))).collect()} == {("de", 1.0)}
    assert language_id.identify(odd.where("false"), model).count() == 0
    good, bad = "A plain sentence with several different words about number {}.", "BUY!! BUY!! {} | NOW!! | $$ 000 {} !!"
    rows = [(i, (good if i % 2 else bad).format(i, i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = frame.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).where("doc_id < 100")
    scored = quality.score(frame, quality.train(frame, labels))
    assert scored.where("doc_id >= 100 AND predicted = doc_id % 2").count() >= 95
    assert quality.score(docs, quality.train(docs, labels.where("false"))).where("score BETWEEN 0 AND 1").count() == docs.count()


def test_digest_of_query_columns(spark):
    row = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    ids = bpe.round_trip(row, PATH).select(F.sha2("ids", 256).alias("h"), "ids").first()
    assert ids.h == hashlib.sha256(bytes(ids.ids)).hexdigest()


def test_katz_keeps_small_numbers_in_few_bytes():
    """A block's places were held in 64-bit numbers, and shares of all orders beside them."""
    rng = np.random.default_rng(5)
    words = rng.integers(1, 2**40, 300).tolist()
    places = rng.integers(0, 300, 5000)
    row = {
        "block": 1, "keys": [{"key": 1, "learn": True}, {"key": 2, "learn": False}], "words": words,
        "places": blocks.packed(places), "counts": blocks.packed(np.array([4000, 1000])),
    }
    order = np.argsort(np.append(np.array(words, np.uint64), katz.END), kind="stable")
    held = katz.Block(row, katz.Model(2), 4).word_counts()[order]
    model = katz.Model(2)
    model.tokens, model.types, model.documents, model.denominator, model.factors = 4001, 301, 1, 4001.0, [[], [0.5] * 5, [0.5] * 5]
    answer = [{"counts": katz.packed(held), "numbers": katz.packed(np.arange(1, 302))}]
    block = katz.Block({**row, "answer1": answer}, model, 4)
    assert sum(x.dtype.itemsize for x in (block.token, block.document, block.number[0], block.count[0])) <= 16
    assert block.total[0].strides == block.weight[0].strides == (0,)
    _, which, _, history, word, _ = block.grams(2)
    assert len(set(zip(history.tolist(), word.tolist()))) == len(history) == which.max() + 1
    wide = katz.narrow(np.array([1 << 40, -1]))
    assert wide.dtype == np.int64 and wide.tolist() == [1 << 40, -1] and katz.narrow(np.array([7, -1])).dtype == np.int32


def test_results_of_a_bucket_travel_in_parts(monkeypatch):
    """A bucket's n-grams went out as one batch with a column of nulls for each that they lack."""
    monkeypatch.setattr(katz, "MET_ROWS", 4)
    table = katz.met_table(10, kind=katz.pa.repeat("gram", 10), c=np.arange(10))
    assert [batch.num_rows for batch in table.to_batches()] == [4, 4, 2]
    assert table.column("c").to_pylist() == list(range(10)) and table.column("n1").null_count == 10
    assert katz.met_table(0, kind=[]).num_rows == 0


def test_operators_bound_the_batches_that_go_to_python(spark, docs):
    """A batch of documents was as large as Spark's default allows, whatever the length of the texts."""
    old = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        for step in (lambda: stage(docs, "bound"), lambda: bucketed(docs, "bound", "doc_id")):
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
            assert step().count() == docs.count()
            assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 2 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", old)


def test_encoder_keeps_no_words_of_other_tasks():
    """Words are dealt by their hash, so those of an ended task never come again; they stayed in memory beside the next task's blocks."""
    encode = bpe.Encoder(PATH)
    assert encode("some words here") and len(encode) == 3
    assert bpe.of_task(encode) is encode and not encode
