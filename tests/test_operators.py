from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gazette.operators import carry, dedup, enrich, search, status, upsert
from gazette.operators.search import SearchSpec
from gazette.schemas import FF_LOG, FF_PAYLOAD, FF_STICKY, struct
from gazette.sources.config import EXTRACTION_DOMAINS, EXTRACTION_TEXTS, domain_frame, load_domains, load_preferences, local_frame

DAY = dt.datetime(2026, 8, 1)


def frame(spark, rows, fields, **nested):
    return local_frame(spark, rows, struct(fields, **nested))


def plan_of(frame, capsys):
    frame.explain()
    return capsys.readouterr().out


def test_first_writer_and_insert(spark, capsys):
    batch = frame(spark, [("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), ("c", 4, "w")], "url_hash string, seq int, label string")
    stored = frame(spark, [("c",), ("q",)], "url_hash string")
    fresh = dedup.insert_if_absent(batch, stored, "url_hash", "seq")
    assert sorted(map(tuple, fresh.collect())) == [("a", 1, "x"), ("b", 3, "z")]
    summary = dedup.insert_summary(batch, stored, "url_hash").first()
    assert (summary.inserted, summary.skipped) == (2, 2)
    firsts = dedup.first_writer(batch, "url_hash", "seq")
    assert sorted(map(tuple, dedup.absent_from_large(firsts, stored, "url_hash").collect())) == sorted(map(tuple, fresh.collect()))
    assert [row.url_hash for row in dedup.duplicate_keys(batch, "url_hash").collect()] == ["a"]
    plan = plan_of(fresh, capsys)
    assert "LeftAnti" in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_insert_against_model(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdefgh"), seq) for seq in rng.sample(range(1000), 200)]
    known = ["a", "c", "z"]
    got = dedup.insert_if_absent(frame(spark, rows, "k string, seq int"), frame(spark, [(k,) for k in known], "k string"), "k", "seq")
    want = {}
    for key, seq in sorted(rows, key=lambda row: row[1]):
        if key not in known:
            want.setdefault(key, seq)
    assert {row.k: row.seq for row in got.collect()} == want


def ff_row(uid, minute, ord_, impact="low", actual=None, forecast=None):
    at = DAY + dt.timedelta(minutes=minute)
    return (uid, "forexfactory", "CPI", DAY, "8:00am", impact, "EUR", actual, forecast, None, at, ord_)


def test_sticky_upsert(spark):
    log = [
        ff_row("u", 0, 0, forecast="0.2%"), ff_row("u", 1, 0, "high", actual="0.3%"), ff_row("u", 2, 0, "medium", actual=""),
        ff_row("u", 2, 1, "medium", forecast=None), ff_row("v", 5, 0),
    ]
    for rows in (log, log[::-1], log + log):
        view = upsert.latest(local_frame(spark, rows, FF_LOG), "source_uid", FF_PAYLOAD, FF_STICKY)
        u, v = view.orderBy("source_uid").collect()
        assert (u.impact, u.actual, u.forecast, u.previous) == ("medium", "0.3%", "0.2%", None)
        assert (u.first_seen, u.updated_at) == (DAY, DAY + dt.timedelta(minutes=2))
        assert (v.actual, v.first_seen) == (None, DAY + dt.timedelta(minutes=5))


def test_overwrite_takes_nulls_and_compaction_keeps_the_view(spark):
    rng = random.Random(5)
    values = [None, "", "1%", "2%"]
    rows = [ff_row(rng.choice("uvw"), minute, 0, rng.choice(["low", "high"]), rng.choice(values), rng.choice(values)) for minute in range(40)]
    whole = upsert.latest(local_frame(spark, rows, FF_LOG), "source_uid", FF_PAYLOAD, FF_STICKY)
    old, new = local_frame(spark, rows[:25], FF_LOG), local_frame(spark, rows[25:], FF_LOG)
    mixed = upsert.compact(old, "source_uid", FF_PAYLOAD, FF_STICKY).unionByName(new, allowMissingColumns=True)
    again = upsert.latest(mixed, "source_uid", FF_PAYLOAD, FF_STICKY)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.collect()))
    model = {}
    for row in rows:
        entry = model.setdefault(row[0], {"actual": None, "forecast": None})
        entry.update(impact=row[5], **{k: v for k, v in (("actual", row[7]), ("forecast", row[8])) if v})
    assert {r.source_uid: {"actual": r.actual, "forecast": r.forecast, "impact": r.impact} for r in whole.collect()} == model
    plain = upsert.latest(frame(spark, [("k", "a", DAY, 0), ("k", None, DAY, 1)], "k string, url string, seen_at timestamp, batch_ord int"), "k", ["url"])
    assert plain.first().url is None


def test_upsert_counts(spark):
    stored = upsert.latest(local_frame(spark, [ff_row("u", 0, 0, actual="1%"), ff_row("v", 0, 0)], FF_LOG), "source_uid", FF_PAYLOAD, FF_STICKY)
    batch = local_frame(spark, [ff_row("u", 9, 0, actual=""), ff_row("v", 9, 0, "high"), ff_row("w", 9, 0)], FF_LOG)
    assert tuple(upsert.upsert_counts(stored, batch, "source_uid", FF_PAYLOAD, FF_STICKY).first()) == (1, 1, 1, 3)


def test_set_field(spark):
    table = frame(spark, [("a", None, None), ("b", "old", None), ("c", None, None)], "k string, title_en string, updated_at timestamp")
    values = frame(spark, [("a", " new "), ("c", " "), ("z", "x")], "k string, title_en string")
    rows = {row.k: row for row in upsert.set_field(table, values, "k", "title_en", F.lit(DAY)).collect()}
    assert (rows["a"].title_en, rows["a"].updated_at) == ("new", DAY)
    assert (rows["b"].title_en, rows["b"].updated_at, rows["c"].title_en) == ("old", None, None)


@pytest.mark.parametrize("chunk", [1, 3, 7, None])
def test_carry_forward(spark, chunk):
    rng = random.Random(11)
    rows = [(page, pos, rng.choice([None, None, None, f"d{pos}"])) for page in "ab" for pos in range(30)]
    filled = carry.carry_forward(frame(spark, rows, "page string, pos int, v string"), "page", "pos", "v", chunk)
    last, want = {}, []
    for page, pos, value in rows:
        last[page] = value or last.get(page)
        want.append((page, pos, last[page]))
    assert sorted(map(tuple, filled.collect()), key=str) == sorted(want, key=str)


RELEASES = [
    ("h1", "istat", "GDP", "positive", dt.datetime(2026, 8, 1)), ("h2", "istat", "GDP", "negative", dt.datetime(2026, 8, 2, 0, 0)),
    ("h3", "ine", "Construction", "positive", dt.datetime(2026, 8, 2, 23, 59)), ("h4", "ine", "GDP", "neutral", None),
    ("h5", "cso", "GDP", "positive", dt.datetime(2026, 8, 3)),
]


@pytest.mark.parametrize("spec, want", [
    (SearchSpec(), ["h5", "h3", "h2", "h1", "h4"]),
    (SearchSpec(limit=2), ["h5", "h3"]),
    (SearchSpec({"publisher": "all", "topic": [], "sentiment": None, "nothing": ["x"]}), ["h5", "h3", "h2", "h1", "h4"]),
    (SearchSpec({"publisher": ["istat", "cso"], "sentiment": "positive"}), ["h5", "h1"]),
    (SearchSpec(date_from=dt.datetime(2026, 8, 1), date_to=dt.datetime(2026, 8, 2)), ["h1"]),
    (SearchSpec(date_from=dt.datetime(2026, 8, 2), date_to=dt.datetime(2026, 8, 2), inclusive_to=True), ["h3", "h2"]),
])
def test_search(spark, spec, want):
    rows = frame(spark, RELEASES, "url_hash string, publisher string, topic string, sentiment string, published timestamp")
    assert [row.url_hash for row in search.search(rows, spec, search.PROCESSED_FIELDS).collect()] == want
    if spec.limit == 100:
        assert search.count_matching(rows, spec, search.PROCESSED_FIELDS).first().total == len(want)


def test_search_plan(spark, tmp_path, capsys):
    rows = frame(spark, RELEASES, "url_hash string, publisher string, topic string, sentiment string, published timestamp")
    rows.write.parquet(str(tmp_path / "t"))
    found = search.search(spark.read.parquet(str(tmp_path / "t")), SearchSpec({"topic": ["GDP"]}, DAY), search.PROCESSED_FIELDS)
    plan = plan_of(found.select("url_hash", "published"), capsys)
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(published" in plan and "EqualTo(topic,GDP)" in plan


def test_calendar_search(spark):
    office = frame(spark, [("istat", "CPI (final)", DAY, "n1"), ("ine", "GDP", DAY, "n2"), ("ine", "GDP late", dt.datetime(2026, 8, 31, 23, 59, 59), "n3")],
                   "source string, title string, release_dt timestamp, source_uid string")
    market = frame(spark, [("CPI m/m", DAY, "f1", "high"), ("PMI", DAY - dt.timedelta(days=40), "f2", "low")],
                   "title string, release_dt timestamp, source_uid string, impact string")
    view = search.calendar_view(office, market)

    def uids(**filters):
        return [row.source_uid for row in search.search_calendar(view, **filters).collect()]

    assert uids() == ["f2", "n1", "n2", "f1", "n3"]
    assert uids(limit=2) == ["f2", "n1"]
    assert uids(source="forexfactory") == ["f2", "f1"] and uids(source="ine") == ["n2", "n3"]
    assert uids(q="cpi|pmi") == ["f2", "n1", "f1"]
    assert uids(q="cpi (", mode="literal") == ["n1"]
    assert uids(date_from=DAY, date_to=dt.datetime(2026, 8, 31)) == ["n1", "n2", "f1", "n3"]
    assert [tuple(row) for row in search.calendar_sources_present(view).collect()] == [
        ("ine", "INE", False), ("istat", "Istat", False), ("forexfactory", "ForexFactory", True)]


def test_default_calendar_range():
    as_of = dt.date(2026, 1, 15)
    assert search.default_calendar_range(as_of) == (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 31))
    assert search.default_calendar_range(as_of, q="cpi") == (dt.datetime(2025, 12, 1), None)
    assert search.default_calendar_range(as_of, date_to="2026-02-01") == (None, dt.datetime(2026, 2, 1))
    assert search.default_calendar_range(as_of, date_from="bad") == (None, None)
    assert search.parse_day("2026-02-30") is None and search.parse_day("") is None


def test_pending_and_backlog(spark):
    raw = frame(spark, [("a", 3), ("b", 1), ("c", 2), ("d", 4)], "url_hash string, ingest_seq int")
    done = frame(spark, [("b",), ("x",)], "url_hash string")
    assert [row.url_hash for row in enrich.first_pending(raw, done, 2).collect()] == ["c", "a"]
    assert tuple(enrich.backlog(raw, done).first()) == (4, 2, 3)


def answer(**changes):
    return {"topic": "GDP", "country": "Italy", "sentiment": "neutral", "title_en": "t", "summary_en": "s", "key_figures": "", **changes}


def test_choose_answers(spark):
    attempts = [
        ("a", "p", "one", 0, answer(topic="Invalid topic"), None), ("a", "q", "two", 1, answer(), None), ("a", "r", "three", 2, answer(title_en="later"), None),
        ("b", "p", "one", 0, None, "Timeout: x"), ("c", "p", "one", 0, answer(summary_en=None), None), ("d", None, None, None, None, "no_answer"),
    ]
    rows = local_frame(spark, attempts, enrich.ATTEMPTS)
    chosen = {row.url_hash: row for row in enrich.choose_answers(rows, EXTRACTION_DOMAINS, EXTRACTION_TEXTS).collect()}
    assert chosen["a"].chosen.model == "two" and chosen["a"].fault is None
    assert [chosen[key].fault for key in "bcd"] == ["Timeout: x", "missing:summary_en", "no_answer"]
    assert tuple(status.attempt_totals(enrich.choose_answers(rows, EXTRACTION_DOMAINS, EXTRACTION_TEXTS)).first()) == (4, 1, 3)
    first = enrich.choose_answers(rows.where("rank = 0"), EXTRACTION_DOMAINS, EXTRACTION_TEXTS).where("url_hash = 'a'").first()
    assert first.fault == "domain:topic"


def test_answer_guard(spark):
    rows = local_frame(spark, [], enrich.ATTEMPTS)
    enrich.guard_answer_schema(rows)
    with pytest.raises(ValueError, match="url"):
        enrich.guard_answer_schema(rows.withColumn("answer", F.struct("answer.*", F.lit("u").alias("url"))))
    with pytest.raises(ValueError, match="topic"):
        enrich.guard_answer_schema(rows.withColumn("answer", F.col("answer").dropFields("topic")))


def test_model_cascade(spark):
    def generate(prompt, provider, model):
        if model == "down" or "fail" in prompt:
            raise RuntimeError("no")
        return {"topic": "GDP", "country": "Italy", "sentiment": "neutral", "title_en": prompt, "summary_en": "s", "key_figures": "k"}

    prompts = frame(spark, [("a", "hello"), ("b", "fail")], "url_hash string, prompt string")
    attempts = enrich.model_cascade(generate, [("p", "down"), ("p", "up")])(prompts)
    chosen = {row.url_hash: row for row in enrich.choose_answers(attempts, EXTRACTION_DOMAINS, EXTRACTION_TEXTS).collect()}
    assert chosen["a"].chosen.model == "up" and chosen["a"].chosen.answer.title_en == "hello"
    assert chosen["b"].chosen is None and chosen["b"].fault == "RuntimeError: no"


def test_model_cascade_asks_once_and_counts_what_failed(spark, tmp_path, monkeypatch):
    asked = str(tmp_path / "asked")

    def generate(prompt, provider, model):
        with open(asked, "a") as file:
            file.write(f"{prompt} {model}\n")
        if model == "down":
            raise RuntimeError("no")
        return {"topic": "GDP", "country": "Italy", "sentiment": "neutral", "title_en": prompt, "summary_en": "s", "key_figures": "k"}

    prompts = frame(spark, [("a", "hello"), ("b", "world")], "url_hash string, prompt string").coalesce(1)
    attempts = enrich.model_cascade(generate, [("p", "down"), ("p", "up")])(prompts)
    failures = F.count("error").alias("failures")
    rows = enrich.choose_answers(attempts, EXTRACTION_DOMAINS, EXTRACTION_TEXTS, failures).collect()
    assert sorted((row.url_hash, row.chosen.model, row.fault, row.failures) for row in rows) == [("a", "up", None, 1), ("b", "up", None, 1)]
    with open(asked) as file:
        assert sorted(file) == ["hello down\n", "hello up\n", "world down\n", "world up\n"]
    monkeypatch.setattr(enrich.threading, "Thread", None)
    assert enrich.timed(lambda: {"x": 1}, enrich.threading.Semaphore(1), None) == {"x": 1}


def test_keyword_tagger(spark):
    text = "Title: Inflazione in Italia\n\nItalian HICP inflation rose to 2.1% and then 2.1%, up from -0,4 %."
    row = enrich.keyword_tagger(frame(spark, [("a", text)], "url_hash string, prompt string")).first().answer
    assert (row.topic, row.country, row.sentiment, row.title_en) == ("Consumer prices", "Italy", "positive", "Inflazione in Italia")
    assert row.key_figures == "2.1%; -0,4 %"


def test_domains_and_preferences(spark, tmp_path):
    model = tmp_path / "model.py"
    model.write_text("from typing import Literal\nclass LLMExtraction:\n    topic: Literal['b', 'a']\n    title_en: str\n")
    assert load_domains(model) == {"topic": ["b", "a"]}
    definitions = {row.field: row.choices for row in search.filter_definitions(domain_frame(spark)).collect()}
    assert definitions == EXTRACTION_DOMAINS
    preferences = load_preferences(spark).orderBy("rank").collect()
    assert len(preferences) == 9 and preferences[0]["rank"] == 0


def test_status(spark):
    log = frame(spark, [("calendar", DAY, "partial", "a"), ("calendar", DAY + dt.timedelta(hours=1), "ok", "1 releases")],
                "key string, last_run timestamp_ntz, status string, details string")
    keys = frame(spark, [("press_releases",), ("calendar",)], "key string")
    rows = {row.key: row for row in status.status_view(status.latest_status(log), keys).collect()}
    assert tuple(rows["calendar"])[1:] == ("2026-08-01 01:00 UTC", "ok", "1 releases", "ok")
    assert tuple(rows["press_releases"])[1:] == ("never", "never", "", "")
    texts = frame(spark, [(0, 0), (5, 2)], "n int, e int").select(
        status.status_details(F.col("n"), F.col("e"), "new releases", "agency").alias("t"), status.run_status(F.col("e")).alias("s"))
    assert sorted(map(tuple, texts.collect())) == [("0 new releases", "ok"), ("5 new releases, 2 agency errors", "partial")]
