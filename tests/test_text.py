from __future__ import annotations

import datetime as dt
import re
import time

import pandas as pd
from pyspark.sql import functions as F

from gazette import schemas
from gazette.functions import display, htmltext, text
from gazette.operators.enrich import page_texts, prompt_text
from gazette.schemas import struct
from gazette.session import BATCH_BYTES, BATCH_SETTING, prepare, size_of
from gazette.sources.config import local_frame


def test_white_space_is_pythons(spark):
    rows = [(f"a{chr(code)}{chr(code)}b{chr(code)}",) for code in [*range(1, 0x3100), 0xFEFF]]
    got = local_frame(spark, rows, struct("x string")).select(
        "x", text.collapse_space(F.col("x")).alias("collapsed"), F.expr(text.strip_space("x")).alias("stripped")
    )
    assert [row.x for row in got.collect() if row.collapsed != re.sub(r"\s+", " ", row.x).strip() or row.stripped != row.x.strip()] == []


def test_fallbacks_and_truncation(spark):
    frame = local_frame(spark, [("", "b", "x" * 101), (None, "", "é" * 100)], struct("a string, b string, c string"))
    first, second = frame.select(
        text.first_nonblank(F.col("a"), F.col("b")).alias("s"), text.truncate(F.col("c"), 100).alias("t"),
        text.title_or_placeholder(F.col("a")).alias("title"),
    ).collect()
    assert (first.s, second.s) == ("b", "")
    assert first.t == "x" * 100 + " […]" and second.t == "é" * 100
    assert {first.title, second.title} == {"(untitled)"}


PAGE = """<html lang="it"><head><title> A &amp; B </title><style>p{}</style></head><body><nav>menu</nav><!-- <p>no</p> -->
<div class="ad">buy</div><article><h1>Head</h1><p>One &eacute; <b>two</b></p><table><tr><td>cell</td></tr></table>
<script>var x = "<p>";</script></article><footer>foot</footer><p>outside</p></body></html>"""


def test_page_text(spark):
    pages = local_frame(spark, [("u", PAGE), ("v", "<p>plain</p>"), ("w", "")], schemas.LANDING_PAGE)
    titled = htmltext.with_page_title(htmltext.with_main_text(pages, "html", "main"), "html", "title")
    rows = {row.url: row for row in titled.collect()}
    assert (rows["u"].main, rows["u"].title) == ("Head One é two", "A & B")
    assert (rows["v"].main, rows["w"].main) == ("plain", "")
    cut = {row.url: row.page_text for row in page_texts(pages, 6).collect()}
    assert cut == {"u": "Head O […]", "v": "plain", "w": ""}


def test_prompt(spark):
    rows = local_frame(spark, [("t", "page", "s"), ("t", "", "s"), ("t", None, None)], struct("t string, p string, s string"))
    prompts = [row.x for row in rows.select(prompt_text(F.col("t"), F.col("p"), F.col("s")).alias("x")).collect()]
    assert prompts == ["Title: t\n\npage", "Title: t\n\ns", "Title: t\n\n"]


def test_view_columns(spark):
    rows = local_frame(spark, [("https://a", "istat", dt.datetime(2026, 8, 14, 12)), ("javascript:x", "other", None), (None, None, None)],
                       struct("url string, source string, stamp timestamp"))
    views = rows.select(
        display.safe_link(F.col("url")).alias("link"), display.source_name("source").alias("name"),
        display.stamp_text(F.col("stamp")).alias("stamp"), display.day_text(F.col("stamp")).alias("day"),
        display.clock_text(F.col("stamp")).alias("clock"), display.sentiment_bucket(F.col("source")).alias("sentiment"),
        display.translated_title(F.col("source"), F.lit("istat")).alias("english"), display.publisher_label(F.lit(""), F.col("source")).alias("label"),
    ).collect()
    assert [tuple(row) for row in views] == [
        ("https://a", "Istat", "2026-08-14 12:00", "Fri Aug 14", "12:00 UTC", "neutral", None, "istat"),
        ("#", "other", "", "", "", "neutral", "istat", "other"), ("#", None, "", "", "", "neutral", None, None),
    ]


def test_main_text_nests_and_is_linear():
    nested = "<table><tr><td><table>a</table>b</td></tr></table>keep<div class='ad'><div>c</div>d</div><nav>open"
    assert htmltext.main_fragment(nested).split() == ["keep", "open"]
    article = "<div>x<article>one<form><form>f</form></form> two<script>if (a < b) '<div>'</script></article></div>y"
    assert htmltext.main_fragment(article).split() == ["one", "two"]
    assert htmltext.main_fragment("") == "" and htmltext.main_fragment("a < b") == "a < b"
    started = time.perf_counter()
    for mark in ("<form>", "<!--", "<", "<script>", "</div>"):
        htmltext.main_fragment(mark * 20_000)
    assert time.perf_counter() - started < 5


def test_batches_to_python_are_bounded_by_bytes_and_a_page_meets_one_worker(spark, capsys):
    assert [size_of(text) for text in ("67108864b", "64m", "1k", "5", "1gb")] == [1 << 26, 1 << 26, 1024, 5, 1 << 30]
    prepare(spark)

    @F.pandas_udf("long")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    pages = spark.range(0, 400, 1, 1).selectExpr("id", "concat('<p>a &amp;amp; b', repeat(' x', 50000)) AS html")
    assert pages.select(held("html").alias("n")).agg(F.max("n")).first()[0] < 2 * BATCH_BYTES
    small = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, "64k")
    prepare(spark)
    assert spark.conf.get(BATCH_SETTING) == "64k"
    spark.conf.set(BATCH_SETTING, small)
    texts = htmltext.with_main_text(pages, "html", "body")
    assert texts.first().body == "a &amp; b" + " x" * 50000
    texts.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
