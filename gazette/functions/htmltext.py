"""HTML to text.

``plain_text`` joins text nodes after trimming each one, inside the JVM. ``with_main_text`` is a rule of our own that prefers
precision: cut boilerplate, tables, comments and advert blocks with all that is nested in them, prefer the article or main
element, then drop the remaining tags. It reads a page's tags once, in Arrow batches, so its time grows with the page alone.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.sqltext import group, raw
from gazette.functions.text import clean_text, collapse_space, strip_space

BOILERPLATE = [
    "head", "script", "style", "noscript", "template", "svg", "iframe", "nav", "header", "footer", "aside", "form",
    "button", "table",
]
TAG = r"(?s)<(?:!--.*?--|[^>]*)>"
NBSP = "(?i)&(?:nbsp|#160|#xa0);"


ARTICLES = ["article", "main"]
NESTED = {*BOILERPLATE, *ARTICLES, "div"}
TAG_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9-]*")
ADVERT = re.compile(r"""\bclass\s*=\s*["']ad["']""", re.IGNORECASE)
RAW_END = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in ("script", "style")}


def with_class(name: str, tag: str = "[a-zA-Z][a-zA-Z0-9]*") -> str:
    """Pattern for an opening tag that carries a class; group 1 is the tag name."""
    token = name.replace("-", r"\-")
    return rf"""<({tag})\b[^>]*?\bclass\s*=\s*["'](?:[^"']*\s)?{token}(?:\s[^"']*)?["'][^>]*>"""


def element_with_class(name: str, tag: str = "[a-zA-Z][a-zA-Z0-9]*") -> str:
    """Pattern for a whole element with a class; group 2 is its inner HTML."""
    return rf"(?is){with_class(name, tag)}(.*?)</\1\s*>"


def plain_text(fragment: str) -> str:
    """Text nodes trimmed and joined without a separator, entities still in place; SQL text in and out."""
    spaced = f"regexp_replace({fragment}, {raw(NBSP)}, '\\u00a0')"
    return f"array_join(transform(split({spaced}, {raw(TAG)}), node -> {strip_space('node')}), '')"


def inner_html(fragment: str, name: str, tag: str = "[a-zA-Z][a-zA-Z0-9]*") -> str:
    return group(fragment, element_with_class(name, tag), 2)


def tags_of(html: str) -> list[tuple[int, int, str]]:
    """Start, end and name (``/name`` of an end tag, empty for a comment) of every tag; a search that fails once is not made again."""
    tags, at, endless = [], 0, set()
    while (start := html.find("<", at)) >= 0:
        if "comment" not in endless and html.startswith("<!--", start):
            if (end := html.find("-->", start + 4)) >= 0:
                tags.append((start, end + 3, ""))
                at = end + 3
                continue
            endless.add("comment")
        if (end := html.find(">", start)) < 0:
            break
        found = TAG_NAME.match(html, start + 1)
        name = found.group().lower() if found else ""
        tags.append((start, end + 1, name))
        at = end + 1
        if name in RAW_END and name not in endless:
            if close := RAW_END[name].search(html, at):
                at = close.start()
            else:
                endless.add(name)
    return tags


def elements_of(tags: list[tuple[int, int, str]]) -> dict[int, int]:
    """Number of the end tag by that of its start tag; an element that its parent's end finds open has none."""
    ends, opened, waiting = {}, [], dict.fromkeys(NESTED, 0)
    for number, (_, _, name) in enumerate(tags):
        if name in NESTED:
            opened.append(number)
            waiting[name] += 1
        elif waiting.get(name[1:]) and name[0] == "/":
            closed = ""
            while closed != name[1:]:
                last = opened.pop()
                closed = tags[last][2]
                waiting[closed] -= 1
            ends[last] = number
    return ends


def main_fragment(html: str) -> str:
    """Text of the main part with a space for each tag and each cut; entities stay."""
    tags = tags_of(html)
    ends = elements_of(tags)
    texts, at, number, until = [], 0, 0, len(tags)
    chosen = False
    while number < until:
        start, end, name = tags[number]
        texts.append(html[at:start])
        if number in ends:
            last = ends[number]
            if name in BOILERPLATE or (name == "div" and ADVERT.search(html, start, end)):
                number, end = last, tags[last][1]
            elif name in ARTICLES and not chosen and tags[last][0] > end:
                texts, until, chosen = [], last, True
        at = end
        number += 1
    texts.append(html[at:tags[until][0] if chosen else len(html)])
    return " ".join(texts)


@F.pandas_udf(T.StringType())
def main_texts(pages: pd.Series) -> pd.Series:
    """Fragments with their entities decoded by the same worker: a second step in Python would be a second worker for each task."""
    return pages.map(lambda page: unescape(main_fragment(page)), na_action="ignore")


def with_main_text(rows: DataFrame, html: str, name: str) -> DataFrame:
    """Add the main text of a page: no boilerplate, comments, tables or adverts; white space collapsed."""
    return rows.withColumn(name, main_texts(F.col(html))).withColumn(name, collapse_space(F.col(name)))


def with_page_title(rows: DataFrame, html: str, name: str) -> DataFrame:
    return clean_text(rows.withColumn(name, F.expr(group(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))), name)


def page_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([a-z-]+)""", 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
