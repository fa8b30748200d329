"""Text cleaning, fallbacks and truncation."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's \s matches and str.strip cuts, once as a class for patterns and once as a
# SQL literal for trims. Single Latin-1 characters become one bit set and the rest is tested only inside its range, which
# is several times faster than Java's Unicode \s.
SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
SPACE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE_CHARS = "'" + "".join(f"\\u{code:04x}" for code in SPACE_CODES) + "'"
# Control characters XML 1.0 does not allow.
XML_ILLEGAL = "[" + "".join(rf"\x{code:02x}" for code in range(0x20) if chr(code) not in "\t\n\r") + r"\x{fffe}\x{ffff}]"
BODY_HEAD = SPACE_CHARS[:-1] + r"\ufeff'"
TRUNCATION_MARK = " […]"
UNTITLED = "(untitled)"


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _named_entities_to_chars(text: pd.Series) -> pd.Series:
    def replace(match):
        name = match.group(0)
        return name if name in ("&amp;", "&lt;", "&gt;", "&quot;", "&apos;") else html.unescape(name)

    return text.str.replace(r"&[A-Za-z][A-Za-z0-9]*;", replace, regex=True)


def decode_entities(rows: DataFrame, *names: str) -> DataFrame:
    """HTML entities to characters in the named columns; only texts that hold an ampersand travel to Python.

    Works on columns and not on expressions, so that an expensive text is computed once and not once per mention.
    """
    decoded = {name: _unescape(F.expr(f"if(contains(`{name}`, '&'), `{name}`, NULL)")) for name in names}
    return rows.withColumns({name: F.coalesce(text, F.col(f"`{name}`")) for name, text in decoded.items()})


def with_xml_safe(rows: DataFrame, name: str) -> DataFrame:
    """Cut leading space and illegal characters, and turn HTML-only named entities into characters."""
    trimmed = rows.withColumn(name, F.regexp_replace(F.expr(f"trim(LEADING {BODY_HEAD} FROM {name})"), XML_ILLEGAL, ""))
    html_only = F.col(name).rlike(r"&(?!(?:amp|lt|gt|quot|apos);)[A-Za-z][A-Za-z0-9]*;")
    return trimmed.withColumn(name, F.coalesce(_named_entities_to_chars(F.when(html_only, F.col(name))), F.col(name)))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip_space(text: str) -> str:
    """Trim white space at both ends and keep the inside; SQL text in and out."""
    return f"trim(BOTH {SPACE_CHARS} FROM {text})"


def clean_text(rows: DataFrame, *names: str) -> DataFrame:
    """Entities to characters, then white-space runs to one space, in the named columns."""
    return decode_entities(rows, *names).withColumns({name: collapse_space(F.col(f"`{name}`")) for name in names})


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def title_or_placeholder(title: Column) -> Column:
    return F.coalesce(blank_to_null(title), F.lit(UNTITLED))


def first_nonblank(*texts: Column) -> Column:
    return F.coalesce(*[blank_to_null(text) for text in texts], F.lit(""))


def truncate(text: Column, max_chars: int = 4000) -> Column:
    """First ``max_chars`` characters plus a mark when something was cut off."""
    cut = F.concat(F.substring(text, 1, max_chars), F.lit(TRUNCATION_MARK))
    return F.when(F.length(text) > max_chars, cut).otherwise(text)
