"""Trigram index for title searches.

Postings are (trigram, key) rows by month, sorted by trigram, so that a search reads a few row groups of the months it asks
for. The literal stretches that every match of a pattern must hold give the trigrams that a title must have; keys with all of
them are candidates, and the pattern itself decides. Patterns without such a stretch fall back to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators.search import title_matches
from gazette.schemas import MONTH

#: Characters that a case-insensitive match may take for each other fold to one.
FINAL_SIGMA, SIGMA, DOT = "ς", "σ", "̇"


def folded(text: Column) -> Column:
    # What stands between the case functions keeps the optimiser from taking them for one.
    return F.translate(F.lower(F.translate(F.upper(F.lower(text)), DOT, "")), FINAL_SIGMA + DOT, SIGMA)


def folded_text(text: str) -> str:
    return text.lower().upper().lower().replace(FINAL_SIGMA, SIGMA).replace(DOT, "")


def postings(rows: DataFrame, key: str, title: str) -> DataFrame:
    """``trigram``, the key and the month of every title; a trigram of a title counts once."""
    # Characters are taken apart once: cutting a string at each place would cost the square of its length.
    chars = rows.where(F.length(folded(F.col(title))) > 2).select(key, MONTH, F.split(folded(F.col(title)), "").alias("_c"))
    grams = F.transform(F.sequence(F.lit(0), F.size("_c") - 3), lambda i: F.concat(F.get("_c", i), F.get("_c", i + 1), F.get("_c", i + 2)))
    return chars.select(F.explode(F.array_distinct(grams)).alias("trigram"), key, MONTH)


def append_postings(rows: DataFrame, path: str, key: str = "url_hash", title: str = "title") -> None:
    """Add the titles of a batch to the index."""
    every = postings(rows, key, title)
    every.repartitionByRange(MONTH, "trigram").sortWithinPartitions(MONTH, "trigram").write.mode("append").partitionBy(MONTH).parquet(path)


def literals(pattern: str) -> list[str]:
    """Stretches of plain characters that every match of a pattern holds; none where the pattern is one of a kind not looked into."""
    found, stretch, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c in "|()":
            return []
        if c == "\\":
            following = pattern[at + 1:at + 2]
            if following.isalnum() or not following:
                if following not in ("b", "d", "w", "s", "D", "W", "S"):
                    return []
                found.append(stretch)
                stretch = ""
            else:
                stretch += following
            at += 2
        elif c == "[":
            end = pattern.find("]", at + 2)
            if end < 0 or "[" in pattern[at + 1:end] or "\\" in pattern[at + 1:end]:
                return []
            found.append(stretch)
            stretch, at = "", end + 1
        elif c in "?*{":
            # What stands before may be missing or come again.
            found.append(stretch[:-1])
            stretch = ""
            if c == "{":
                at = pattern.find("}", at)
                if at < 0:
                    return []
            at += 1
        elif c in "+.^$":
            found.append(stretch)
            stretch, at = "", at + 1
        else:
            stretch += c
            at += 1
    return [one for one in [*found, stretch] if one]


def wanted_trigrams(q: str, mode: str = "regex") -> list[str]:
    """Trigrams that a matching title must have. Stretches with characters beyond the basic plane are left out."""
    stretches = [q] if mode == "literal" else literals(q)
    folds = [folded_text(one) for one in stretches if max(map(ord, one), default=0) < 0x10000]
    return sorted({one[i:i + 3] for one in folds for i in range(len(one) - 2)})


def candidates(index: DataFrame, trigrams: list[str], key: str = "url_hash") -> DataFrame:
    """Keys, with their month, that have every trigram; counted, so that no posting list is gathered."""
    hits = index.where(F.col("trigram").isin(trigrams)).groupBy(key, MONTH).agg(F.countDistinct("trigram").alias("n"))
    return hits.where(F.col("n") == len(trigrams)).select(key, MONTH)


def search_titles(rows: DataFrame, index: DataFrame, q: str, mode: str = "regex", key: str = "url_hash", title: str = "title") -> DataFrame:
    """Rows whose title matches, as the scan would find them; filters on the month reach both tables."""
    trigrams = wanted_trigrams(q, mode)
    if trigrams:
        rows = rows.join(candidates(index, trigrams, key), [key, MONTH], "left_semi")
    return rows.where(title_matches(F.col(title), q, mode))
