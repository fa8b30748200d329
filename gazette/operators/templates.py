"""Template text of hosts: what many pages of a host have in common is not what one of them says.

Pages are cut into blocks of text at their block elements. A block's digest is counted over the distinct pages of its host;
blocks on a large part of them are the host's template, and a page's text is its other blocks. Counting combines on the map
side, and only the digests of template blocks, a few for each host, go back to the pages, so a hot host is no task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = "p|div|li|ul|ol|td|th|tr|table|h[1-6]|section|article|nav|header|footer|aside|main|body|head|title|br|hr|blockquote|form|pre"
#: With one meaning in Java and RE2.
UNSEEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
BREAKS = rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>"
TAGS = r"<[^>]*>"


def text_blocks(html: Column) -> Column:
    """Texts between block elements, in order, with single blanks; empty ones are left out."""
    broken = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(html, "\r\n", "  "), UNSEEN, " "), BREAKS, "\n"), TAGS, " ")
    return F.filter(F.transform(F.split(broken, "\n"), lambda one: F.trim(F.regexp_replace(one, r"\s+", " "))), lambda one: one != "")


def blocks_of(pages: DataFrame, key: str, host: str, html: str) -> DataFrame:
    rows = pages.select(F.col(key).alias("page"), F.col(host).alias("host"), F.posexplode(text_blocks(F.col(html))).alias("place", "block"))
    return rows.withColumn("digest", F.unhex(F.md5("block")))


def template_blocks(blocks: DataFrame, least_pages: int, share: float) -> DataFrame:
    """``host`` and ``digest`` of blocks on at least ``least_pages`` pages and the share of the host's pages that have text."""
    seen = blocks.groupBy("host", "digest", "page").agg(F.first(F.lit(1)).alias("_")).groupBy("host", "digest").agg(F.count("*").alias("pages"))
    sizes = blocks.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all_pages"))
    many = seen.where(F.col("pages") >= least_pages).join(sizes, "host")
    return many.where(F.col("pages") >= F.col("all_pages") * share).select("host", "digest")


def own_text(pages: DataFrame, key: str = "page_id", host: str = "host", html: str = "html", least_pages: int = 3, share: float = 0.3) -> DataFrame:
    """``key``, ``own_text`` (the blocks that are not the host's template, a line each) and ``n_template`` of every page."""
    blocks = blocks_of(pages, key, host, html)
    template = template_blocks(blocks, least_pages, share).withColumn("template", F.lit(True))
    marked = blocks.join(template, ["host", "digest"], "left")
    own = F.array_sort(F.collect_list(F.when(F.col("template").isNull(), F.struct("place", "block"))))
    texts = marked.groupBy("page").agg(F.transform(own, lambda one: one.block).alias("own"), F.count("template").alias("n_template"))
    joined = pages.select(F.col(key)).join(texts.withColumnRenamed("page", key), key, "left")
    return joined.select(key, F.coalesce(F.array_join("own", "\n"), F.lit("")).alias("own_text"), F.coalesce("n_template", F.lit(0)).alias("n_template"))
