"""Raw web pages to text by three extractors; they stand where page-oriented parsers would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise


def _text(html: Column) -> Column:
    spaced = F.regexp_replace(html, r"(?i)</(p|div|h[1-6]|li|tr|article|section|header|footer|nav|title)>|<br ?/?>", "\n")
    bare = F.regexp_replace(spaced, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return bare


def all_tags(html: Column) -> Column:
    return _text(html)


def without_chrome(html: Column) -> Column:
    return _text(F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</(script|style|nav|footer)>", ""))


def article_only(html: Column) -> Column:
    return _text(F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1), F.lit("")), html))


PARSERS = {"strip_tags": all_tags, "no_chrome": without_chrome, "article": article_only}


def parse_pages(pages: DataFrame, parser: str) -> DataFrame:
    """(page_id, page, text, raw_chars, parser): blocks of a page's text, counted from 1, normalised."""
    if parser not in PARSERS:
        raise ValueError(f"unknown parser {parser!r}; known: {sorted(PARSERS)}")
    raw = pages.select("page_id", F.coalesce(PARSERS[parser](F.col("html")), F.lit("")).alias("raw"))
    rows = raw.select("page_id", F.posexplode(F.split("raw", r"\n[ \t]*\n", -1)).alias("p", "block"))
    return rows.select("page_id", (F.col("p") + 1).alias("page"), normalise(F.col("block")).alias("text"), F.length("block").alias("raw_chars"), F.lit(parser).alias("parser"))
