"""Documents to citable units: pages or lines, front matter, running headers and footers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PAGE_FOOTER, filled_lines, is_front_matter, lines, mask_digits, strip


def units(docs: DataFrame, id_col: str = "doc_id", line_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(doc_id, business_line, pos, locator, text): one row a line, counted from 1."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(line_col).alias("business_line"), F.posexplode(lines(F.col(text_col))).alias("p", "text"))
    return rows.select("doc_id", "business_line", (F.col("p") + 1).alias("pos"), F.concat(F.lit("p"), (F.col("p") + 1).cast("string")).alias("locator"), "text")


def edge_lines(text: Column, n: int = 3) -> Column:
    """The first and last ``n`` filled lines; in a short page some stand in both."""
    body = filled_lines(text)
    return F.concat(F.slice(body, 1, n), F.slice(body, F.greatest(F.size(body) - n + 1, F.lit(1)), n))


def running_lines(pages: DataFrame, group: str, threshold: float = 0.4, n: int = 3) -> DataFrame:
    """(group, line, n): masked lines at the edges of at least max(2, threshold x pages) pages of a group."""
    cutoff = pages.groupBy(group).agg(F.greatest(F.lit(2), F.floor(F.count("*") * threshold)).alias("cutoff"))
    counted = pages.select(group, F.explode(edge_lines(F.col("text"), n)).alias("line")).groupBy(group, mask_digits(F.col("line")).alias("line")).agg(F.count("*").alias("n"))
    return counted.join(cutoff, group).where(F.col("n") >= F.col("cutoff")).select(group, "line", "n")


#: Running lines that are sent to every task; more of them are joined by shuffle.
MOST_SENT = 2000


def strip_running(pages: DataFrame, running: DataFrame, group: str, page_key: str) -> DataFrame:
    """Pages (page_key, group, text) without running lines and page footers: (page_key, text).

    Where all groups together have at most MOST_SENT running lines, each page filters its own lines and no text moves."""
    spark = pages.sparkSession
    few = running.select(group, "line").limit(MOST_SENT + 1).collect()
    if len(few) <= MOST_SENT:
        by_group: dict = {}
        for g, line in few:
            by_group.setdefault(g, []).append(line)
        kind = running.schema[group].dataType.simpleString()
        sent = F.broadcast(spark.createDataFrame(list(by_group.items()), f"`{group}` {kind}, _lines array<string>"))  # at most MOST_SENT lines
        joined = pages.select(page_key, group, "text").join(sent, group, "left").withColumn("_lines", F.coalesce("_lines", F.array().cast("array<string>")))
        kept = F.filter(lines(F.coalesce("text", F.lit(""))), lambda x: ~F.regexp_like(x, F.lit(PAGE_FOOTER)) & ~F.array_contains("_lines", mask_digits(strip(x))))
        return joined.select(page_key, strip(F.array_join(kept, "\n")).alias("text"))
    rows = pages.select(page_key, group, F.posexplode(lines(F.col("text"))).alias("pos", "raw"))
    rows = rows.withColumn("line", mask_digits(strip(F.col("raw")))).where(~F.regexp_like("raw", F.lit(PAGE_FOOTER)))
    kept = rows.join(running.select(group, "line"), [group, "line"], "left_anti")
    text = kept.groupBy(page_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    return pages.select(page_key).join(text, page_key, "left").select(page_key, strip(F.coalesce("text", F.lit(""))).alias("text"))


def without_front_matter(pages: DataFrame) -> DataFrame:
    return pages.where(~is_front_matter(F.col("text")))


def load_corpus(kinds: dict[str, DataFrame], known: tuple[str, ...] = ("pdf", "xbrl")) -> DataFrame:
    """The union of the kinds' units; columns that a kind lacks are null."""
    if unknown := set(kinds) - set(known):
        raise ValueError(f"unknown kinds {sorted(unknown)}; known: {list(known)}")
    out = None
    for kind in known:
        if kind in kinds:
            df = kinds[kind].where(strip(F.col("text")) != "").withColumn("kind", F.lit(kind))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source was given")
    return out
