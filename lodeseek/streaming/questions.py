"""A stream of questions against the guards and a static corpus.  The batch interface is the primary one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.guards import before_retrieval


def guarded(stream: DataFrame) -> DataFrame:
    """A stream (query_id, question) with the verdict of the guards; stateless, so in append mode."""
    return stream.withColumn("verdict", before_retrieval(F.col("question")))


def counted(stream: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Questions or events by window and key, with a watermark that bounds the state."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), key, "n")


def candidates(stream: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, item_id): each question's items that share a term, by a join of the stream with the static postings.

    A pair counts at its first common term only, so that no state is needed to tell repeated pairs."""
    postings = corpus.withColumn("terms", F.array_distinct(tokens(F.col("text")))).select("item_id", "terms", F.explode("terms").alias("term"))
    asked = stream.withColumn("asked", F.array_distinct(tokens(F.col("question")))).select("query_id", "asked", F.explode("asked").alias("term"))
    first = F.array_min(F.array_intersect("asked", "terms"))
    return asked.join(postings, "term").where(F.col("term") == first).select("query_id", "item_id")
