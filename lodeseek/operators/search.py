"""Sparse search (BM25), filters after ranking, reranking.

Scores are rounded at six places, so that equal items tie whatever the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round6, tokens
from .ranking import top_k


class Bm25Index:
    """Postings of a corpus (item_id, text and any columns to filter by); nothing is computed until it is searched.

    ``fold`` changes the words that ``analyse`` cuts one for one, as a stemmer does; lengths need no folding."""

    def __init__(self, corpus: DataFrame, k1: float = 1.5, b: float = 0.75, analyse=tokens, fold=None):
        self.k1, self.b, self.analyse = k1, b, (lambda c: fold(analyse(c))) if fold else analyse
        self.lengths = corpus.select(F.size(analyse(F.col("text"))).alias("dl"))
        self.items = corpus.withColumn("terms", self.analyse(F.col("text"))).withColumn("dl", F.size("terms"))

    def write(self, path: str) -> Bm25Index:
        """Writes the terms of all items, so that they are cut once whatever is searched, and reads from there on."""
        self.items.drop("text").write.mode("overwrite").parquet(path)
        self.items = self.items.sparkSession.read.parquet(path)
        self.lengths = self.items.select("dl")
        return self

    @classmethod
    def open(cls, spark, path: str, **options) -> Bm25Index:
        out = cls(spark.createDataFrame([], "item_id long, text string"), **options)
        out.items = spark.read.parquet(path)
        out.lengths = out.items.select("dl")
        return out

    def stats(self) -> DataFrame:
        """One row: number of items and mean length."""
        return self.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def document_frequency(self) -> DataFrame:
        return self.items.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def search(self, queries: DataFrame, k: int, filtered: bool = False) -> DataFrame:
        """(query_id, item_id, score, rank) of queries (query_id, question and, to filter, business_line).

        Only the queries' terms are counted, before any shuffle of postings; the filter comes before the ranking.
        Words are cut once for the postings: explode() would add a filter that cuts them again, and frequencies that do
        not read tf would have postings of their own.
        """
        asked = queries.select("query_id", *(["business_line"] if filtered else []), F.explode(F.array_distinct(self.analyse(F.col("question")))).alias("term"))
        wanted = asked.select("term").distinct()
        extra = ["business_line"] if filtered else []
        postings = self.items.select("item_id", "dl", *extra, F.explode_outer("terms").alias("term")).join(wanted, "term", "left_semi")
        postings = postings.groupBy("term", "item_id", "dl", *extra).agg(F.count("*").alias("tf"))
        df = postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
        scored = asked.join(postings, ["term", *extra]).join(df, "term").crossJoin(F.broadcast(self.stats()))  # one row
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.col("tf") / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avgdl")))
        hits = scored.groupBy("query_id", "item_id").agg(round6(F.sum(idf * part)).alias("score"))
        return top_k(hits, k)


def over_fetch(hits: DataFrame, wanted: Column, k: int, factor: int = 12) -> DataFrame:
    """Filter after ranking: the best factor x k, then those wanted, then ``k``; may return fewer than ``k``."""
    some = top_k(hits, factor * k).drop("rank").where(wanted)
    return top_k(some, k)


def overlap_score(question: Column, text: Column) -> Column:
    """Share of common terms: the default scorer of the reranker."""
    a, b = F.array_distinct(tokens(question)), F.array_distinct(tokens(text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def rerank(hits: DataFrame, shortlist: int, k: int, scorer=overlap_score) -> DataFrame:
    """Orders the first ``shortlist`` of each query (query_id, item_id, rank, question, text) anew."""
    return top_k(hits.where(F.col("rank") <= shortlist).withColumn("score", scorer(F.col("question"), F.col("text"))).drop("rank"), k)
