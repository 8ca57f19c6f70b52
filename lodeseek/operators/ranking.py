"""Ranks, top-k, fusion of ranked lists and ranking metrics.

A ranking is a DataFrame with a query key, an item key and a score or rank.  Ties go to the smaller item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_for_match


def top_k(hits: DataFrame, k: int, query: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """The best ``k`` of each query with their rank; Spark limits each group before and after the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, item_id, rank)."""
    bag = reduce(DataFrame.unionByName, [x.select("query_id", "item_id", "rank") for x in lists])
    fused = bag.groupBy("query_id", "item_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return top_k(fused, k)


def min_max(hits: DataFrame) -> DataFrame:
    """(query_id, item_id, norm): scores spread over 0 to 1 within a query; equal scores become 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    norm = F.when(high - low < 1e-12, F.lit(1.0)).otherwise(F.try_divide(F.col("score") - low, high - low))
    return hits.select("query_id", "item_id", norm.alias("norm"))


def weighted(dense: DataFrame, sparse: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha x dense + (1 - alpha) x sparse of normalised scores; an absent item counts 0."""
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
    d, s = min_max(dense).withColumnRenamed("norm", "d"), min_max(sparse).withColumnRenamed("norm", "s")
    both = d.join(s, ["query_id", "item_id"], "full_outer")
    score = alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))
    return top_k(both.select("query_id", "item_id", score.alias("score")), k)


FUSIONS = {"rrf": lambda dense, sparse, k, alpha: rrf([dense, sparse], k), "weighted": lambda dense, sparse, k, alpha: weighted(dense, sparse, alpha, k)}


def fuse(name: str, dense: DataFrame, sparse: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    if name not in FUSIONS:
        raise ValueError(f"unknown fusion {name!r}; known: {sorted(FUSIONS)}")
    return FUSIONS[name](dense, sparse, k, alpha)


def grade(same_doc: Column, span_inside: Column, locator_shared: Column) -> Column:
    """0 for another document; 3 if the gold span is inside, 2 for a shared locator, else 1."""
    return F.when(~same_doc, 0).when(span_inside, 3).when(locator_shared, 2).otherwise(1)


def graded(hits: DataFrame, gold: DataFrame, fold=fold_for_match) -> DataFrame:
    """(query_id, rank, grade) of hits (query_id, rank, doc_id, locators, text) by gold (query_id, gold_doc,
    gold_locators, gold_span): the gold span inside 3, a shared locator 2, else the same document 1, another 0.

    ``fold`` prepares texts and spans for comparison."""
    full = hits.join(gold.select("query_id", "gold_doc", "gold_locators", "gold_span"), "query_id")
    inside = F.contains(fold(F.coalesce("text", F.lit(""))), fold(F.coalesce("gold_span", F.lit(""))))
    shared = F.coalesce(F.arrays_overlap("locators", "gold_locators"), F.lit(False))
    return full.select("query_id", "rank", grade(F.coalesce(F.col("doc_id") == F.col("gold_doc"), F.lit(False)), inside, shared).alias("grade"))


def run_metrics(grades: DataFrame, questions: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """One row: n, r_at_1, r_at_3, mrr_at_10, dcg_at_3, ndcg_at_3 and route_accuracy over all questions (query_id and,
    for routes, business_line).

    Questions without hits score 0; without questions all are 0.  ``routes`` (query_id, route) must name a route for
    each question; without it the route accuracy is null."""
    cells = questions.select("query_id").join(query_metrics(grades), "query_id", "left").na.fill(0.0)
    means = mean_metrics(cells)
    if routes is None:
        return means.withColumn("route_accuracy", F.lit(None).cast("double"))
    paired = questions.select("query_id", "business_line").join(routes.select("query_id", "route"), "query_id", "full_outer")
    wrong = F.count_if(F.col("business_line").isNull() | F.col("route").isNull()) > 0
    share = F.coalesce(F.avg((F.col("business_line") == F.col("route")).cast("double")), F.lit(0.0))
    accuracy = paired.agg(F.when(wrong, F.raise_error(F.lit("routes and questions differ in length"))).otherwise(share).alias("route_accuracy"))
    return means.crossJoin(F.broadcast(accuracy))  # one row each


def question_details(questions: DataFrame, hits: DataFrame, grades: DataFrame) -> DataFrame:
    """(query_id, question, route, query_type, grades, top_doc, top_locators) of every question: its grades in order of
    rank, the document and locators of its first hit; no grades and no locators without hits."""
    listed = grades.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "grade"))), lambda x: x["grade"]).alias("grades"))
    top = hits.where(F.col("rank") == 1).select("query_id", F.col("doc_id").alias("top_doc"), F.col("locators").alias("top_locators"))
    full = questions.select("query_id", "question", "route", "query_type").join(listed, "query_id", "left").join(top, "query_id", "left")
    return full.withColumns({"grades": F.coalesce("grades", F.array().cast("array<int>")), "top_locators": F.coalesce("top_locators", F.array().cast("array<string>"))})


def query_metrics(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per query, from (query_id, rank, grade): hit rates at 1 and 3, reciprocal rank at 10, DCG and NDCG at 3.

    A grade of 2 or more is relevant; the ideal order is that of the grades retrieved."""
    by = by or ["query_id"]
    ideal = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("grade"), "rank"))
    gain = lambda rank: F.col("grade") / F.log2(rank + 1.0)
    hit = F.col("grade") >= 2
    cells = graded.withColumn("ideal", ideal).groupBy(*by).agg(
        F.max(F.when(hit & (F.col("rank") <= 1), 1.0).otherwise(0.0)).alias("r_at_1"),
        F.max(F.when(hit & (F.col("rank") <= 3), 1.0).otherwise(0.0)).alias("r_at_3"),
        F.coalesce(1.0 / F.min(F.when(hit & (F.col("rank") <= 10), F.col("rank"))), F.lit(0.0)).alias("rr_at_10"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 3, gain(F.col("rank")))), F.lit(0.0)).alias("dcg_at_3"),
        F.coalesce(F.sum(F.when(F.col("ideal") <= 3, gain(F.col("ideal")))), F.lit(0.0)).alias("ideal_dcg"),
    )
    return cells.withColumn("ndcg_at_3", F.coalesce(F.try_divide("dcg_at_3", "ideal_dcg"), F.lit(0.0))).drop("ideal_dcg")


def mean_metrics(per_query: DataFrame, *by: str) -> DataFrame:
    """Means over queries; without queries n is 0 and the means are 0."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_query.groupBy(*by).agg(F.count("*").alias("n"), *[mean(c).alias(o) for c, o in (("r_at_1", "r_at_1"), ("r_at_3", "r_at_3"), ("rr_at_10", "mrr_at_10"), ("dcg_at_3", "dcg_at_3"), ("ndcg_at_3", "ndcg_at_3"))])
