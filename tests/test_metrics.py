"""Ranking metrics on cases computed by hand."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseek.operators import ranking

CASES = {
    "top": [3, 0, 0], "weak": [1, 0, 0], "good": [2, 0, 0], "third": [0, 0, 3], "fourth": [0, 0, 0, 3], "second": [0, 3, 0], "none": [0] * 10, "late": [0] * 10 + [3],
    "mixed": [1, 1, 1, 3], "ideal": [3, 2, 1], "worst": [1, 2, 3], "ones": [1, 1, 1],
}


@pytest.fixture(scope="module")
def scores(spark):
    graded = spark.createDataFrame([(q, i + 1, g) for q, gs in CASES.items() for i, g in enumerate(gs)], "query_id string, rank int, grade int")
    return {r["query_id"]: r for r in ranking.query_metrics(graded).collect()}


def test_hit_rates(scores):
    assert [scores[q]["r_at_1"] for q in ("top", "weak", "good", "third")] == [1, 0, 1, 0]
    assert [scores[q]["r_at_3"] for q in ("third", "fourth")] == [1, 0]


def test_reciprocal_rank(scores):
    got = [scores[q]["rr_at_10"] for q in ("top", "second", "third", "none", "late", "mixed")]
    assert got == pytest.approx([1, 0.5, 1 / 3, 0, 0, 0.25])


def test_gain(scores):
    dcg = lambda gs: sum(g / math.log2(i + 2) for i, g in enumerate(gs))
    assert scores["ideal"]["dcg_at_3"] == pytest.approx(4.76186, abs=1e-5)
    assert scores["ideal"]["ndcg_at_3"] == 1
    assert scores["worst"]["ndcg_at_3"] == pytest.approx(dcg([1, 2, 3]) / dcg([3, 2, 1]))
    assert scores["none"]["ndcg_at_3"] == 0
    assert scores["ones"]["ndcg_at_3"] == 1  # the ideal is that of what was retrieved


def test_means(spark):
    graded = spark.createDataFrame([(q, i + 1, g) for q, gs in enumerate([[3, 0, 0], [0, 0, 0], [0, 2, 0]]) for i, g in enumerate(gs)], "query_id int, rank int, grade int")
    m = ranking.mean_metrics(ranking.query_metrics(graded)).collect()[0]
    assert (m["n"], m["r_at_1"], m["r_at_3"], m["mrr_at_10"]) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), 0.5)
    empty = ranking.mean_metrics(ranking.query_metrics(graded.limit(0))).collect()[0]
    assert (empty["n"], empty["r_at_1"], empty["ndcg_at_3"]) == (0, 0, 0)


def test_grade(spark):
    t, f = F.lit(True), F.lit(False)
    row = spark.range(1).select(*[ranking.grade(*c).alias(str(i)) for i, c in enumerate([(t, t, f), (t, f, t), (t, f, f), (f, t, t)])]).collect()[0]
    assert list(row) == [3, 2, 1, 0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=6), min_size=1, max_size=6))
def test_bounds(spark, rankings):
    graded = spark.createDataFrame([(q, i + 1, g) for q, gs in enumerate(rankings) for i, g in enumerate(gs)], "query_id int, rank int, grade int")
    for r in ranking.query_metrics(graded).collect():
        assert 0 <= r["ndcg_at_3"] <= 1 + 1e-12 and 0 <= r["rr_at_10"] <= 1


HITS = "query_id int, item_id int, score double, rank int"


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], HITS)
    sparse = spark.createDataFrame([(1, 11, 7.0, 1), (1, 12, 7.0, 2)], HITS)
    fused = {r["item_id"]: r["score"] for r in ranking.rrf([dense, sparse], 5).collect()}
    assert fused == {10: 1 / 61, 11: pytest.approx(1 / 61 + 1 / 62), 12: 1 / 62}
    assert fused == {r["item_id"]: pytest.approx(r["score"]) for r in ranking.rrf([sparse, dense], 5).collect()}
    w = {r["item_id"]: r["score"] for r in ranking.weighted(dense, sparse, 0.5, 5).collect()}
    assert w == {10: 0.5, 11: 0.5, 12: 0.5}  # equal sparse scores all become 1
    only = {r["item_id"]: r["score"] for r in ranking.weighted(dense, sparse.limit(0), 1.0, 5).collect()}
    assert only == {10: 1.0, 11: 0.0}
    with pytest.raises(ValueError):
        ranking.weighted(dense, sparse, 1.5, 5)
    with pytest.raises(ValueError):
        ranking.fuse("sum", dense, sparse, 5)
