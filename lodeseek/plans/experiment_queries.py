"""Queries on experiment grids: configurations as rows, all of them scored in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import round6
from ..operators import chunking, evaluation, ranking
from .ablation import ALPHAS as WEIGHTS
from .ablation import CHUNKERS
from .ablation import DEPTHS as RERANKED
from .registry import query, table
from .search_queries import SQL_BOTH, SQL_NORMS, SQL_RRF, both_lists, corpus_items, questions, r6, sql_best, sql_weighted
from .corpus_queries import sql_chunks

DEPTHS = [0, *RERANKED]


@query("SELECT s || '/' || z || '/' || o AS chunker, alpha::DOUBLE AS alpha, depth::BIGINT AS depth FROM (VALUES " + ", ".join(f"('{s}', {z}, {o})" for s, z, o in CHUNKERS) + ") c(s, z, o) CROSS JOIN (VALUES " + ", ".join(f"({a})" for a in WEIGHTS) + ") w(alpha) CROSS JOIN (VALUES " + ", ".join(f"({x})" for x in DEPTHS) + ") d(depth)")
def config_grid(spark, d):
    chunkers = spark.createDataFrame([("/".join(map(str, c)),) for c in CHUNKERS], "chunker string")
    weights, depths = spark.createDataFrame([(a,) for a in WEIGHTS], "alpha double"), spark.createDataFrame([(x,) for x in DEPTHS], "depth long")
    return chunkers.crossJoin(F.broadcast(weights)).crossJoin(F.broadcast(depths))  # fixed lists


FIXED = [(size, overlap) for strategy, size, overlap in CHUNKERS if strategy.startswith("fixed")]


@query(" UNION ALL ".join(f"(WITH {sql_chunks(size, overlap)} SELECT '{size}/{overlap}' AS config, count(*) AS chunks FROM chunks)" for size, overlap in FIXED))
def chunk_counts(spark, d):
    docs, out = table(spark, d, "documents"), None
    for size, overlap in FIXED:
        one = chunking.chunk_fixed(docs, size, overlap).agg(F.count("*").alias("chunks")).withColumn("config", F.lit(f"{size}/{overlap}"))
        out = one if out is None else out.unionByName(one)
    return out


CONFIGS = {"rrf": SQL_RRF} | {f"w{a}": sql_weighted(f"{a}::DOUBLE") for a in WEIGHTS}
MODES = {"dense": "SELECT query_id, item_id, score FROM dense", "sparse": "SELECT query_id, item_id, score FROM sparse", "hybrid": SQL_RRF}


def sql_scored(configs: dict[str, str]) -> str:
    return f"""{SQL_BOTH}, {SQL_NORMS}, cfg AS ({" UNION ALL ".join(f"SELECT '{n}' AS config, query_id, item_id, rank FROM ({sql_best(body)})" for n, body in configs.items())}),
graded AS (SELECT config, c.query_id, rank, CASE WHEN contains(doc.text, q.span) THEN 3 WHEN doc.lang = q.business_line THEN 1 ELSE 0 END AS grade FROM cfg c JOIN questions q USING (query_id) JOIN documents doc ON doc.doc_id = c.item_id),
cells AS (SELECT config, query_id, max(CASE WHEN grade >= 2 AND rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS r_at_1, max(CASE WHEN grade >= 2 AND rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS r_at_3,
  coalesce(1.0::DOUBLE / min(CASE WHEN grade >= 2 AND rank <= 10 THEN rank END), 0) AS rr, sum(CASE WHEN rank <= 3 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN ideal <= 3 THEN grade / log2(ideal + 1) ELSE 0 END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY grade DESC, rank) AS ideal FROM graded) GROUP BY ALL),
scored AS (SELECT config, count(*) AS n, {r6('avg(r_at_1)')} AS r_at_1, {r6('avg(r_at_3)')} AS r_at_3, {r6('avg(rr)')} AS mrr_at_10, {r6('avg(CASE WHEN best = 0 THEN 0 ELSE dcg / best END)')} AS ndcg_at_3 FROM cells GROUP BY config)"""


def _fused(spark, d) -> dict:
    dense, sparse = both_lists(spark, d)
    return {"rrf": ranking.rrf([dense, sparse], 10)} | {f"w{a}": ranking.weighted(dense, sparse, a, 10) for a in WEIGHTS}


def _scored(spark, d, lists: dict):
    hits = None
    for name, one in lists.items():
        one = one.select("query_id", "item_id", "rank", F.lit(name).alias("config"))
        hits = one if hits is None else hits.unionByName(one)
    gold = questions(spark, d).select("query_id", "span", F.col("business_line").alias("want"))
    full = hits.join(gold, "query_id").join(corpus_items(spark, d), "item_id")
    graded = full.withColumn("grade", F.when(F.contains("text", "span"), 3).when(F.col("business_line") == F.col("want"), 1).otherwise(0))
    means = ranking.mean_metrics(ranking.query_metrics(graded, ["config", "query_id"]), "config")
    return means.select("config", "n", *[round6(F.col(c)).alias(c) for c in ("r_at_1", "r_at_3", "mrr_at_10", "ndcg_at_3")])


@query(f"{sql_scored(CONFIGS)} SELECT * FROM scored")
def fusion_ablation(spark, d):
    """All fusion settings in one plan: one search, one window and one aggregate over the configurations."""
    return _scored(spark, d, _fused(spark, d))


@query(f"{sql_scored(CONFIGS)} SELECT config, r_at_3, mrr_at_10 FROM scored ORDER BY r_at_3 DESC, mrr_at_10 DESC, ndcg_at_3 DESC, config LIMIT 1")
def fusion_ablation_winner(spark, d):
    """The setting that the next stage takes over."""
    best = evaluation.winner(_scored(spark, d, _fused(spark, d)).withColumn("stage", F.lit(6)), ["stage"], "r_at_3", "mrr_at_10", "ndcg_at_3", order="config")
    return best.select("config", "r_at_3", "mrr_at_10")


@query(f"{sql_scored(MODES)} SELECT * FROM scored")
def mode_ablation(spark, d):
    """Dense, sparse and hybrid search of every question, scored by the gold passages."""
    dense, sparse = both_lists(spark, d)
    return _scored(spark, d, {"dense": dense.where("rank <= 10"), "sparse": sparse.where("rank <= 10"), "hybrid": ranking.rrf([dense, sparse], 10)})
