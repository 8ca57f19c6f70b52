"""Queries on judge scores, gold contexts, confidence ranges and predicted routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats
from ..functions.text import round6
from ..operators import evaluation, ranking
from .corpus_queries import SQL_UNITS, _units
from .evaluation_queries import SQL_LABELLED, labelled
from .registry import query, table
from .search_queries import SQL_ROUTED, SQL_SWEEP, placed_hits, questions, r6

SQL_SCORES = """s AS (SELECT role AS model, CASE WHEN turn % 4 = 0 THEN NULL WHEN turn % 4 = 1 THEN 'NaN'::DOUBLE ELSE conv_id % 10 / 10.0::DOUBLE END AS m, CASE WHEN conv_id % 2 = 0 THEN 'gold_source:v2' ELSE 'ideal_answer' END AS ctx, conv_id, turn FROM conversations)"""


def _scores(spark, d):
    m = F.when(F.col("turn") % 4 == 0, F.lit(None)).when(F.col("turn") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("conv_id") % 10 / F.lit(10.0))
    ctx = F.when(F.col("conv_id") % 2 == 0, "gold_source:v2").otherwise("ideal_answer")
    return table(spark, d, "conversations").select(F.col("role").alias("model"), m.alias("m"), ctx.alias("ctx"), "conv_id", "turn")


@query(f"WITH {SQL_SCORES} SELECT model, CAST(coalesce({r6('avg(m) FILTER (WHERE NOT isnan(m))')}, -1) AS DOUBLE) AS m FROM s GROUP BY model")
def judge_means(spark, d):
    means = evaluation.judge_means(_scores(spark, d), "m")
    return means.select("model", F.when(F.isnan("m"), F.lit(-1.0)).otherwise(round6(F.when(~F.isnan("m"), F.col("m")))).alias("m"))


@query(f"WITH {SQL_SCORES} SELECT conv_id, turn, ctx, CASE WHEN ctx LIKE 'gold_source%' AND NOT isnan(m) THEN m END AS shown FROM s")
def withheld_metric(spark, d):
    s = _scores(spark, d)
    return s.select("conv_id", "turn", "ctx", evaluation.with_provenance(F.when(~F.isnan("m"), F.col("m")), F.col("ctx")).alias("shown"))


@query(f"""WITH {SQL_UNITS}, {SQL_LABELLED}, w AS (SELECT id, gold_doc, i, gold_locators[i] AS locator FROM (SELECT *, unnest(range(1, len(gold_locators) + 1)) AS i FROM labelled)),
t AS (SELECT id, string_agg(u.text, chr(10) ORDER BY i) AS t FROM w JOIN units u ON u.doc_id = w.gold_doc AND u.locator = w.locator GROUP BY id)
SELECT l.id, coalesce(t, 'ideal: ' || span) AS gold_text FROM labelled l LEFT JOIN t USING (id)""")
def gold_source_context(spark, d):
    asked = labelled(spark, d).withColumn("ideal_answer", F.concat(F.lit("ideal: "), F.col("span")))
    return evaluation.gold_text(asked, _units(spark, d))


@query(f"""WITH {SQL_SWEEP}, r AS (SELECT min(score) FILTER (WHERE answerable) AS a, avg(score) FILTER (WHERE answerable) AS b, max(score) FILTER (WHERE answerable) AS c,
min(score) FILTER (WHERE NOT answerable) AS x, avg(score) FILTER (WHERE NOT answerable) AS y, max(score) FILTER (WHERE NOT answerable) AS z FROM s)
SELECT {r6('a')} AS min_answerable, {r6('b')} AS avg_answerable, {r6('c')} AS max_answerable, {r6('x')} AS min_unanswerable, {r6('y')} AS avg_unanswerable, {r6('z')} AS max_unanswerable, z >= a AS overlap FROM r""")
def confidence_summary(spark, d):
    score = F.col("doc_id") * 37 % 1000 / F.lit(2000.0) + F.when(F.col("quality") == 1, 0.6).otherwise(0.3)
    out = evaluation.confidence_summary(table(spark, d, "labels").select((F.col("quality") == 1).alias("answerable"), score.alias("score")))
    return out.select(*[round6(F.col(c)).alias(c) for c in out.columns if c != "overlap"], "overlap")


@query(f"""WITH {SQL_ROUTED}, top AS (SELECT query_id, CASE business_line WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' ELSE 'unknown' END AS route FROM placed WHERE rank = 1)
SELECT q.query_id, coalesce(route, 'unknown') AS route, coalesce(route, 'unknown') = q.business_line AS "right" FROM questions q LEFT JOIN top USING (query_id)""")
def route_accuracy(spark, d):
    top = placed_hits(spark, d).where("rank = 1").select("query_id", F.col("item_id").alias("doc_id"))
    catalogue = table(spark, d, "documents").where("lang in ('en', 'de')").select("doc_id", F.col("lang").alias("business_line"))
    return evaluation.route_accuracy(top, catalogue, questions(spark, d).select("query_id", "business_line"))


@query(f"WITH {SQL_UNITS} SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN 'doc ' || doc_id || ', ' || CASE WHEN pos % 2 = 0 THEN 'Net income' ELSE 'us-gaap:x' || pos END ELSE 'doc ' || doc_id || ', page ' || pos END AS citation FROM units")
def citation_string(spark, d):
    u = _units(spark, d)
    locator = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("us-gaap:x"), F.col("pos").cast("string"))).otherwise(F.col("locator"))
    label = F.when(F.col("pos") % 2 == 0, F.lit("Net income"))
    return u.select("doc_id", "pos", formats.citation(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), locator, label).alias("citation"))


@query("""WITH f AS (SELECT doc_id % 5 AS query_id, doc_id AS item_id, n_chars % 97 / 7.0::DOUBLE AS score FROM documents)
SELECT query_id, string_agg(item_id::VARCHAR, ',' ORDER BY rank) AS items FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 7 GROUP BY query_id""")
def stable_topk(spark, d):
    hits = table(spark, d, "documents").select((F.col("doc_id") % 5).alias("query_id"), F.col("doc_id").alias("item_id"), (F.col("n_chars") % 97 / F.lit(7.0)).alias("score"))
    top = ranking.top_k(hits, 7).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    return top.select("query_id", F.array_join(F.transform("l", lambda x: x["item_id"].cast("string")), ",").alias("items"))
