"""Queries on search, fusion, reranking, metrics, routing and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import citation
from ..functions.text import STOP_WORDS, round6, stemmed, tokens
from ..functions.vectors import l2_normalise as unit_vector
from ..operators import evaluation, guards, ranking, routing
from ..operators.search import Bm25Index, over_fetch, rerank
from ..operators.stores import get_store, matrix_hits
from ..sources.scratch import scratch
from ..sources.sets import PipelineConfig
from . import answer as plans
from . import judging, models
from .corpus_queries import SQL_UNITS, _units
from .registry import query, table

STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def sql_tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({STOPS}, t))"


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


# --- inputs -------------------------------------------------------------------------------------------------------

SQL_QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS span, array_to_string(string_split(text, ' ')[1:8], ' ') AS question, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS business_line FROM benchmark)"


def questions(spark, d) -> DataFrame:
    line = F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "de").otherwise("fr")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("span"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("question"), line.alias("business_line"))


def corpus_items(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("business_line"))


SQL_BM25 = f"""{SQL_QUESTIONS},
dls AS (SELECT item_id, business_line, terms, len(terms) AS dl FROM (SELECT doc_id AS item_id, lang AS business_line, {sql_tokens('text')} AS terms FROM documents)),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
post AS (SELECT item_id, business_line, dl, term, count(*) AS tf FROM (SELECT item_id, business_line, dl, unnest(terms) AS term FROM dls) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT DISTINCT query_id, business_line AS want, unnest({sql_tokens('question')}) AS term FROM questions),
parts AS (SELECT query_id, item_id, want, business_line, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS p FROM asked JOIN post USING (term) JOIN df USING (term), stats)"""


def sql_sparse(k: int, where: str = "TRUE", name: str = "sparse") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT query_id, item_id, {r6('sum(p)')} AS score FROM parts WHERE {where} GROUP BY ALL)) WHERE rank <= {k})"""


SQL_DENSE_ALL = f"""dense_all AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label AS q_label, i.label AS label,
  {r6('list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))')} AS score
  FROM embeddings q, embeddings i WHERE q.vec_id < 20 AND i.vec_id >= 20)"""


def sql_dense(k: int, where: str = "TRUE", name: str = "dense") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense_all WHERE {where}) WHERE rank <= {k})"""


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """A stated set of 20 queries, and all other vectors; either with its label."""
    e = table(spark, d, "embeddings")
    items = e.where("vec_id >= 20").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), "label")
    return e.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("q_label")), items


def dense_top(spark, d, k: int, same: bool = False) -> DataFrame:
    """The best ``k`` with both labels; labels join the few hits."""
    asked, items = _vectors(spark, d)
    line = lambda df, label: df.withColumn("business_line", F.col(label).cast("string"))
    hits = matrix_hits(line(asked, "q_label"), line(items, "label"), k, same)
    return hits.join(items.select("item_id", "label"), "item_id").join(F.broadcast(asked.select("query_id", "q_label")), "query_id")  # 20 queries


def _rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


# --- sparse and dense search --------------------------------------------------------------------------------------


@query(f"WITH {SQL_BM25} SELECT term, df, n, {r6('avgdl')} AS avgdl FROM df, stats")
def bm25_corpus_stats(spark, d):
    index = Bm25Index(corpus_items(spark, d))
    return index.document_frequency().crossJoin(F.broadcast(index.stats())).select("term", "df", "n", round6(F.col("avgdl")).alias("avgdl"))


@query(f"WITH {SQL_BM25}, {sql_sparse(10)} SELECT query_id, item_id, score, rank FROM sparse")
def bm25_search_topk(spark, d):
    return _rank(Bm25Index(corpus_items(spark, d)).search(questions(spark, d), 10)).select("query_id", "item_id", "score", "rank")


@query(f"WITH {SQL_BM25}, {sql_sparse(10, 'want = business_line')} SELECT query_id, item_id, score, rank FROM sparse")
def bm25_search_filtered(spark, d):
    return _rank(Bm25Index(corpus_items(spark, d)).search(questions(spark, d), 10, filtered=True)).select("query_id", "item_id", "score", "rank")


@query()
def bm25_stemmed(spark, d):
    index = Bm25Index(corpus_items(spark, d), fold=stemmed)
    return _rank(index.search(questions(spark, d), 10)).select("query_id", "item_id", "score", "rank")


@query(f"""SELECT vec_id, array_to_string(list_transform(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)), lambda x: CAST(CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS v FROM embeddings""")
def l2_normalise(spark, d):
    v = F.transform(unit_vector(F.col("embedding")), lambda x: F.floor(x * 1e6 + 0.5).cast("long").cast("string"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(v, ",").alias("v"))


@query(f"WITH {SQL_DENSE_ALL}, {sql_dense(10)} SELECT query_id, item_id, score, rank FROM dense")
def cosine_topk(spark, d):
    return _rank(matrix_hits(*_vectors(spark, d), 10)).select("query_id", "item_id", "score", "rank")


@query(f"WITH {SQL_DENSE_ALL}, {sql_dense(10, 'label = q_label')} SELECT query_id, item_id, score, rank FROM dense")
def cosine_topk_filtered(spark, d):
    return _rank(dense_top(spark, d, 10, same=True)).select("query_id", "item_id", "score", "rank")


@query(f"""WITH {SQL_DENSE_ALL}, {sql_dense(120, name='wide')}
SELECT query_id, item_id, score, rank FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM wide WHERE label = q_label) WHERE rank <= 10""")
def overfetch_postfilter_topk(spark, d):
    return _rank(over_fetch(dense_top(spark, d, 120), F.col("label") == F.col("q_label"), 10)).select("query_id", "item_id", "score", "rank")


@query(f"""WITH {SQL_DENSE_ALL}, {sql_dense(5)}
SELECT query_id, max(score) AS best, CASE WHEN max(score) < 0.45 THEN 'weak_evidence:' || format('{{:,.3f}}', max(score)) || '<0.45' END AS reason FROM dense GROUP BY query_id""")
def dense_confidence_gate(spark, d):
    best = matrix_hits(*_vectors(spark, d), 5).groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    return best.select("query_id", "best", guards.evidence_gate(F.col("n"), F.col("best"), 0.45).alias("reason"))


# --- fusion and reranking -----------------------------------------------------------------------------------------

def sql_hashed(table: str, key: str, text: str, dims: int = 256) -> str:
    """Rows (key, place, w) of hashed vectors, without those places that are 0."""
    return f"""SELECT {key}, place, sum(sign) AS w FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 7))::BIGINT % {dims} AS place, CASE WHEN substr(md5(t), 8, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0 END AS sign
  FROM (SELECT {key}, unnest({sql_tokens(text)}) AS t FROM {table})) GROUP BY ALL"""


SQL_ASKED_DENSE = f"""dv AS ({sql_hashed('documents', 'doc_id', 'text')}), dlen AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dv GROUP BY 1),
qv AS ({sql_hashed('questions', 'query_id', 'question')}), qlen AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1),
dots AS (SELECT query_id, doc_id, sum(qv.w * dv.w) AS s FROM qv JOIN dv USING (place) GROUP BY ALL),
cosines AS (SELECT q.query_id, doc.doc_id AS item_id, coalesce(s / (greatest(qlen.n, 1e-12) * greatest(dlen.n, 1e-12)), 0) AS cosine
  FROM questions q CROSS JOIN documents doc LEFT JOIN qlen USING (query_id) LEFT JOIN dlen USING (doc_id) LEFT JOIN dots USING (query_id, doc_id))"""


def sql_asked_dense(k: int) -> str:
    return f"{SQL_ASKED_DENSE}, dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT query_id, item_id, {r6('cosine')} AS score FROM cosines)) WHERE rank <= {k})"


SQL_BOTH = f"WITH {SQL_BM25}, {sql_sparse(20)}, {sql_asked_dense(20)}"


def both_lists(spark, d) -> tuple[DataFrame, DataFrame]:
    """The best 20 documents of every question, by its embedding and by BM25."""
    embedder, items, asked = plans.get_embedder("hashed"), corpus_items(spark, d), questions(spark, d)
    dense = matrix_hits(embedder.queries(asked, "question"), embedder.documents(items, "text"), 20)
    sparse = Bm25Index(items).search(asked, 20)
    return dense, sparse.select("query_id", "item_id", "score", "rank")


SQL_NORMS = """dn AS (SELECT query_id, item_id, CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS norm FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM dense WINDOW w AS (PARTITION BY query_id))),
sn AS (SELECT query_id, item_id, CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS norm FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM sparse WINDOW w AS (PARTITION BY query_id)))"""


def sql_weighted(alpha: str) -> str:
    return f"""SELECT query_id, item_id, {alpha} * coalesce(dn.norm, 0.0::DOUBLE) + (1 - {alpha}) * coalesce(sn.norm, 0.0::DOUBLE) AS score FROM dn FULL OUTER JOIN sn USING (query_id, item_id)"""


SQL_RRF = """SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, item_id, rank FROM dense UNION ALL SELECT query_id, item_id, rank FROM sparse) GROUP BY ALL"""


def sql_best(body: str, k: int = 10) -> str:
    return f"SELECT query_id, item_id, {r6('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ({body})) WHERE rank <= {k}"


def _shown(df: DataFrame) -> DataFrame:
    return _rank(df).select("query_id", "item_id", round6(F.col("score")).alias("score"), "rank")


@query(f"{SQL_BOTH} {sql_best(SQL_RRF)}")
def rrf_fusion(spark, d):
    return _shown(ranking.rrf(list(both_lists(spark, d)), 10))


@query(f"{SQL_BOTH}, {SQL_NORMS} SELECT query_id, item_id, {r6('norm')} AS norm FROM sn")
def minmax_normalise(spark, d):
    return ranking.min_max(both_lists(spark, d)[1]).select("query_id", "item_id", round6(F.col("norm")).alias("norm"))


@query(f"{SQL_BOTH}, {SQL_NORMS} {sql_best(sql_weighted('0.5::DOUBLE'))}")
def weighted_fusion(spark, d):
    return _shown(ranking.weighted(*both_lists(spark, d), alpha=0.5, k=10))


@query(f"{SQL_BOTH}, {SQL_NORMS} " + " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, query_id, item_id, score, rank FROM ({sql_best(sql_weighted(f'{a}::DOUBLE'), 3)})" for a in (0.25, 0.5, 0.75)))
def alpha_sweep(spark, d):
    dense, sparse = both_lists(spark, d)
    out = None
    for a in (0.25, 0.5, 0.75):
        one = _shown(ranking.weighted(dense, sparse, a, 3)).withColumn("alpha", F.lit(a))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{SQL_BOTH}, short AS (SELECT s.query_id, s.item_id, {sql_tokens('q.question')} AS a, {sql_tokens('doc.text')} AS b FROM ({sql_best(SQL_RRF)}) s JOIN questions q USING (query_id) JOIN documents doc ON doc.doc_id = s.item_id)
SELECT query_id, item_id, {r6('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT query_id, item_id, coalesce(len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0) AS score FROM short)) WHERE rank <= 5""")
def rerank_overlap(spark, d):
    fused = ranking.rrf(list(both_lists(spark, d)), 10).drop("score")
    full = fused.join(questions(spark, d).select("query_id", "question"), "query_id").join(corpus_items(spark, d).select("item_id", "text"), "item_id")
    return _shown(rerank(full, 10, 5))


@query(f"{SQL_BOTH}, {SQL_NORMS} SELECT 'weighted' AS fusion, * FROM ({sql_best(sql_weighted('0.5::DOUBLE'))}) UNION ALL SELECT 'rrf', * FROM ({sql_best(SQL_RRF)})")
def hybrid_search(spark, d):
    dense, sparse = both_lists(spark, d)
    out = [_shown(ranking.fuse(name, dense, sparse, 10)).withColumn("fusion", F.lit(name)) for name in ("weighted", "rrf")]
    return out[0].unionByName(out[1])


# --- metrics ------------------------------------------------------------------------------------------------------

SQL_GRADED = f"""{SQL_DENSE_ALL}, {sql_dense(10)},
graded AS (SELECT query_id, q_label, rank, CASE WHEN label = q_label AND item_id % 3 = 0 THEN 3 WHEN label = q_label THEN 2 WHEN abs(label - q_label) = 1 THEN 1 ELSE 0 END AS grade FROM dense),
per_query AS (SELECT query_id, q_label,
  max(CASE WHEN grade >= 2 AND rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS r_at_1, max(CASE WHEN grade >= 2 AND rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS r_at_3,
  coalesce(1.0::DOUBLE / min(CASE WHEN grade >= 2 AND rank <= 10 THEN rank END), 0) AS rr_at_10,
  sum(CASE WHEN rank <= 3 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg_at_3, sum(CASE WHEN ideal <= 3 THEN grade / log2(ideal + 1) ELSE 0 END) AS ideal_dcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM graded) GROUP BY ALL)"""


def graded_hits(spark, d) -> DataFrame:
    hits = dense_top(spark, d, 10)
    same = F.col("label") == F.col("q_label")
    g = F.when(same & (F.col("item_id") % 3 == 0), 3).when(same, 2).when(F.abs(F.col("label") - F.col("q_label")) == 1, 1).otherwise(0)
    return hits.select("query_id", "q_label", "rank", g.alias("grade"))


def per_query(spark, d) -> DataFrame:
    return ranking.query_metrics(graded_hits(spark, d), ["query_id", "q_label"])


@query(f"WITH {SQL_GRADED} SELECT query_id, r_at_1, r_at_3 FROM per_query")
def recall_at_k(spark, d):
    return per_query(spark, d).select("query_id", "r_at_1", "r_at_3")


@query(f"WITH {SQL_GRADED} SELECT query_id, {r6('rr_at_10')} AS rr_at_10 FROM per_query")
def mrr_at_10(spark, d):
    return per_query(spark, d).select("query_id", round6(F.col("rr_at_10")).alias("rr_at_10"))


@query(f"WITH {SQL_GRADED} SELECT query_id, {r6('dcg_at_3')} AS dcg_at_3, {r6('CASE WHEN ideal_dcg = 0 THEN 0 ELSE dcg_at_3 / ideal_dcg END')} AS ndcg_at_3 FROM per_query")
def dcg_ndcg_at_3(spark, d):
    return per_query(spark, d).select("query_id", round6(F.col("dcg_at_3")).alias("dcg_at_3"), round6(F.col("ndcg_at_3")).alias("ndcg_at_3"))


def sql_means(by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, {r6('avg(r_at_1)')} AS r_at_1, {r6('avg(r_at_3)')} AS r_at_3, {r6('avg(rr_at_10)')} AS mrr_at_10, {r6('avg(dcg_at_3)')} AS dcg_at_3, {r6('avg(CASE WHEN ideal_dcg = 0 THEN 0 ELSE dcg_at_3 / ideal_dcg END)')} AS ndcg_at_3 FROM per_query GROUP BY 1"""


def _means(df: DataFrame, *by: str) -> DataFrame:
    m = ranking.mean_metrics(df, *by)
    return m.select(*by, "n", *[round6(F.col(c)).alias(c) for c in ("r_at_1", "r_at_3", "mrr_at_10", "dcg_at_3", "ndcg_at_3")])


@query(f"WITH {SQL_GRADED} {sql_means('q_label::BIGINT AS facet')}")
def metrics_by_facet(spark, d):
    return _means(per_query(spark, d).withColumn("facet", F.col("q_label").cast("long")), "facet")


SQL_GOLD_HITS = f"""{SQL_BM25}, {sql_sparse(10)},
hits AS (SELECT s.query_id, s.item_id, s.rank, CASE WHEN contains(doc.text, q.span) THEN 3 WHEN doc.lang = q.business_line THEN 2 WHEN doc.lang <> 'es' THEN 1 ELSE 0 END AS grade
  FROM sparse s JOIN questions q USING (query_id) JOIN documents doc ON doc.doc_id = s.item_id)"""


def _gold_hits(spark, d) -> DataFrame:
    """Search hits graded: the passage inside 3, the wanted line 2, another known line 1, else 0."""
    asked = questions(spark, d)
    hits = Bm25Index(corpus_items(spark, d)).search(asked, 10)
    full = hits.join(asked.withColumnRenamed("business_line", "want"), "query_id").join(corpus_items(spark, d), "item_id")
    inside = F.contains("text", "span")
    g = ranking.grade((F.col("business_line") != "es") | inside | (F.col("business_line") == F.col("want")), inside, F.col("business_line") == F.col("want"))
    return full.select("query_id", "item_id", "rank", g.alias("grade"))


@query(f"WITH {SQL_GOLD_HITS} SELECT query_id, item_id, rank, grade::BIGINT AS grade FROM hits")
def graded_relevance(spark, d):
    return _rank(_gold_hits(spark, d)).withColumn("grade", F.col("grade").cast("long"))


SQL_ONLY_SPANS = f"""WITH {SQL_BM25}, {sql_sparse(10)},
hits AS (SELECT s.query_id, s.rank, CASE WHEN contains(doc.text, q.span) THEN 3 ELSE 0 END AS grade FROM sparse s JOIN questions q USING (query_id) JOIN documents doc ON doc.doc_id = s.item_id),
cells AS (SELECT query_id, max(CASE WHEN grade >= 2 AND rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS r_at_1, max(CASE WHEN grade >= 2 AND rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS r_at_3,
  coalesce(1.0::DOUBLE / min(CASE WHEN grade >= 2 AND rank <= 10 THEN rank END), 0) AS rr_at_10, sum(CASE WHEN rank <= 3 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg_at_3,
  sum(CASE WHEN ideal <= 3 THEN grade / log2(ideal + 1) ELSE 0 END) AS ideal_dcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM hits) GROUP BY query_id),
per_query AS (SELECT q.query_id, coalesce(r_at_1, 0) AS r_at_1, coalesce(r_at_3, 0) AS r_at_3, coalesce(rr_at_10, 0) AS rr_at_10, coalesce(dcg_at_3, 0) AS dcg_at_3, coalesce(ideal_dcg, 0) AS ideal_dcg FROM questions q LEFT JOIN cells USING (query_id))
{sql_means("'bm25' AS system")}"""


@query(SQL_ONLY_SPANS)
def bm25_retrieval_scores(spark, d):
    """Every question searched, its hits graded by the gold passage; questions without hits score 0."""
    graded = _gold_hits(spark, d).withColumn("grade", F.when(F.col("grade") == 3, 3).otherwise(0))
    cells = ranking.query_metrics(graded)
    full = questions(spark, d).select("query_id").join(cells, "query_id", "left").na.fill(0.0)
    return _means(full.withColumn("system", F.lit("bm25")), "system")


# --- routing ------------------------------------------------------------------------------------------------------

SQL_ROUTED = f"""{SQL_BM25}, {sql_sparse(15)}, placed AS (SELECT s.query_id, s.item_id, s.rank, doc.lang AS business_line FROM sparse s JOIN documents doc ON doc.doc_id = s.item_id)"""


def sql_votes(n: int) -> str:
    return f"SELECT query_id, business_line, sum(1.0::DOUBLE / rank) AS votes, min(rank) AS first_rank FROM placed WHERE rank <= {n} GROUP BY ALL"


def sql_decide(votes: str) -> str:
    return f"""SELECT query_id, business_line AS route, {r6('votes / total')} AS confidence FROM (SELECT *, sum(votes) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY {r6('votes')} DESC, first_rank, business_line) AS n FROM ({votes})) WHERE n = 1"""


def placed_hits(spark, d) -> DataFrame:
    return Bm25Index(corpus_items(spark, d)).search(questions(spark, d), 15).join(corpus_items(spark, d), "item_id")


def _decided(voted: DataFrame) -> DataFrame:
    return routing.decide(voted).withColumn("confidence", round6(F.col("confidence")))


@query(f"WITH {SQL_ROUTED} {sql_decide(sql_votes(1))}")
def route_top1(spark, d):
    return _decided(routing.votes(placed_hits(spark, d), 1))


@query(f"WITH {SQL_ROUTED} {sql_decide(sql_votes(5))}")
def route_vote(spark, d):
    return _decided(routing.votes(placed_hits(spark, d), 5))


#: documents define no terms: the first two words of a line that starts with a capital stand for a definition
SQL_TERMS = rf"""{SQL_UNITS}, defs AS (SELECT business_line, regexp_extract(text, '^([A-Z][a-z]{{2,14}} [a-z]{{2,14}}) ', 1) || ' means x' AS text FROM units),
found AS (SELECT DISTINCT business_line, lower(regexp_extract(text, '^([A-Z][A-Za-z][A-Za-z /''\-]{{1,38}}?)\s*(?:shall mean|means|shall be|[-–]\s)', 1)) AS term FROM defs WHERE business_line <> 'es'),
terms AS (SELECT term, min(business_line) AS business_line FROM found WHERE length(term) >= 4 AND NOT list_contains({['carrier', 'days', 'person', 'property', 'us', 'u s', 'united states of america', 'currency', 'numbers', 'group']}, term) GROUP BY term HAVING count(*) = 1)"""


def _terms(spark, d) -> DataFrame:
    defs = _units(spark, d).select("business_line", F.concat(F.regexp_extract("text", r"^([A-Z][a-z]{2,14} [a-z]{2,14}) ", 1), F.lit(" means x")).alias("text"))
    return routing.defined_terms(defs, skip=("es",))


@query(f"WITH {SQL_TERMS} SELECT term, business_line FROM terms")
def defined_terms(spark, d):
    return _terms(spark, d)


SQL_PRIOR = f"""{SQL_TERMS}, q2 AS (SELECT item_id AS query_id, text AS question FROM benchmark),
prior AS (SELECT query_id, business_line, sum(1 + 0.4::DOUBLE * (len(string_split(term, ' ')) - 1)) AS prior FROM q2 JOIN terms ON regexp_matches(lower(question), '(^|[^a-z0-9_])' || term || '($|[^a-z0-9_])') GROUP BY ALL)"""


def _prior(spark, d) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return routing.term_prior(asked, _terms(spark, d))


@query(f"WITH {SQL_PRIOR} SELECT query_id, business_line, {r6('prior')} AS prior FROM prior")
def term_prior(spark, d):
    return _prior(spark, d).withColumn("prior", round6(F.col("prior")))


SQL_WITH_PRIOR = f"""SELECT query_id, business_line, coalesce(votes, 0) + coalesce(prior * (0.35 * sum(votes) OVER w / greatest(sum(prior) OVER w, 1e-9)), 0) AS votes, coalesce(first_rank, 1073741824) AS first_rank
FROM (SELECT * FROM ({sql_votes(5)}) FULL OUTER JOIN prior USING (query_id, business_line)) WINDOW w AS (PARTITION BY query_id) QUALIFY max(first_rank) OVER w IS NOT NULL"""


@query(f"WITH {SQL_ROUTED}, {SQL_PRIOR} {sql_decide(SQL_WITH_PRIOR)}")
def route_vote_prior(spark, d):
    return _decided(routing.with_prior(routing.votes(placed_hits(spark, d), 5), _prior(spark, d)))


@query(f"""WITH {SQL_ROUTED}, {SQL_PRIOR}, routes AS (SELECT 'top1' AS policy, * FROM ({sql_decide(sql_votes(1))}) UNION ALL SELECT 'vote', * FROM ({sql_decide(sql_votes(5))}) UNION ALL SELECT 'vote_prior', * FROM ({sql_decide(SQL_WITH_PRIOR)}))
SELECT p.policy, count(*) AS n, count(*) FILTER (WHERE r.route IS DISTINCT FROM q.business_line) AS misrouted, {r6("avg(CASE WHEN r.route = q.business_line THEN 1.0::DOUBLE ELSE 0 END)")} AS accuracy
FROM questions q CROSS JOIN (VALUES ('top1'), ('vote'), ('vote_prior')) p(policy) LEFT JOIN routes r ON r.query_id = q.query_id AND r.policy = p.policy GROUP BY p.policy""")
def routing_policy_compare(spark, d):
    hits = placed_hits(spark, d)
    five = routing.votes(hits, 5)
    routes = {"top1": routing.votes(hits, 1), "vote": five, "vote_prior": routing.with_prior(five, _prior(spark, d))}
    gold, out = questions(spark, d).select("query_id", "business_line"), None
    for name, voted in routes.items():
        one = gold.join(routing.decide(voted), "query_id", "left").withColumn("policy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    right = F.coalesce(F.col("route") == F.col("business_line"), F.lit(False))
    return out.groupBy("policy").agg(F.count("*").alias("n"), F.count_if(~right).alias("misrouted"), round6(F.avg(right.cast("double"))).alias("accuracy"))


@query(f"""WITH {SQL_ROUTED}, lead AS (SELECT query_id, business_line AS lead FROM placed WHERE rank = 1)
SELECT query_id, item_id, business_line, rank FROM (SELECT query_id, item_id, business_line, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM placed JOIN lead USING (query_id) WHERE business_line = lead) WHERE rank <= 5""")
def scope_to_route(spark, d):
    return _rank(routing.scope(placed_hits(spark, d), 5)).select("query_id", "item_id", "business_line", "rank")


# --- guards -------------------------------------------------------------------------------------------------------

ASKED = ["What's JetBlue's baggage policy?", "Tell me about the United States", "Where is my bag", "status of my JetBlue flight", "How long may a bag be?", "Can you rebook my trip", "British Airways or Ryanair?", "Is there a fee for a pet?"]
SQL_ASKED = "asked_(id, question) AS (SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}::BIGINT, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(ASKED)) + ") UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations)"


def asked_all(spark, d) -> DataFrame:
    fixed = spark.createDataFrame([(-i - 1, q) for i, q in enumerate(ASKED)], "id long, question string")
    return fixed.unionByName(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question")))


SQL_CARRIER = "CASE " + " ".join(rf"WHEN regexp_matches(lower(question), '\b{n}\b') THEN '{s}'" for n, s in guards.OTHER_CARRIERS.items()) + " END"
SQL_LIVE = f"regexp_matches(question, '{guards.LIVE_DATA_PATTERN}')"


@query(f"WITH {SQL_ASKED} SELECT id, {SQL_CARRIER} AS carrier FROM asked_")
def other_carrier_guard(spark, d):
    return asked_all(spark, d).select("id", guards.other_carrier(F.col("question")).alias("carrier"))


@query(f"WITH {SQL_ASKED} SELECT id, {SQL_LIVE} AS live FROM asked_")
def live_data_guard(spark, d):
    return asked_all(spark, d).select("id", guards.needs_live_data(F.col("question")).alias("live"))


@query(f"""WITH {SQL_ASKED}, v AS (SELECT id, {SQL_CARRIER} AS carrier, {SQL_LIVE} AS live FROM asked_)
SELECT id, carrier IS NOT NULL OR live AS blocked, CASE WHEN carrier IS NOT NULL THEN 'out_of_scope_carrier:' || carrier WHEN live THEN 'requires_live_data' END AS reason,
CASE WHEN carrier IS NOT NULL THEN replace('{guards.REFUSAL}', '{{carrier}}', carrier) WHEN live THEN '{guards.DEFLECTION}' END AS answer FROM v""")
def pre_retrieval_guard(spark, d):
    return asked_all(spark, d).select("id", guards.before_retrieval(F.col("question")).alias("g")).select("id", "g.blocked", "g.reason", "g.answer")


@query(r"""WITH a AS (SELECT conv_id * 1000 + turn AS id, text || CASE turn % 5 WHEN 0 THEN ' [1] and [3]' WHEN 1 THEN ' [2] [1] [2]' WHEN 2 THEN '' WHEN 3 THEN ' [0]' ELSE ' [9]' END AS answer FROM conversations),
c AS (SELECT id, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER)))) AS cited FROM a)
SELECT id, array_to_string(cited, ',') AS cited, len(cited) > 0 AND len(list_filter(cited, lambda x: x < 1 OR x > 3)) = 0 AS valid FROM c""")
def citation_verify(spark, d):
    t = F.col("turn") % 5
    tail = F.when(t == 0, " [1] and [3]").when(t == 1, " [2] [1] [2]").when(t == 2, "").when(t == 3, " [0]").otherwise(" [9]")
    a = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", tail).alias("answer"))
    return a.select("id", F.array_join(guards.citations(F.col("answer")), ",").alias("cited"), guards.citations_valid(F.col("answer"), F.lit(3)).alias("valid"))


@query(f"""WITH {SQL_ROUTED} SELECT query_id, string_agg('[' || rank || '] doc ' || item_id || ', page ' || (item_id % 7 + 1) || chr(10) || left(text, 1800), chr(10) || chr(10) ORDER BY rank) AS sources
FROM placed JOIN documents ON doc_id = item_id WHERE rank <= 3 GROUP BY query_id""")
def source_block(spark, d):
    hits = placed_hits(spark, d).where("rank <= 3")
    title, locator = F.concat(F.lit("doc "), F.col("item_id").cast("string")), F.concat(F.lit("p"), (F.col("item_id") % 7 + 1).cast("string"))
    return guards.source_blocks(hits.withColumn("citation", citation(title, locator, F.lit(None).cast("string"))))


# --- thresholds ---------------------------------------------------------------------------------------------------

SQL_SWEEP = """s AS (SELECT quality = 1 AS answerable, (doc_id * 37 % 1000) / 2000.0::DOUBLE + CASE WHEN quality = 1 THEN 0.6 ELSE 0.3 END AS score FROM labels),
grid AS (SELECT floor((0.55::DOUBLE + i * 0.02::DOUBLE) * 1000 + 0.5) / 1000 AS threshold FROM range(0, 17) t(i)),
sweep AS (SELECT threshold, coalesce(avg(CASE WHEN answerable THEN CASE WHEN score >= threshold THEN 1.0::DOUBLE ELSE 0 END END), 0) AS answered, coalesce(avg(CASE WHEN NOT answerable THEN CASE WHEN score >= threshold THEN 0.0::DOUBLE ELSE 1 END END), 0) AS refused FROM s, grid GROUP BY threshold)"""


def _sweep(spark, d) -> DataFrame:
    score = F.col("doc_id") * 37 % 1000 / F.lit(2000.0) + F.when(F.col("quality") == 1, 0.6).otherwise(0.3)
    return evaluation.threshold_sweep(table(spark, d, "labels").select((F.col("quality") == 1).alias("answerable"), score.alias("score")))


@query(f"WITH {SQL_SWEEP} SELECT threshold, {r6('answered')} AS answered, {r6('refused')} AS refused, {r6('answered + refused')} AS total FROM sweep")
def threshold_sweep(spark, d):
    return _sweep(spark, d).select("threshold", *[round6(F.col(c)).alias(c) for c in ("answered", "refused", "total")])


@query(f"WITH {SQL_SWEEP} SELECT threshold, {r6('answered')} AS answered, {r6('refused')} AS refused FROM sweep WHERE answered >= 1.0 OR NOT EXISTS (SELECT 1 FROM sweep WHERE answered >= 1.0) ORDER BY sweep.refused DESC, sweep.answered DESC, threshold LIMIT 1")
def threshold_select(spark, d):
    return evaluation.threshold_select(_sweep(spark, d)).select("threshold", *[round6(F.col(c)).alias(c) for c in ("answered", "refused")])


# --- models behind functions --------------------------------------------------------------------------------------


@query(f"""WITH e AS ({sql_hashed('documents', 'doc_id', "'passage: ' || text", 64)}), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM e GROUP BY 1)
SELECT d.doc_id, string_agg(CAST(CAST(floor(coalesce(w, 0) / greatest(n, 1e-12) * 1e6 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS v
FROM documents d CROSS JOIN range(64) r(i) LEFT JOIN n USING (doc_id) LEFT JOIN e ON e.doc_id = d.doc_id AND e.place = i GROUP BY d.doc_id""")
def embed_hash(spark, d):
    out = models.Embedder(64, document_prefix="passage: ").documents(table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.array_join(F.transform("v", lambda x: F.floor(x * 1e6 + 0.5).cast("long").cast("string")), ",").alias("v"))


@query(f"WITH {SQL_DENSE_ALL}, {sql_dense(10, 'label = q_label')} SELECT query_id, item_id, score, rank FROM dense")
def store_search_filtered(spark, d):
    """Through a store that is written and opened again."""
    asked, items = _vectors(spark, d)
    line = lambda df, label: df.withColumn("business_line", F.col(label).cast("string"))
    place = scratch(spark, "store")
    get_store("exact", spark, place).build(line(items, "label"))
    return _rank(get_store("exact", spark, place).search(line(asked, "q_label"), 10, filtered=True)).select("query_id", "item_id", "score", "rank")


def _chunks(spark, d) -> DataFrame:
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "doc_id", F.col("lang").alias("business_line"), F.array(F.lit("p1")).alias("locators"), title.alias("title"), "text")


def _answered(spark, d) -> DataFrame:
    asked = questions(spark, d).select("query_id", "question").unionByName(spark.createDataFrame([(-i - 1, q) for i, q in enumerate(ASKED)], "query_id long, question string"))
    retriever = plans.Retriever(_chunks(spark, d), PipelineConfig(), scratch(spark, "index")).build()
    return plans.answer(asked, retriever)


def sql_overlap(part: str, whole: str) -> str:
    return f"coalesce(len(list_intersect(list_distinct({sql_tokens(part)}), list_distinct({sql_tokens(whole)})))::DOUBLE / nullif(len(list_distinct({sql_tokens(part)})), 0), 0)"


SQL_ANSWERED = rf"""WITH questions0 AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS question FROM benchmark
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({-i - 1}, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(ASKED))})),
guarded AS (SELECT query_id, question, {SQL_CARRIER} AS carrier, {SQL_LIVE} AS live FROM questions0),
questions AS (SELECT query_id, question, NULL::VARCHAR AS business_line FROM guarded WHERE carrier IS NULL AND NOT live),
{SQL_BM25[SQL_BM25.index("dls AS"):]}, {sql_sparse(30)}, {sql_asked_dense(30)}, {SQL_NORMS},
fused AS ({sql_best(sql_weighted('0.5::DOUBLE'), 15)}),
placed AS (SELECT f.query_id, f.item_id, f.rank, doc.lang AS line, doc.text FROM fused f JOIN documents doc ON doc.doc_id = f.item_id),
lead AS (SELECT query_id, line AS route FROM placed WHERE rank = 1),
scoped AS (SELECT * FROM (SELECT p.query_id, p.item_id, p.text, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank) AS rank FROM placed p JOIN lead ON lead.query_id = p.query_id AND lead.route = p.line) WHERE rank <= 5),
gate AS (SELECT query_id, max(cosine) AS best, count(*) AS n, string_agg(text, chr(10) ORDER BY rank) AS context, list(text ORDER BY rank) AS contexts FROM scoped JOIN cosines USING (query_id, item_id) GROUP BY query_id),
sentences AS (SELECT query_id, question, i, s[i] AS s FROM (SELECT query_id, question, s, unnest(range(1, len(s) + 1)) AS i FROM (
  SELECT query_id, question, list_filter(string_split(regexp_replace(contexts[1], '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM gate JOIN questions USING (query_id)))),
chosen AS (SELECT query_id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(list_distinct({sql_tokens('s')}), list_distinct({sql_tokens('question')}))) DESC, i) AS k FROM sentences) WHERE k = 1),
answered AS (SELECT g.query_id, g.question, context, contexts, n, route,
  CASE WHEN carrier IS NOT NULL THEN 'out_of_scope_carrier:' || carrier WHEN live THEN 'requires_live_data' WHEN coalesce(n, 0) = 0 THEN 'no_hits' WHEN best < 0.05 THEN 'weak_evidence:' || format('{{:,.3f}}', best) || '<0.05' END AS reason,
  coalesce(s, '') || ' [1]' AS said, carrier, live
  FROM guarded g LEFT JOIN gate USING (query_id) LEFT JOIN lead USING (query_id) LEFT JOIN chosen USING (query_id)),
final AS (SELECT query_id, question, reason IS NOT NULL AS blocked, reason, CASE WHEN reason IS NULL THEN route END AS route, context, contexts, n,
  CASE WHEN carrier IS NOT NULL THEN replace('{guards.REFUSAL}', '{{carrier}}', carrier) WHEN live THEN '{guards.DEFLECTION}' WHEN reason IS NOT NULL THEN '{guards.ABSTENTION}' ELSE said END AS answer,
  reason IS NULL AND len(list_filter(regexp_extract_all(said, '\[(\d+)\]', 1), lambda x: x::BIGINT < 1 OR x::BIGINT > n)) = 0 AS citations_valid FROM answered)"""


@query(f"{SQL_ANSWERED} SELECT query_id, blocked, reason, route, answer, citations_valid, coalesce(n, -1) AS n_contexts FROM final")
def answer_pipeline(spark, d):
    return _answered(spark, d).select("query_id", "blocked", "reason", "route", "answer", "citations_valid", F.coalesce(F.size("contexts"), F.lit(-1)).cast("long").alias("n_contexts"))


@query(f"{SQL_ANSWERED} SELECT query_id, answer, citations_valid FROM final WHERE NOT blocked")
def generate_extractive(spark, d):
    return _answered(spark, d).where("not blocked").select("query_id", "answer", "citations_valid")


SQL_JUDGED = f"{SQL_ANSWERED}, judged AS (SELECT f.*, b.text AS ideal_answer FROM final f JOIN benchmark b ON b.item_id = f.query_id WHERE NOT blocked AND n > 0)"


def _judged(spark, d) -> DataFrame:
    ideal = questions(spark, d).select("query_id", F.col("span").alias("ideal_answer"))
    return judging.judgeable(_answered(spark, d)).join(ideal, "query_id").withColumnRenamed("query_id", "id")


@query(f"""{SQL_JUDGED} SELECT query_id AS id, {r6(sql_overlap('answer', 'context'))} AS proxy_faithfulness, {r6(sql_overlap('question', 'answer'))} AS proxy_relevancy,
{r6(f"len(list_filter(contexts, lambda c: {sql_overlap('ideal_answer', 'c')} >= 0.3))::DOUBLE / len(contexts)")} AS proxy_context_precision,
{r6(sql_overlap('ideal_answer', 'context'))} AS proxy_context_recall, {r6('1 - ' + sql_overlap('answer', 'context'))} AS proxy_hallucination FROM judged""")
def judge_proxy(spark, d):
    out = evaluation.judge(_judged(spark, d))
    return out.select("id", *[round6(F.col(c)).alias(c) for c in out.columns if c.startswith("proxy_")])


#: of each question, three units of its document stand for the gold source
SQL_GOLD = f"""units AS {SQL_UNITS.split(" AS ", 1)[1]}, gold AS (SELECT b.item_id AS id, coalesce(string_agg(u.text, chr(10) ORDER BY list_position(['p3', 'p1', 'p2'], u.locator)), b.text) AS gold_text
  FROM benchmark b LEFT JOIN units u ON u.doc_id = b.item_id * 3 AND u.locator IN ('p1', 'p2', 'p3') GROUP BY b.item_id, b.text)"""


@query(f"""{SQL_JUDGED}, {SQL_GOLD}, against AS (SELECT query_id AS id, answer, context, ideal_answer, gold_text FROM judged JOIN gold ON gold.id = judged.query_id)
SELECT id, 'retrieved' AS variant, {r6('1 - ' + sql_overlap('answer', 'context'))} AS score FROM against
UNION ALL SELECT id, 'ideal_answer', {r6('1 - ' + sql_overlap('answer', 'ideal_answer'))} FROM against UNION ALL SELECT id, 'gold_source', {r6('1 - ' + sql_overlap('answer', 'gold_text'))} FROM against""")
def hallucination_variants(spark, d):
    records = _judged(spark, d)
    wanted = records.select("id", "ideal_answer", (F.col("id") * 3).alias("gold_doc"), F.array(F.lit("p3"), F.lit("p1"), F.lit("p2")).alias("gold_locators"))
    gold = evaluation.gold_text(wanted, _units(spark, d))
    return evaluation.hallucination_variants(records.join(gold, "id")).withColumn("score", round6(F.col("score")))
