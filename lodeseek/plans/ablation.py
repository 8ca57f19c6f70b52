"""Ablations: configurations run over a labelled set, stage by stage, each stage's winner carried into the next."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_clean
from ..operators import evaluation, ranking, routing
from ..operators.stores import STORES
from ..sources.sets import PipelineConfig, save_stage, score_rows, write_text
from .answer import IndexCache, Retriever
from .models import EMBEDDERS

#: The grid of chunking strategies, the weights of fusion, the depths of reranking.
CHUNKERS = [
    ("fixed", 300, 0), ("fixed", 500, 0), ("fixed", 800, 0),
    ("fixed_ov", 300, 50), ("fixed_ov", 500, 50), ("fixed_ov", 500, 100), ("fixed_ov", 800, 100),
    ("recursive", 300, 50), ("recursive", 500, 50), ("recursive", 500, 100), ("recursive", 800, 100),
    ("rule_aware", 300, 50), ("rule_aware", 500, 50), ("rule_aware", 800, 100),
]
ALPHAS = [0.2, 0.3, 0.5, 0.7, 0.8]
DEPTHS = [10, 20]


@dataclass
class Run:
    """One configuration over all questions.  ``scores`` is one row; ``details`` has one a question."""

    config: PipelineConfig
    scores: DataFrame
    per_query: DataFrame
    details: DataFrame
    n_chunks: int
    query_ms: float

    def by(self, facet: str) -> DataFrame:
        """Scores by a column of the questions, such as route or query_type."""
        return ranking.mean_metrics(self.per_query, facet)


class Ablation:
    """``units`` gives the corpus of a parser: (kind, doc_id, business_line, title, pos, locator, text).  ``questions``:
    (query_id, question, route, query_type, gold_doc, gold_locators, gold_span); ``catalogue``: (doc_id, business_line)."""

    def __init__(self, cache: IndexCache, units: Callable[[str], DataFrame], questions: DataFrame, catalogue: DataFrame, corpus: str = ""):
        self.cache, self.units, self.questions, self.catalogue, self.corpus = cache, units, questions, catalogue, corpus

    def retriever(self, config: PipelineConfig) -> Retriever:
        return replace_config(self.cache.get(config, self.units, self.corpus), config)

    def run(self, config: PipelineConfig) -> Run:
        """Searches all questions, grades the hits and scores them; the hits (a few a question) are kept in memory."""
        r = self.retriever(config)
        asked = self.questions.select("query_id", "question")
        began = time.time()
        hits = r.search(asked, config.top_k).cache()
        hits.count()
        ms = (time.time() - began) * 1000 / max(1, asked.count())
        full = hits.join(r.chunks, "item_id").select("query_id", "rank", "doc_id", "locators", "text")
        grades = ranking.graded(full, self.questions)
        gold = self.questions.select("query_id", F.col("route").alias("business_line"))
        top = full.where("rank = 1").select("query_id", "doc_id")
        routes = evaluation.route_accuracy(top, self.catalogue, gold).select("query_id", "route")
        scores = ranking.run_metrics(grades, gold, routes)
        cells = self.questions.select("query_id", "route", "query_type").join(ranking.query_metrics(grades), "query_id", "left").na.fill(0.0)
        return Run(config, scores, cells, ranking.question_details(self.questions, full, grades), r.chunks.count(), ms)

    def rows(self, configs: list[tuple[dict, PipelineConfig]]) -> DataFrame:
        """A table's row of scores for each configuration, led by the given columns and ``n_chunks``, ``query_ms``."""
        out = []
        for at, (prefix, config) in enumerate(configs):
            done = self.run(config)
            out.append(score_rows(done.scores, at=at, **prefix, n_chunks=done.n_chunks, query_ms=done.query_ms))
        return reduce(DataFrame.unionByName, out)

    # --- stages ---------------------------------------------------------------------------------------------------

    def parsing(self, parsers: list[str], base: PipelineConfig) -> DataFrame:
        out = []
        for at, parser in enumerate(parsers):
            began = time.time()
            units = self.units(parser)
            clean = units.agg(F.avg(is_clean(F.col("text")).cast("double")).alias("clean")).collect()[0]["clean"]
            spans = self.questions.select(F.col("query_id").alias("id"), F.col("gold_span").alias("span"))
            recovery = evaluation.span_recovery(spans, evaluation.span_hits(spans, units.select("doc_id", "text"))).collect()[0]["recovery"]
            seconds = time.time() - began
            out.append(score_rows(self.run(replace(base, parser=parser)).scores, at=at, parser=parser, clean=clean, recovery=recovery, seconds=seconds))
        return reduce(DataFrame.unionByName, out)

    def chunking(self, base: PipelineConfig, grid=CHUNKERS) -> DataFrame:
        return self.rows([({"strategy": s, "size": n, "overlap": o}, replace(base, strategy=s, size=n, overlap=o)) for s, n, o in grid])

    def embedding(self, base: PipelineConfig, names: list[str] | None = None) -> DataFrame:
        """With the latency of embedding the questions, after one call that is not counted."""
        out, n = [], max(1, self.questions.count())
        for at, name in enumerate(names or list(EMBEDDERS)):
            seconds = 0.0
            for _ in range(2):
                began = time.time()
                EMBEDDERS[name].queries(self.questions, "question").select("qv").write.format("noop").mode("overwrite").save()
                seconds = time.time() - began
            out.append(score_rows(self.run(replace(base, embedding=name)).scores, at=at, embedding=name, dims=EMBEDDERS[name].dims, latency_ms=seconds * 1000 / n))
        return reduce(DataFrame.unionByName, out)

    def store(self, base: PipelineConfig, names: list[str] | None = None) -> DataFrame:
        out = []
        for at, name in enumerate(names or list(STORES)):
            config = replace(base, store=name)
            r = self.retriever(config)
            build_ms = r.build().build_seconds * 1000
            can = r.store.capabilities
            prefix = {"store": name, "build_ms": build_ms, "filtering": "native" if can.metadata_filtering else "emulated", "persistence": "yes" if can.persistence else "no"}
            out.append(score_rows(self.run(config).scores, at=at, **prefix))
        return reduce(DataFrame.unionByName, out)

    def mode(self, base: PipelineConfig) -> DataFrame:
        """With R@3 of each query type and route beside the whole."""
        out = []
        for at, mode in enumerate(("dense", "sparse", "hybrid")):
            done = self.run(replace(base, mode=mode))
            parts = {f"r_at_3_{r[facet]}": r["r_at_3"] for facet in ("query_type", "route") for r in done.by(facet).orderBy(facet).collect()}  # a handful
            out.append(score_rows(done.scores.crossJoin(F.broadcast(done.scores.sparkSession.createDataFrame([tuple(parts.values())], ", ".join(f"`{k}` double" for k in parts)))), at=at, mode=mode))
        return reduce(DataFrame.unionByName, out)

    def fusion(self, base: PipelineConfig, alphas=ALPHAS) -> DataFrame:
        settings = [("rrf", None), *[("weighted", a) for a in alphas]]
        configs = [({"fusion": f, "alpha": F.lit(a).cast("double")}, replace(base, mode="hybrid", fusion=f, alpha=0.5 if a is None else a)) for f, a in settings]
        return self.rows(configs)

    def reranking(self, base: PipelineConfig, depths=DEPTHS) -> DataFrame:
        """``added_ms``: beyond the run without reranking."""
        rows = self.rows([({"depth": 0}, replace(base, rerank=False)), *[({"depth": n}, replace(base, rerank=True, rerank_candidates=n)) for n in depths]]).cache()
        plain = rows.where("depth = 0").select(F.col("query_ms").alias("plain_ms"))
        return rows.crossJoin(F.broadcast(plain)).withColumn("added_ms", F.greatest(F.col("query_ms") - F.col("plain_ms"), F.lit(0.0))).drop("plain_ms")

    def variants(self, corpora: dict[str, Callable[[str], DataFrame]], base: PipelineConfig) -> DataFrame:
        """The same configuration over other forms of the corpus: records rendered otherwise, boilerplate left in."""
        out = []
        for at, (name, units) in enumerate(corpora.items()):
            done = Ablation(self.cache, units, self.questions, self.catalogue, f"{self.corpus}/{name}").run(base)
            out.append(score_rows(done.scores, at=at, variant=name, n_chunks=done.n_chunks))
        return reduce(DataFrame.unionByName, out)

    def routing_policies(self, base: PipelineConfig, terms: DataFrame) -> DataFrame:
        """(policy, n, accuracy): the first hit's line, votes of five, votes with the prior of defined terms."""
        r = self.retriever(base)
        hits = r.retrieve(self.questions.select("query_id", "question"), 15).join(r.chunks, "item_id")
        five = routing.votes(hits, 5)
        voted = {"top1": routing.votes(hits, 1), "vote": five, "vote_prior": routing.with_prior(five, routing.term_prior(self.questions, terms))}
        out = []
        for name, v in voted.items():
            full = self.questions.select("query_id", F.col("route").alias("want")).join(routing.decide(v), "query_id", "left")
            right = F.coalesce(F.col("route") == F.col("want"), F.lit(False))
            out.append(full.agg(F.count("*").alias("n"), F.coalesce(F.avg(right.cast("double")), F.lit(0.0)).alias("accuracy")).withColumn("policy", F.lit(name)))
        return reduce(DataFrame.unionByName, out)

    def run_all(self, folder: str, base: PipelineConfig, parsers: list[str], grid=CHUNKERS, embeddings: list[str] | None = None, stores: list[str] | None = None) -> PipelineConfig:
        """All stages, saved as pages and rows under ``folder``; the winner of each is the next one's base.  Fusion is
        decided only where the mode is hybrid.  The last configuration is saved beside them."""

        def decide(name: str, title: str, rows: DataFrame, *measures: str) -> dict:
            rows = rows.cache()  # a few rows
            best = evaluation.winner(rows.withColumn("_all", F.lit(1)), ["_all"], *measures, order="at").collect()[0].asDict()
            save_stage(rows.orderBy("at").drop("at"), folder, name, title, notes=f"Best by {', '.join(measures)}: row {best['at'] + 1}.")
            rows.unpersist()
            return best

        config = replace(base, parser=decide("stage1_parsing", "Parsing", self.parsing(parsers, base), "recovery", "r_at_3", "mrr_at_10")["parser"])
        best = decide("stage2_chunking", "Chunking", self.chunking(config, grid), "r_at_3", "mrr_at_10", "ndcg_at_3")
        config = replace(config, strategy=best["strategy"], size=best["size"], overlap=best["overlap"])
        config = replace(config, embedding=decide("stage3_embedding", "Embedding", self.embedding(config, embeddings), "r_at_3", "mrr_at_10")["embedding"])
        config = replace(config, store=decide("stage4_store", "Vector store", self.store(config, stores), "r_at_3", "mrr_at_10")["store"])
        config = replace(config, mode=decide("stage5_mode", "Search mode", self.mode(config), "r_at_3", "mrr_at_10")["mode"])
        if config.mode == "hybrid":
            rows = self.fusion(config).cache()
            save_stage(rows.orderBy("at").drop("at"), folder, "stage6_fusion", "Fusion")
            chosen = evaluation.fusion_choice(rows).collect()[0]
            config = replace(config, fusion=chosen["fusion"], alpha=chosen["alpha"] if chosen["alpha"] is not None else 0.5)
        depth = decide("stage7_reranking", "Reranking", self.reranking(config), "ndcg_at_3", "r_at_3")["depth"]
        config = replace(config, rerank=depth > 0, rerank_candidates=depth or config.rerank_candidates)
        write_text(self.questions.sparkSession, f"{folder}/final_config.json", json.dumps(config.row()))
        return config


def replace_config(r: Retriever, config: PipelineConfig) -> Retriever:
    """An index shared by configurations, searched by this one."""
    r.config = config
    return r
