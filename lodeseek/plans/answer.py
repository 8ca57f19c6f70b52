"""End-to-end plans: an index of chunks, retrieval by its configuration, grounded answers, with models behind functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import citation
from ..functions.text import tokens
from ..functions.vectors import cosine
from ..operators import guards, ranking, routing
from ..operators.chunking import chunk_units
from ..operators.search import Bm25Index, rerank
from ..operators.stores import get_store
from ..sources.sets import PipelineConfig, path_exists
from .models import PROMPT, Embedder, called, get_embedder, rendered


class Retriever:
    """Chunks (item_id, business_line, text and others) with a sparse index and, where a mode needs it, a vector store."""

    def __init__(self, chunks: DataFrame, config: PipelineConfig, folder: str | None = None, embedder: Embedder | None = None):
        self.chunks, self.config, self.spark = chunks, config, chunks.sparkSession
        self.embedder = embedder or get_embedder(config.embedding)
        self.folder = folder
        written = folder is not None and path_exists(self.spark, f"{folder}/terms/_SUCCESS")
        self.sparse = Bm25Index.open(self.spark, f"{folder}/terms") if written else Bm25Index(chunks.select("item_id", "business_line", "text"))
        self.store = get_store(config.store, self.spark, folder) if folder else None
        self.build_seconds = 0.0

    def build(self) -> Retriever:
        """Cuts and embeds the chunks once, and writes their terms and vectors."""
        self.sparse = Bm25Index(self.chunks.select("item_id", "business_line", "text")).write(f"{self.folder}/terms")
        self.build_seconds = self.store.build(self.embedder.documents(self.chunks.select("item_id", "business_line", "text"), "text"))
        return self

    def retrieve(self, queries: DataFrame, k: int = 10, mode: str | None = None, fusion: str | None = None, alpha: float | None = None, candidate_k: int | None = None, filtered: bool = False) -> DataFrame:
        """(query_id, item_id, score, rank) of queries (query_id, question and, to filter, business_line).

        In hybrid mode each side brings ``candidate_k`` candidates, max(2k, 20) by default."""
        mode, fusion = mode or self.config.mode, fusion or self.config.fusion
        alpha = self.config.alpha if alpha is None else alpha
        fan = candidate_k or max(2 * k, 20)
        if mode not in ("dense", "sparse", "hybrid"):
            raise ValueError(f"unknown mode {mode!r}; known: dense, hybrid, sparse")
        if mode == "sparse":
            return self.sparse.search(queries, k, filtered)
        if self.store is None:
            raise ValueError("dense retrieval needs a store: give the retriever a folder")
        dense = self.store.search(self.embedder.queries(queries, "question"), k if mode == "dense" else fan, filtered)
        return dense if mode == "dense" else ranking.fuse(fusion, dense, self.sparse.search(queries, fan, filtered), k, alpha)

    def search(self, queries: DataFrame, k: int | None = None, filtered: bool = False) -> DataFrame:
        """retrieve by the configuration, with its reranking."""
        k = k or self.config.top_k
        if not self.config.rerank:
            return self.retrieve(queries, k, filtered=filtered)
        hits = self.retrieve(queries, max(k, self.config.rerank_candidates), filtered=filtered)
        full = hits.join(queries.select("query_id", "question"), "query_id").join(self.chunks.select("item_id", "text"), "item_id")
        return rerank(full, self.config.rerank_candidates, k).select("query_id", "item_id", "score", "rank")


class IndexCache:
    """Retrievers by what their index depends on: the chunks and vectors of a key are written once under ``folder``, and
    configurations that search differently share them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.built = spark, folder.rstrip("/"), 0

    def place(self, config: PipelineConfig, corpus: str = "") -> str:
        key = hashlib.md5(repr((corpus, *config.index_key())).encode()).hexdigest()[:16]
        return f"{self.folder}/index-{key}"

    def get(self, config: PipelineConfig, units: Callable[[str], DataFrame], corpus: str = "") -> Retriever:
        """``units`` gives the corpus as a parser reads it; ``corpus`` names it, where a folder serves several."""
        place = self.place(config, corpus)
        if not path_exists(self.spark, f"{place}/done"):
            chunks = chunk_units(units(config.parser), config.strategy, config.size, config.overlap, vocabulary=config.vocabulary)
            chunks.withColumn("item_id", F.abs(F.xxhash64("chunk_id"))).write.mode("overwrite").parquet(f"{place}/chunks")
            Retriever(self.spark.read.parquet(f"{place}/chunks"), config, f"{place}/store").build()
            self.spark.range(1).write.mode("overwrite").parquet(f"{place}/done")  # last: a run that was cut off begins anew
            self.built += 1
        return Retriever(self.spark.read.parquet(f"{place}/chunks"), config, f"{place}/store")


def extractive_answer(answers: DataFrame) -> DataFrame:
    """The default generator: the source's sentence that shares most terms with the question, cited."""
    sentences = F.filter(F.split(F.get(F.col("contexts"), F.lit(0)), r"(?<=[.!?])\s+"), lambda s: s != "")
    scored = F.transform(sentences, lambda s: F.struct(F.size(F.array_intersect(tokens(s), tokens(F.col("question")))).alias("n"), s.alias("s")))
    best = F.aggregate(scored, F.struct(F.lit(-1).alias("n"), F.lit("").alias("s")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    return answers.withColumn("answer", F.concat(best["s"], F.lit(" [1]")))


def prompted(make: Callable[[], Callable[[str], str]], **limits) -> Callable[[DataFrame], DataFrame]:
    """A generator that renders the prompt of each question that is not blocked and sends it to a model."""

    def generate(answers: DataFrame) -> DataFrame:
        prompt = F.when(~F.col("blocked"), rendered(PROMPT, sources=F.col("sources"), question=F.col("question")))
        out = answers.withColumn("_reply", called(prompt, make, **limits))
        return out.withColumns({"answer": F.col("_reply.text"), "error": F.col("_reply.error"), "generation_ms": F.col("_reply.ms")}).drop("_reply")

    return generate


def unwritten(answers: DataFrame) -> DataFrame:
    """A generator that writes nothing: retrieval, route and sources alone."""
    return answers.withColumn("answer", F.lit(""))


def answer(questions: DataFrame, retriever: Retriever, threshold: float = 0.05, generate: Callable[[DataFrame], DataFrame] = extractive_answer) -> DataFrame:
    """(query_id, question, blocked, reason, route, answer, sources, docs, contexts, citations_valid, best) of every
    question (query_id, question).

    The retriever's chunks: (item_id, doc_id, business_line, locators, title, text).  Guards first; then search by its
    configuration, route, scope, evidence gate, generation and the check of citations.
    """
    k = retriever.config.top_k
    guarded = questions.select("query_id", "question", guards.before_retrieval(F.col("question")).alias("g"))
    open_ = guarded.where(~F.col("g.blocked")).select("query_id", "question")
    hits = retriever.retrieve(open_, max(3 * k, 15))
    placed = hits.join(retriever.chunks, "item_id")
    route = routing.decide(routing.votes(placed, top_n=1))
    scoped = routing.scope(placed, k)
    # the gate's cosines: of the few chunks in scope, embedded again only if no store holds their vectors
    held = retriever.store.items().select("item_id", "v") if retriever.store else None
    near = scoped.join(held, "item_id") if held is not None else retriever.embedder.documents(scoped, "text")
    asked = retriever.embedder.queries(open_, "question").select("query_id", "qv")
    gate = near.join(asked, "query_id").groupBy("query_id").agg(F.max(cosine(F.col("qv"), F.col("v"))).alias("best"), F.count("*").alias("n"))
    cited = scoped.withColumn("citation", citation(F.col("title"), F.get("locators", F.lit(0)), F.lit(None).cast("string")))
    blocks = guards.source_blocks(cited)
    listed = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "doc_id"))).alias("l"))  # k a question
    contexts = listed.select("query_id", F.transform("l", lambda x: x["text"]).alias("contexts"), F.transform("l", lambda x: x["doc_id"].cast("string")).alias("docs"))
    full = guarded.join(gate, "query_id", "left").join(route, "query_id", "left").join(blocks, "query_id", "left").join(contexts, "query_id", "left")
    reason = F.coalesce("g.reason", guards.evidence_gate(F.col("n"), F.col("best"), threshold))
    out = generate(full.withColumn("reason", reason).withColumn("blocked", F.col("reason").isNotNull()))
    refused = F.coalesce(F.col("g.answer"), F.lit(guards.ABSTENTION))
    out = out.withColumn("answer", F.when(F.col("blocked"), refused).otherwise(F.col("answer")))
    valid = ~F.col("blocked") & guards.citations_valid(F.col("answer"), F.coalesce(F.size("contexts"), F.lit(0)))
    more = [c for c in ("error", "generation_ms") if c in out.columns]
    return out.withColumn("citations_valid", F.coalesce(valid, F.lit(False))).select("query_id", "question", "blocked", "reason", F.when(~F.col("blocked"), F.col("route")).alias("route"), "answer", "sources", "docs", "contexts", "citations_valid", "best", *more)
