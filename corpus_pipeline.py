"""Corpus preparation: quality classifier, language ID, line dedup, near-dedup, packing.

Each stage takes documents and returns documents (columns as it got them), the last one packed sequences.  Stages
decide on the whole of what their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import langid, linededup, neardup, packing, quality
from lodeseek.llm.common import cut, fold, table
from lodeseek.llm.queries import tokenizer_path

#: No SQL expresses the classifiers; tests hold the stages against brute force.
ORACLE_SQL = None



def wrapped(docs: DataFrame) -> DataFrame:
    """The rows as one column, beside what an operator reads: results cannot clash with other columns."""
    return docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang")


#: Documents whose most likely language has at least this share of their words stay; `und` has 0.
LANGUAGE_SHARE = 0.4


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as good (probability of label 1 of at least 0.7)."""
    labels = table(spark, sf_dir, "labels").where(F.coalesce(fold("doc_id", 4) != 2, F.lit(False)))
    scored = quality.score(wrapped(docs), quality.fit(docs, labels), threshold=0.7)
    return scored.where("predicted = 1").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language."""
    model = langid.fit(docs.where(F.coalesce(fold("doc_id", 5) != 0, F.lit(False))))
    named = langid.identify(wrapped(docs), model)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in ten documents or more."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = linededup.drop_common_lines(docs.select("doc_id", "text", F.struct(*rest).alias("row")), min_docs=10, min_chars=1)
    kept = kept.select("doc_id", "text", "row.*")
    if "n_chars" in rest:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id."""
    return neardup.keep_one(docs, k=5, least=0.8).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
