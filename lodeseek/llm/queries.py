"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(fold(id_col, modulus) == remainder, F.lit(False)).alias("held_out")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_common_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vecdedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 5, 0))
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"), k=5, least=0.8)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=5, least=0.8)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 4, 2)))
    return score(docs.select("doc_id", "text", held_out("doc_id", 4, 2)), model).select("doc_id", "held_out", "score", "predicted")


def op9_bpe_prefix_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, tokenizer_path("word_bpe_49k.json")).drop("text")


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dac import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line,
         trim(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
),
common AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (key)
GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_approximate_nearest_neighbours, op4_embedding_near_dedup, op5_language_id, op6_license_scan, op7_minhash_near_dedup, op8_quality_classifier, op9_bpe_prefix_encoding, op10_token_id_output)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL}
