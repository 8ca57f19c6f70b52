"""Evaluation sets, acceptance tests, configurations and caches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import table_row

EVAL_SET = "id string, question string, route string, query_type string, gold_doc string, gold_locators array<string>, gold_span string, ideal_answer string, notes string"
ACCEPTANCE = "id string, question string, behaviour string, expect_route string, expect_doc string, must_include array<string>, must_not_include array<string>, rationale string"


def from_records(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    """Rows of parsed YAML or JSON; missing fields are null, notes empty, unknown fields ignored."""
    names = [c.split(" ", 1)[0] for c in schema.split(", ")]
    default = {"notes": ""}
    return spark.createDataFrame([tuple(r.get(n, default.get(n)) for n in names) for r in records], schema)


def read_yaml(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    data = yaml.safe_load(text) or []
    return from_records(spark, data[key] if key else data, schema)


def eval_set_problems(questions: DataFrame, catalogue: DataFrame, routes=("passenger", "cargo", "financial"), kinds=("keyword", "semantic")) -> DataFrame:
    """(id, problem): repeated ids, unknown routes, kinds and documents, routes that differ from the document's, no labels."""
    known = questions.join(catalogue.select(F.col("doc_id").alias("gold_doc"), "business_line"), "gold_doc", "left")
    repeated = questions.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    checks = F.array(
        F.when(~F.col("route").isin(*routes), "unknown route"),
        F.when(~F.col("query_type").isin(*kinds), "unknown query type"),
        F.when(F.col("business_line").isNull(), "unknown document"),
        F.when(F.col("business_line") != F.col("route"), "route and document differ"),
        F.when((F.coalesce(F.size("gold_locators"), F.lit(0)) <= 0) & (F.coalesce("gold_span", F.lit("")) == ""), "no label"),
    )
    found = known.select("id", F.explode(F.filter(checks, lambda p: p.isNotNull())).alias("problem"))
    return repeated.union(found)


@dataclass(frozen=True)
class PipelineConfig:
    parser: str = "article"
    strategy: str = "recursive"
    size: int = 500
    overlap: int = 50
    embedding: str = "hashed"
    store: str = "exact"
    vocabulary: str | None = None
    mode: str = "hybrid"
    fusion: str = "weighted"
    alpha: float = 0.5
    rerank: bool = False
    rerank_candidates: int = 20
    top_k: int = 5

    def index_key(self) -> tuple:
        """What an index depends on; the search mode is not among it."""
        return (self.parser, self.strategy, self.size, self.overlap, self.vocabulary, self.embedding, self.store)

    @classmethod
    def of(cls, values: dict) -> PipelineConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})

    def row(self) -> dict:
        return asdict(self)


def load_config(spark: SparkSession, path: str | None) -> PipelineConfig:
    """Unknown keys are dropped; without a file the defaults hold."""
    import json

    if not path:
        return PipelineConfig()
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return PipelineConfig()
        raise
    return PipelineConfig.of(json.loads(text))


def missing_from_cache(wanted: DataFrame, cache: DataFrame | None, key: list[str]) -> DataFrame:
    """What a resumable run has still to do."""
    return wanted if cache is None else wanted.join(cache.select(*key), key, "left_anti")


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def read_through(wanted: DataFrame, path: str, key: list[str], compute: Callable[[DataFrame], DataFrame], partition: list[str]) -> DataFrame:
    """The rows of ``wanted`` (by ``key``) from a Parquet cache, partitioned by ``partition`` (a model, or a framework
    and a model); those that it lacks are computed and added first.  A run that was cut off goes on where it ended:
    what is written is not computed again."""
    spark = wanted.sparkSession
    cache = spark.read.parquet(path) if path_exists(spark, path) else None
    todo = missing_from_cache(wanted, cache, key)
    if not todo.isEmpty():
        compute(todo).write.mode("append").partitionBy(*partition).parquet(path)
    return spark.read.parquet(path).join(wanted.select(*key).distinct(), key, "left_semi") if path_exists(spark, path) else compute(todo)


def shown(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """The cells of a table as text: null is empty, fractions have four places."""
    out = []
    for name in columns or df.columns:
        kind = df.schema[name].dataType.simpleString()
        cell = F.format_string("%.4f", F.col(name).cast("double")) if kind in ("double", "float") else F.col(name).cast("string")
        out.append(F.coalesce(F.when(F.col(name).isNotNull(), cell), F.lit("")))
    return out


def markdown_table(df: DataFrame, columns: list[str] | None = None) -> str:
    """A Markdown table of a few rows, in their order."""
    columns = columns or df.columns
    rows = [r[0] for r in df.select(table_row(*shown(df, columns))).collect()]  # a report's table
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *rows]) if rows else "_(no rows)_"


def score_rows(metrics: DataFrame, **prefix) -> DataFrame:
    """Rows for a table: the prefix columns, then the scores without the route accuracy."""
    scores = [c for c in metrics.columns if c != "route_accuracy" and c not in prefix]
    return metrics.select(*[F.lit(v).alias(k) for k, v in prefix.items()], *scores)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, wherever Spark's storage is."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jpath, True)
    out.write(text.encode("utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def save_stage(df: DataFrame, folder: str, stage: str, title: str, notes: str = "", columns: list[str] | None = None, extra: str = "") -> str:
    """Writes a stage's rows as JSON lines (folder/stage.json) and, for readers, as a Markdown page (folder/stage.md) with
    title, table, extra text and notes; returns the path of the page."""
    spark = df.sparkSession
    rows = df.cache()  # a report's few rows
    rows.coalesce(1).write.mode("overwrite").json(f"{folder}/{stage}.json")
    parts = [f"# {title}", markdown_table(rows, columns), *([extra] if extra else []), *(["## Reading of these numbers", notes] if notes else [])]
    write_text(spark, f"{folder}/{stage}.md", "\n\n".join(parts) + "\n")
    rows.unpersist()
    return f"{folder}/{stage}.md"


def build_report(spark: SparkSession, template: str, folder: str, out: str) -> list[str]:
    """Puts the pages of a folder's stages where a template names them as {{stage}}; the stage's title goes and its
    headings sink by two levels.  Returns the stages that have no page; a line in the report says so."""
    import re

    missing: list[str] = []

    def body(m: re.Match) -> str:
        name = m[1].strip()
        if not path_exists(spark, f"{folder}/{name}.md"):
            missing.append(name)
            return f"_No results of {name} yet._"
        lines = read_text(spark, f"{folder}/{name}.md").strip().split("\n")
        lines = lines[1:] if lines[0].startswith("# ") else lines
        return "\n".join("##" + x if x.startswith("#") else x for x in lines).strip()

    write_text(spark, out, re.sub(r"\{\{([^{}]+)\}\}", body, template))
    return missing


def refresh_notes(spark: SparkSession, folder: str, stage: str, title: str, by: list[str], notes: Callable[[dict], str]) -> str:
    """Writes a stage's page anew from its saved rows, with notes told from the best row by ``by``; nothing is run."""
    rows = spark.read.json(f"{folder}/{stage}.json")
    best = rows.orderBy(*[F.desc(c) for c in by]).limit(1).collect()[0].asDict()
    pages = [f"# {title}", markdown_table(rows), "## Reading of these numbers", notes(best)]
    write_text(spark, f"{folder}/{stage}.md", "\n\n".join(pages) + "\n")
    return f"{folder}/{stage}.md"
