"""Generated answers and their judging, resumable by model and framework; acceptance runs and the label gate."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, guards
from ..operators.evaluation import hallucination_variants
from ..sources.sets import eval_set_problems, read_through
from .answer import Retriever, answer
from .models import called, rendered

Generate = Callable[[DataFrame], DataFrame]
Judge = Callable[[DataFrame], DataFrame]


def judgeable(records: DataFrame) -> DataFrame:
    """Answers that were not blocked and have contexts."""
    return records.where(~F.col("blocked") & (F.size("contexts") > 0))


def generation_sweep(models: dict[str, Generate], questions: DataFrame, retriever: Retriever, path: str) -> DataFrame:
    """The answers of every model to every question, from a cache partitioned by model; missing ones are made."""
    spark = questions.sparkSession
    wanted = questions.select("query_id", "question").crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in models], "model string")))  # a few models

    def compute(todo: DataFrame) -> DataFrame:
        out = None
        for name, generate in models.items():
            some = answer(todo.where(F.col("model") == name).select("query_id", "question"), retriever, generate=generate).withColumn("model", F.lit(name))
            out = some if out is None else out.unionByName(some, allowMissingColumns=True)
        return out

    return read_through(wanted, path, ["model", "query_id"], compute, ["model"])


def judge_sweep(frameworks: dict[str, Judge], records: DataFrame, path: str) -> DataFrame:
    """(framework, model, query_id, metrics as a map) of every judgeable record by every framework, from a cache
    partitioned by framework and model."""
    spark = records.sparkSession
    some = judgeable(records)
    wanted = some.select("model", "query_id").crossJoin(F.broadcast(spark.createDataFrame([(f,) for f in frameworks], "framework string")))

    def compute(todo: DataFrame) -> DataFrame:
        out = None
        for name, judge in frameworks.items():
            mine = some.join(todo.where(F.col("framework") == name).select("model", "query_id"), ["model", "query_id"])
            scored = judge(mine)
            metrics = [c for c in scored.columns if c not in mine.columns]
            cells = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
            rows = scored.select(F.lit(name).alias("framework"), "model", "query_id", cells.alias("metrics"))
            out = rows if out is None else out.unionByName(rows)
        return out

    return read_through(wanted, path, ["framework", "model", "query_id"], compute, ["framework", "model"])


#: Prompts of a judge model: it replies with a number from 0 to 1.
RUBRICS = {
    "faithfulness": "What share of the statements in the answer do the sources support?\n\nSources:\n{context}\n\nAnswer: {answer}\n\nReply with a number from 0 to 1 only.",
    "relevancy": "How well does the answer address the question?\n\nQuestion: {question}\n\nAnswer: {answer}\n\nReply with a number from 0 to 1 only.",
    "hallucination": "What share of the statements in the answer contradicts the sources or goes beyond them?\n\nSources:\n{context}\n\nAnswer: {answer}\n\nReply with a number from 0 to 1 only.",
    "g_eval": "Grade the answer against the ideal answer by these criteria: correct figures and conditions, nothing left out, every claim cited.\n\nQuestion: {question}\n\nIdeal answer: {ideal}\n\nAnswer: {answer}\n\nThink through each criterion, then reply with a number from 0 to 1 on the last line.",
}


def number_in(reply: Column) -> Column:
    """The last number of a reply, within 0 and 1; NaN if there is none."""
    found = F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.when(F.size(found) > 0, F.least(F.element_at(found, -1).cast("double"), F.lit(1.0))).otherwise(F.lit(float("nan")))


def model_judge(make: Callable[[], Callable[[str], str]], rubrics: dict[str, str] | None = None, **limits) -> Judge:
    """A judge that asks a model for each metric; a record whose call fails has NaN and the others go on."""

    def judge(records: DataFrame) -> DataFrame:
        out = records
        for name, rubric in (rubrics or RUBRICS).items():
            prompt = rendered(rubric, context=F.array_join("contexts", "\n\n"), question=F.col("question"), answer=F.col("answer"), ideal=F.col("ideal_answer"))
            out = out.withColumn("_r", called(prompt, make, **limits)).withColumn(name, number_in(F.col("_r.text"))).drop("_r")
        return out

    return judge


JUDGES: dict[str, Judge] = {"lexical": evaluation.judge}


def rescored(scores: DataFrame, records: DataFrame, variant: str = "gold_source", metric: str = "proxy_hallucination") -> DataFrame:
    """scores (id, ..., metric) with one metric scored anew against another context, all else kept, and where each value
    comes from in ``<metric>_context``."""
    anew = hallucination_variants(records).where(F.col("variant") == variant).select("id", F.col("score").alias("_new"))
    out = scores.join(anew, "id", "left").withColumn(f"{metric}_context", F.when(F.col("_new").isNotNull(), F.lit(variant)).otherwise(F.lit("retrieved")))
    return out.withColumn(metric, F.coalesce("_new", metric)).drop("_new")


def acceptance_run(cases: DataFrame, retriever: Retriever, **options) -> DataFrame:
    """Every case (id, question, behaviour, ...) answered and judged: (id, blocked, reason, route, answer, passed)."""
    asked = cases.withColumn("query_id", F.xxhash64("id"))
    got = answer(asked.select("query_id", "question"), retriever, **options).drop("question")
    full = asked.join(got, "query_id", "left").withColumns({"blocked": F.coalesce("blocked", F.lit(False)), "docs": F.coalesce("docs", F.array().cast("array<string>"))})
    return full.withColumn("passed", guards.judge_acceptance(full)).select("id", "behaviour", "blocked", "reason", "route", "answer", "passed")


def label_gate(questions: DataFrame, catalogue: DataFrame, units: Callable[[str], DataFrame], parsers: list[str], reference: str) -> tuple[DataFrame, DataFrame]:
    """(problems, recovery): the labels' problems against the reference parser's units (id, problem), and each parser's
    share of gold spans found (parser, recovery)."""
    spans = questions.select("id", F.col("gold_span").alias("span"))
    known = units(reference)
    missing = evaluation.missing_locators(questions, known).select("id", F.concat(F.lit("unknown locator "), "locator").alias("problem"))
    found = evaluation.span_hits(spans, known.select("doc_id", "text")).select("id", F.col("doc_id").alias("gold_doc"))
    wanted = questions.where(F.coalesce("gold_span", F.lit("")) != "").select("id", "gold_doc")
    lost = wanted.join(found, ["id", "gold_doc"], "left_anti").select("id", F.lit("span not in the document").alias("problem"))
    problems = eval_set_problems(questions, catalogue).union(missing).union(lost)
    recovery = None
    for parser in parsers:
        one = evaluation.span_recovery(spans, evaluation.span_hits(spans, units(parser).select("doc_id", "text"))).select(F.lit(parser).alias("parser"), "recovery")
        recovery = one if recovery is None else recovery.unionByName(one)
    return problems, recovery


def run_gate(*args, out=sys.stdout) -> int:
    """Prints what label_gate finds; the exit code is 1 if there is any problem."""
    problems, recovery = label_gate(*args)
    for r in recovery.collect():  # a row a parser
        print(f"{r['parser']}: {r['recovery']:.1%} of spans found", file=out)
    n = problems.count()
    for r in problems.orderBy("id", "problem").limit(50).collect():
        print(f"{r['id']}: {r['problem']}", file=out)
    print(f"{n} problems", file=out)
    return int(n > 0)
