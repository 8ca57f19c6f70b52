"""Labels against the corpus, thresholds, winners, model statistics, judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def missing_locators(questions: DataFrame, units: DataFrame) -> DataFrame:
    """(id, gold_doc, locator) of labels that name no unit."""
    wanted = questions.select("id", "gold_doc", F.explode("gold_locators").alias("locator"))
    known = units.select(F.col("doc_id").alias("gold_doc"), "locator")
    return wanted.join(known, ["gold_doc", "locator"], "left_anti")


def span_hits(spans: DataFrame, units: DataFrame) -> DataFrame:
    """(id, doc_id) of every document with a unit that holds a span (id, span).

    A unit that holds a span holds its longest word: spans and units meet on that word, and only then is the whole
    span looked for.  Spans without a word of two letters are compared with every unit.
    """
    w = F.array_sort(F.array_distinct(tokens(F.col("span"))), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    inner = F.filter(w, lambda t: F.regexp_like("span", F.concat(F.lit(r"(?iu)[^\p{L}\p{N}_]\Q"), t, F.lit(r"\E[^\p{L}\p{N}_]"))))
    keyed = spans.withColumn("term", F.get(inner, F.lit(0)))
    cells = units.select("doc_id", F.col("text").alias("unit"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = keyed.where("term is not null")
    cells = cells.join(wanted.select("term").distinct(), "term", "left_semi")
    hit = wanted.join(cells, "term").where(F.contains("unit", F.col("span"))).select("id", "doc_id")
    rest = keyed.where("term is null").join(units, F.contains(units["text"], keyed["span"])).select("id", "doc_id")
    return hit.unionByName(rest).distinct()


def span_recovery(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: the share of questions whose span some document holds (0 without questions)."""
    found = questions.select("id").join(hits.select("id").distinct().withColumn("found", F.lit(1)), "id", "left")
    return found.agg(F.count("*").alias("total"), F.coalesce(F.avg(F.coalesce("found", F.lit(0)).cast("double")), F.lit(0.0)).alias("recovery"))


def threshold_sweep(scores: DataFrame, low: float = 0.55, step: float = 0.02, n: int = 17) -> DataFrame:
    """(threshold, answered, refused, total) for scores (answerable, score): shares of either class by threshold."""
    grid = scores.sparkSession.range(n).select(F.round(F.lit(low) + F.col("id") * step, 3).alias("threshold"))
    cells = scores.crossJoin(F.broadcast(grid))  # n thresholds, a fixed number
    share = lambda cond, over: F.coalesce(F.avg(F.when(over, cond.cast("double"))), F.lit(0.0))
    passed = F.col("score") >= F.col("threshold")
    out = cells.groupBy("threshold").agg(share(passed, F.col("answerable")).alias("answered"), share(~passed, ~F.col("answerable")).alias("refused"))
    return out.withColumn("total", F.col("answered") + F.col("refused"))


def threshold_select(sweep: DataFrame) -> DataFrame:
    """Among thresholds that refuse no answerable question, or all if none: most refusals, then most answers, then the lowest."""
    whole = F.max(F.col("answered") >= 1.0).over(Window.partitionBy(F.lit(1)))
    eligible = sweep.withColumn("some", whole).where((F.col("answered") >= 1.0) | ~F.col("some")).drop("some")
    return eligible.orderBy(F.desc("refused"), F.desc("answered"), "threshold").limit(1)


def winner(rows: DataFrame, by: list[str], *measures: str, order: str) -> DataFrame:
    """The row of each group with the lexicographically largest measures, the first in ``order`` among ties."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(m) for m in measures], order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fusion_choice(rows: DataFrame) -> DataFrame:
    """(fusion, alpha, r_at_3, ...): rank fusion if it is among the best, else the best weighted setting."""
    best = rows.agg(F.max("r_at_3").alias("best"))
    near = rows.crossJoin(F.broadcast(best)).where(F.col("r_at_3") >= F.col("best"))  # one row
    return near.orderBy(F.desc(F.col("fusion") == "rrf"), F.desc("mrr_at_10"), F.desc("ndcg_at_3"), "alpha").limit(1).drop("best")


def model_stats(answers: DataFrame) -> DataFrame:
    """Per model (model, ms, answer, citations_valid, blocked): means over answers that were not blocked, and counts."""
    free = ~F.col("blocked")
    return answers.groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("blocked")).alias("n_blocked"),
        F.try_divide(F.sum(F.when(free, F.col("ms"))), F.greatest(F.count_if(free), F.lit(1))).alias("mean_ms"),
        F.try_divide(F.sum(F.when(free, F.length("answer"))), F.greatest(F.count_if(free), F.lit(1))).alias("mean_chars"),
        F.try_divide(F.count_if(free & F.col("citations_valid")), F.greatest(F.count_if(free), F.lit(1))).alias("citation_rate"),
    )


def lexical_overlap(part: Column, whole: Column) -> Column:
    """Share of the terms of ``part`` that occur in ``whole``: a proxy where a judge model would score."""
    a = F.array_distinct(tokens(part))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, F.array_distinct(tokens(whole)))), F.size(a)), F.lit(0.0))


def judge(records: DataFrame) -> DataFrame:
    """Proxies, named as such, for (question, answer, contexts, ideal_answer): no judge model runs here."""
    context = F.array_join("contexts", "\n")
    return records.withColumns({
        "proxy_faithfulness": lexical_overlap(F.col("answer"), context),
        "proxy_relevancy": lexical_overlap(F.col("question"), F.col("answer")),
        "proxy_context_precision": F.coalesce(F.try_divide(F.size(F.filter("contexts", lambda c: lexical_overlap(F.col("ideal_answer"), c) >= 0.3)), F.size("contexts")), F.lit(0.0)),
        "proxy_context_recall": lexical_overlap(F.col("ideal_answer"), context),
        "proxy_hallucination": 1 - lexical_overlap(F.col("answer"), context),
    })


def hallucination_variants(records: DataFrame) -> DataFrame:
    """(id, variant, score): the hallucination proxy against what was retrieved, the ideal answer and the gold source."""
    against = {"retrieved": F.array_join("contexts", "\n"), "ideal_answer": F.col("ideal_answer"), "gold_source": F.coalesce("gold_text", "ideal_answer")}
    cells = F.array(*[F.struct(F.lit(n).alias("variant"), (1 - lexical_overlap(F.col("answer"), c)).alias("score")) for n, c in against.items()])
    return records.select("id", F.explode(cells).alias("v")).select("id", "v.*")


def judge_means(scores: DataFrame, *metrics: str) -> DataFrame:
    """Per model, the mean of each metric over the records that were judged: NaN and null are failures; NaN if all failed."""
    nan = F.lit(float("nan"))
    return scores.groupBy("model").agg(*[F.coalesce(F.avg(F.when(~F.isnan(m), F.col(m))), nan).alias(m) for m in metrics])


def with_provenance(metric: Column, context: Column, wanted: str = "gold_source") -> Column:
    """A metric counts only if it was scored against the wanted context."""
    return F.when(F.startswith(context, F.lit(wanted)), metric)


def gold_text(questions: DataFrame, units: DataFrame, sep: str = "\n") -> DataFrame:
    """(id, gold_text): the units at a question's gold locators, in order; its ideal answer if there are none."""
    wanted = questions.select("id", F.col("gold_doc").alias("doc_id"), F.posexplode("gold_locators").alias("i", "locator"))
    found = wanted.join(units.select("doc_id", "locator", "text"), ["doc_id", "locator"])
    texts = found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), sep).alias("t"))
    return questions.join(texts, "id", "left").select("id", F.coalesce("t", "ideal_answer").alias("gold_text"))


def confidence_summary(scores: DataFrame) -> DataFrame:
    """Ranges of both classes (answerable, score), and whether they overlap."""
    at = lambda f, yes: f(F.when(F.col("answerable") == yes, F.col("score")))
    out = scores.agg(*[at(f, yes).alias(f"{f.__name__}_{name}") for f in (F.min, F.avg, F.max) for yes, name in ((True, "answerable"), (False, "unanswerable"))])
    return out.withColumn("overlap", F.coalesce(F.col("max_unanswerable") >= F.col("min_answerable"), F.lit(False)))


def route_accuracy(top: DataFrame, catalogue: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, route, right): the line of each query's first document; unknown without a hit or for an unlisted document."""
    named = top.join(catalogue, "doc_id", "left").select("query_id", F.coalesce("business_line", F.lit("unknown")).alias("route"))
    full = gold.join(named, "query_id", "left").withColumn("route", F.coalesce("route", F.lit("unknown")))
    return full.select("query_id", "route", (F.col("route") == F.col("business_line")).alias("right"))
