"""Routing questions to a business line by votes of hits and by the documents' own vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round6

#: Fixed value: how documents introduce a term.
DEFINITION = r"(?m)^([A-Z][A-Za-z][A-Za-z /'\-]{1,38}?)\s*(?:shall mean|means|shall be|[-–]\s)"
#: Terms too general to route by; the caller adds what else all lines share, such as the publisher's name.
GENERAL_TERMS = ["carrier", "days", "person", "property", "us", "u s", "united states of america", "currency", "numbers", "group"]


def votes(hits: DataFrame, top_n: int = 5) -> DataFrame:
    """(query_id, business_line, votes, first_rank): 1 / rank summed over the first ``top_n`` hits."""
    some = hits.where(F.col("rank") <= top_n)
    return some.groupBy("query_id", "business_line").agg(F.sum(1.0 / F.col("rank")).alias("votes"), F.min("rank").alias("first_rank"))


def with_prior(voted: DataFrame, prior: DataFrame, weight: float = 0.35) -> DataFrame:
    """Adds (query_id, business_line, prior), scaled so that all priors of a query are ``weight`` of its votes.

    Only queries with hits have a route; lines that the prior alone names come last among ties."""
    both = voted.join(prior, ["query_id", "business_line"], "full_outer")
    w = Window.partitionBy("query_id")
    scale = weight * F.sum("votes").over(w) / F.greatest(F.sum("prior").over(w), F.lit(1e-9))
    total = F.coalesce("votes", F.lit(0.0)) + F.coalesce(F.col("prior") * scale, F.lit(0.0))
    out = both.select("query_id", "business_line", total.alias("votes"), F.coalesce("first_rank", F.lit(1 << 30)).alias("first_rank"), F.max("first_rank").over(w).alias("any"))
    return out.where("any is not null").drop("any")


def decide(voted: DataFrame) -> DataFrame:
    """(query_id, route, confidence): most votes, the earliest hit among ties; its share of all votes.

    Votes are compared at six places, so that equal sums tie whatever the order of summation."""
    order = Window.partitionBy("query_id").orderBy(round6(F.col("votes")).desc(), "first_rank", "business_line")
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy("query_id"))
    ranked = voted.withColumns({"n": F.row_number().over(order), "confidence": F.coalesce(share, F.lit(0.0))})
    return ranked.where("n = 1").select("query_id", F.col("business_line").alias("route"), "confidence")


def defined_terms(units: DataFrame, skip: tuple[str, ...] = ("financial",), least: int = 4, general: tuple[str, ...] = ()) -> DataFrame:
    """(term, business_line): terms that the documents of one line only define."""
    found = units.where(~F.col("business_line").isin(*skip)).select("business_line", F.explode(F.regexp_extract_all("text", F.lit(DEFINITION), F.lit(1))).alias("raw"))
    term = F.lower(F.regexp_replace(F.regexp_replace("raw", r"^\s+|\s+$", ""), r"\s+", " "))
    lines = found.select("business_line", term.alias("term")).where((F.length("term") >= least) & ~F.col("term").isin([*GENERAL_TERMS, *general])).distinct()
    return lines.groupBy("term").agg(F.count("*").alias("n"), F.min("business_line").alias("business_line")).where("n = 1").select("term", "business_line")


def term_prior(questions: DataFrame, terms: DataFrame, most_letters: int = 40) -> DataFrame:
    """(query_id, business_line, prior): 1 + 0.4 for each blank of every defined term that a question holds as words.

    A term is held where no a-z, digit or underscore stands right before or after it; any other letter ends a word.
    The questions' pieces of up to ``most_letters``, the length that DEFINITION allows, join the terms by equality."""
    parts = F.regexp_extract_all(F.lower("question"), F.lit(r"([a-z0-9_]+|[^a-z0-9_])"), F.lit(1))
    word = lambda c: F.coalesce(F.regexp_like(c, F.lit("^[a-z0-9_]")), F.lit(False))
    ends = lambda p, last: word(F.get(p, last)) | ~word(F.get(p, last + 1))
    held = questions.select("query_id", parts.alias("p")).select("query_id", "p", F.posexplode("p").alias("i", "part")).where(word(F.col("part")))
    runs = F.transform(F.sequence(F.lit(1), F.lit(most_letters)), lambda n: F.when(ends(F.col("p"), F.col("i") + n - 1), F.array_join(F.slice("p", F.col("i") + 1, n), "")))
    held = held.select("query_id", F.explode(F.array_distinct(runs)).alias("term")).where(F.length("term") <= most_letters).distinct()
    matched = held.join(terms, "term")
    return matched.groupBy("query_id", "business_line").agg(F.sum(1 + 0.4 * (F.size(F.split("term", " ")) - 1)).alias("prior"))


def scope(hits: DataFrame, k: int) -> DataFrame:
    """Hits of the line of each query's first hit; all, if none is of that line; the best ``k``, ranked anew."""
    w = Window.partitionBy("query_id")
    first = F.first("business_line").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = hits.withColumn("on", F.coalesce(F.col("business_line") == first, F.lit(False)))
    kept = marked.withColumn("some", F.max("on").over(w)).where(F.col("on") | ~F.col("some"))
    again = kept.withColumn("rank", F.row_number().over(w.orderBy("rank")))
    return again.where(F.col("rank") <= k).drop("on", "some")
