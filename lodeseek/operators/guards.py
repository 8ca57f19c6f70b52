"""Guards before and after retrieval, citation checks, source blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other carriers, in the order in which they are looked for, and their display names.
OTHER_CARRIERS = {
    "jetblue": "JetBlue",
    "united": "United Airlines",
    "american airlines": "American Airlines",
    "southwest": "Southwest Airlines",
    "spirit": "Spirit Airlines",
    "frontier": "Frontier Airlines",
    "alaska airlines": "Alaska Airlines",
    "cape air": "Cape Air",
    "hawaiian": "Hawaiian Airlines",
    "allegiant": "Allegiant Air",
    "lufthansa": "Lufthansa",
    "emirates": "Emirates",
    "british airways": "British Airways",
    "air canada": "Air Canada",
    "ryanair": "Ryanair",
    "easyjet": "easyJet",
}
#: Requests that need a look into an account or a booking.
LIVE_DATA = [
    r"\bmy (flight|booking|reservation|ticket|bag|baggage|shipment|claim|refund|account)\b",
    r"\bstatus of (my|the) (flight|shipment|refund|claim)\b",
    r"\b(is|was|will) my \w+",
    r"\bflight status\b",
    r"\b(cancel|rebook|change|refund|book) my\b",
    r"\bwhere is my\b",
    r"\btrack (my|this) (shipment|package|bag)\b",
    r"\bconfirmation (number|code)\b",
    r"\bcheck me in\b",
]
LIVE_DATA_PATTERN = "(?i)" + "|".join(LIVE_DATA)
REFUSAL = "I can only answer from the documents I have, and {carrier} is not in them; please ask {carrier}."
DEFLECTION = "I cannot look into bookings, flights or accounts; I answer general questions from published documents."
ABSTENTION = "The documents I have do not answer that, and I would rather not guess."


def other_carrier(question: Column) -> Column:
    """The display name of the first carrier named, in the order of the list."""
    low = F.lower(question)
    return F.coalesce(*[F.when(F.regexp_like(low, F.lit(rf"\b{name}\b")), F.lit(shown)) for name, shown in OTHER_CARRIERS.items()])


def needs_live_data(question: Column) -> Column:
    return F.coalesce(F.regexp_like(question, F.lit(LIVE_DATA_PATTERN)), F.lit(False))


def before_retrieval(question: Column) -> Column:
    """struct(blocked, reason, answer); another carrier is refused before live data is deflected."""
    carrier, live = other_carrier(question), needs_live_data(question)
    reason = F.when(carrier.isNotNull(), F.concat(F.lit("out_of_scope_carrier:"), carrier)).when(live, F.lit("requires_live_data"))
    answer = F.when(carrier.isNotNull(), F.replace(F.lit(REFUSAL), F.lit("{carrier}"), carrier)).when(live, F.lit(DEFLECTION))
    return F.struct(reason.isNotNull().alias("blocked"), reason.alias("reason"), answer.alias("answer"))


def evidence_gate(n_hits: Column, best: Column, threshold: float = 0.67) -> Column:
    """The reason to abstain: no hits, or the best cosine is too low; null lets pass, as does an unknown cosine."""
    weak = F.concat(F.lit("weak_evidence:"), F.format_number(best, 3), F.lit(f"<{threshold}"))
    return F.when(F.coalesce(n_hits, F.lit(0)) == 0, F.lit("no_hits")).when(best < threshold, weak)


def citations(answer: Column) -> Column:
    """The distinct numbers cited as [n], ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))))


def citations_valid(answer: Column, n_sources: Column) -> Column:
    """At least one citation, and none beyond the sources."""
    cited = citations(answer)
    return (F.size(cited) > 0) & (F.size(F.filter(cited, lambda c: (c < 1) | (c > n_sources))) == 0)


def source_blocks(hits: DataFrame, chars: int = 1800) -> DataFrame:
    """(query_id, sources): ``[rank] citation`` and the beginning of each hit's text, in order of rank."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("citation"), F.lit("\n"), F.left("text", F.lit(chars)))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return listed.select("query_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("sources"))


def judge_acceptance(cases: DataFrame) -> Column:
    """Whether a response (blocked, reason, route, docs, answer) behaves as its case wants (behaviour, expect_route,
    expect_doc, must_include, must_not_include)."""
    low, reason = F.lower(F.coalesce("answer", F.lit(""))), F.coalesce("reason", F.lit(""))
    refused = F.regexp_like(reason, F.lit("^(out_of_scope_carrier|no_hits|weak_evidence)"))
    disclaims = F.regexp_like(low, F.lit("do not cover|don't cover|not covered|cannot answer|can't answer|do not answer"))
    answered = ~F.col("blocked") & F.coalesce(F.col("route") == F.col("expect_route"), F.col("expect_route").isNull()) & F.coalesce(F.array_contains("docs", F.col("expect_doc")), F.col("expect_doc").isNull())
    behaves = (
        F.when(F.col("behaviour") == "answer", answered)
        .when(F.col("behaviour") == "refuse", F.col("blocked") & refused)
        .when(F.col("behaviour") == "refuse_or_disclaim", F.when(F.col("blocked"), refused).otherwise(disclaims))
        .when(F.col("behaviour") == "deflect", F.col("blocked") & F.startswith(reason, F.lit("requires_live_data")))
        .otherwise(F.lit(False))
    )
    included = F.forall("must_include", lambda x: F.contains(low, F.lower(x)))
    avoided = F.forall("must_not_include", lambda x: ~F.regexp_like(low, F.concat(F.lit(r"\b\Q"), F.lower(x), F.lit(r"\E\b"))))
    return F.coalesce(behaves & F.coalesce(included, F.lit(True)) & F.coalesce(avoided, F.lit(True)), F.lit(False))
