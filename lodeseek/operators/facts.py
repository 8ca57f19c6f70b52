"""Reported facts to text records: contexts, units, labels, one record a concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import member_label, period_label, value_format

#: Names of prose elements, other names of statement lines, concepts of general interest.
NOT_FACTS = "TextBlock|PolicyText|Axis|Domain"
ALIASES = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": "total revenue, total operating revenue, operating revenue, revenues, sales, top line",
    "CostsAndExpenses": "total operating expense, total costs and expenses, operating expenses",
    "OperatingIncomeLoss": "operating income, operating profit, income from operations",
    "NetIncomeLoss": "net income, net profit, net earnings, bottom line",
    "EarningsPerShareDiluted": "diluted EPS, diluted earnings per share",
    "EarningsPerShareBasic": "basic EPS, basic earnings per share",
    "Assets": "total assets, balance sheet total",
    "Liabilities": "total liabilities",
    "StockholdersEquity": "total stockholders equity, shareholders equity, shareowners equity, book value",
    "CashAndCashEquivalentsAtCarryingValue": "cash, cash and cash equivalents, cash on hand, liquidity",
    "LongTermDebtNoncurrent": "long term debt, non-current debt",
    "OperatingLeaseLiabilityNoncurrent": "operating lease liabilities",
}
HEADLINES = [
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "CostsAndExpenses",
    "OperatingIncomeLoss",
    "NetIncomeLoss",
    "EarningsPerShareDiluted",
    "EarningsPerShareBasic",
    "Assets",
    "Liabilities",
    "StockholdersEquity",
    "CashAndCashEquivalentsAtCarryingValue",
]


def namespace_prefix(ns: Column, own: dict[str, str] | None = None) -> Column:
    """Short names of namespaces; ``own`` adds fragments of a filer's own ones."""
    out = F.when(F.contains(ns, F.lit("us-gaap")), F.lit("us-gaap")).when(F.contains(ns, F.lit("/dei/")), F.lit("dei"))
    for fragment, prefix in (own or {}).items():
        out = out.when(F.contains(ns, F.lit(fragment)), F.lit(prefix))
    last = F.element_at(F.split(F.regexp_replace(ns, "/+$", ""), "/"), -1)
    return out.when(F.contains(ns, F.lit("/srt/")), F.lit("srt")).otherwise(last)


def fact_lines(facts: DataFrame, contexts: DataFrame, units: DataFrame, labels: DataFrame | None = None, verbose: bool = False, drop_prose: bool = True) -> DataFrame:
    """(prefix, concept, pos, line) of facts (pos, prefix, concept, context_id, unit_id, value).

    contexts: (context_id, instant, start, end, members); units: (unit_id, measure).  A fact without a known context,
    without a value or with one of over 400 characters goes; a fact without a unit stays."""
    if drop_prose:
        facts = facts.where(~F.regexp_like("concept", F.lit(NOT_FACTS)))
    joined = facts.join(contexts, "context_id").join(units, "unit_id", "left")
    if labels is not None:
        # a member's name is its label, if it has one
        named = joined.select("pos", F.posexplode_outer("members").alias("i", "m")).withColumn("key", F.replace("m", F.lit(":"), F.lit("_")))
        named = named.join(labels.select("key", "label"), "key", "left").withColumn("m", F.coalesce("label", F.element_at(F.split("m", ":"), -1)))
        members = named.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("i", "m")))), lambda x: x["m"]).alias("members"))
        joined = joined.drop("members").join(members, "pos")
    else:
        joined = joined.withColumn("members", F.transform("members", lambda m: F.element_at(F.split(m, ":"), -1)))
    value = value_format(F.col("value"), F.col("measure"))
    shown = member_label(F.coalesce("members", F.array().cast("array<string>")))
    whole = "Consolidated (no segment breakdown)" if verbose else "Consolidated"
    line = F.concat(F.lit("  - "), F.when(shown == "", F.lit(whole)).otherwise(shown), F.lit(", "), period_label(F.col("instant"), F.col("start"), F.col("end"), verbose), F.lit(": "), value)
    return joined.where((value != "") & (F.length(value) <= 400)).select("prefix", "concept", "pos", line.alias("line"))


def fact_records(lines: DataFrame, labels: DataFrame, entity: str, year: str, aliases: bool = True, verbose: bool = False, page: int | None = None) -> DataFrame:
    """(locator, label, text, fact_count, headline): equal lines once, in the order of their first place.

    A concept's lines are one record; with ``page``, records of at most so many lines, the second and later ones with
    ``#2`` and so on after the locator.  Their places come from a sorted window, and no row holds more than a page."""
    once = lines.groupBy("prefix", "concept", "line").agg(F.min("pos").alias("pos"))
    at = F.row_number().over(Window.partitionBy("prefix", "concept").orderBy("pos", "line")) - 1
    once = once.withColumn("page", F.floor(at / page).cast("int") if page else F.lit(0))
    grouped = once.groupBy("prefix", "concept", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    grouped = grouped.withColumn("key", F.concat_ws("_", "prefix", "concept")).join(labels.select("key", "label"), "key", "left")
    label = F.coalesce("label", F.col("concept"))
    locator = F.concat_ws(":", "prefix", "concept")
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    also = F.when(F.lit(aliases), F.concat(F.lit("Also known as: "), F.try_element_at(names, F.col("concept")), F.lit(".")))
    # fixed values: the wording of a record's head
    if verbose:
        head = [F.lit(f"{entity} — {year} Form 10-K financial data (SEC XBRL)."), F.concat(F.lit("Financial concept: "), label, F.lit(" ("), locator, F.lit(").")), F.lit("Reported values:")]
    else:
        head = [F.concat(label, F.lit(f" — {entity} {year} Form 10-K.")), also, F.concat(F.lit("XBRL concept "), locator, F.lit("."))]
    text = F.concat_ws("\n", *head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    numbered = F.when(F.col("page") > 0, F.concat(locator, F.lit("#"), (F.col("page") + 1).cast("string"))).otherwise(locator)
    return grouped.select(numbered.alias("locator"), label.alias("label"), text.alias("text"), F.size("l").alias("fact_count"), F.col("concept").isin(HEADLINES).alias("headline"))


def record_stats(records: DataFrame, *by: str) -> DataFrame:
    """Number of records and their mean length, whole."""
    return records.groupBy(*by).agg(F.count("*").alias("records"), F.floor(F.sum(F.length("text")) / F.greatest(F.count("*"), F.lit(1))).alias("mean_chars"))


def label_map(locs: DataFrame, arcs: DataFrame, label_texts: DataFrame, standard: str = "http://www.xbrl.org/2003/role/label") -> DataFrame:
    """(key, label) from locs (loc, key), arcs (pos, source, target) and label_texts (pos, name, role, text).

    A name's text is that of the standard role (the last such), else its first; of a key's arcs the last one wins."""
    w = Window.partitionBy("name").orderBy(F.desc(F.coalesce(F.col("role") == standard, F.lit(False))), F.when(F.col("role") == standard, -F.col("pos")).otherwise(F.col("pos")))
    texts = label_texts.withColumn("n", F.row_number().over(w)).where("n = 1").select("name", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("label"))
    joined = arcs.join(locs, arcs["source"] == locs["loc"]).join(texts, arcs["target"] == texts["name"]).where("label <> ''")
    return joined.groupBy("key").agg(F.max_by("label", arcs["pos"]).alias("label"))
