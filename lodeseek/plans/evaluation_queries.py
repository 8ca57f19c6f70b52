"""Queries on labels, facts, experiment tables, formats, configurations and acceptance tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.text import round6
from ..operators import evaluation, facts, guards
from ..operators import ranking
from ..sources import sets, xbrl
from ..sources.scratch import scratch
from .corpus_queries import SQL_UNITS, _units
from .registry import query, table
from .search_queries import r6

# --- labels -------------------------------------------------------------------------------------------------------

SQL_LABELLED = "labelled AS (SELECT item_id AS id, item_id * 3 AS gold_doc, ['p' || (item_id % 9 + 1), 'p' || (item_id % 40 + 1)] AS gold_locators, text AS span FROM benchmark)"


def labelled(spark, d) -> DataFrame:
    locs = F.array(F.concat(F.lit("p"), (F.col("item_id") % 9 + 1).cast("string")), F.concat(F.lit("p"), (F.col("item_id") % 40 + 1).cast("string")))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") * 3).alias("gold_doc"), locs.alias("gold_locators"), F.col("text").alias("span"))


@query(f"WITH {SQL_UNITS}, {SQL_LABELLED} SELECT id, gold_doc, locator FROM (SELECT id, gold_doc, unnest(gold_locators) AS locator FROM labelled) l WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.doc_id = l.gold_doc AND u.locator = l.locator)")
def label_missing_locators(spark, d):
    return evaluation.missing_locators(labelled(spark, d), _units(spark, d))


SQL_SPANS = "spans AS (SELECT DISTINCT b.item_id AS id, doc_id FROM benchmark b JOIN documents ON contains(documents.text, b.text))"


def _spans(spark, d) -> DataFrame:
    return evaluation.span_hits(labelled(spark, d).select("id", "span"), table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {SQL_SPANS} SELECT id, doc_id FROM spans")
def label_span_check(spark, d):
    return _spans(spark, d)


@query(f"WITH {SQL_SPANS} SELECT count(*) AS total, {r6('avg(CASE WHEN item_id IN (SELECT id FROM spans) THEN 1.0::DOUBLE ELSE 0 END)')} AS recovery FROM benchmark")
def span_recovery(spark, d):
    return evaluation.span_recovery(labelled(spark, d), _spans(spark, d)).select("total", round6(F.col("recovery")).alias("recovery"))


@query("""SELECT coalesce(lang, '*') AS route, coalesce(source, '*') AS query_type, count(*) AS n, count(quality) AS labelled, coalesce(sum(quality), 0)::BIGINT AS good
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())""")
def eval_summary_grouping_sets(spark, d):
    table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").createOrReplaceTempView("lodeseek_summary")
    return spark.sql("""SELECT coalesce(lang, '*') AS route, coalesce(source, '*') AS query_type, count(*) AS n, count(quality) AS labelled, coalesce(sum(quality), 0) AS good
      FROM lodeseek_summary GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())""")


@query("""SELECT doc_id % 2 AS fold, lang, quality, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, floor(avg(n_chars) * 1e6 + 0.5) / 1e6 AS mean_chars
FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def per_question_detail(spark, d):
    b = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    by = [(F.col("doc_id") % 2).alias("fold"), "lang", "quality"]
    return b.groupBy(*by).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), round6(F.avg("n_chars")).alias("mean_chars"))


# --- facts: line items of orders as reported values of a brand ----------------------------------------------------

SQL_FACTS = """f AS (SELECT l_orderkey * 10 + l_linenumber AS pos, p_brand AS concept, l_orderkey AS context_id, CASE l_linenumber % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'shares' ELSE NULL END AS measure,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(l_quantity * 100000 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS v, strftime(o_orderdate, '%Y-%m') || '-01' AS instant
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
lines AS (SELECT concept, pos, '  - Consolidated, as of ' || instant || ': ' || CASE
   WHEN measure = 'usd' AND v >= 1000000 THEN 'USD ' || format('{:,.0f}', v::DOUBLE) || ' (' || format('{:,.1f}', v / 1e6::DOUBLE) || ' million)'
   WHEN measure = 'usd' THEN 'USD ' || format('{:,.2f}', v::DOUBLE) WHEN measure = 'shares' THEN format('{:,.0f}', v::DOUBLE) || ' shares' ELSE format('{:,.0f}', v::DOUBLE) END AS line FROM f),
once AS (SELECT concept, line, min(pos) AS pos FROM lines GROUP BY ALL)"""


@query(f"""WITH {SQL_FACTS} SELECT 'tpch:' || concept AS locator, concept AS label, concept || ' — Example FY1998 Form 10-K.' || chr(10) || 'XBRL concept tpch:' || concept || '.' || chr(10) || string_agg(line, chr(10) ORDER BY pos, line) AS text,
count(*) AS fact_count, FALSE AS headline FROM once GROUP BY concept""")
def fact_records(spark, d):
    out = facts.fact_records(_lines(spark, d), spark.createDataFrame([], "key string, label string"), "Example", "FY1998")
    return out.withColumn("fact_count", F.col("fact_count").cast("long"))


def _lines(spark, d) -> DataFrame:
    li, orders, part = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    kind = F.col("l_linenumber") % 3
    value = F.when(kind == 0, (F.col("l_quantity") * 100000).cast("long")).otherwise(F.col("l_quantity").cast("long")).cast("string")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.lit("tpch").alias("prefix"), F.col("p_brand").alias("concept"), F.col("l_orderkey").alias("context_id"), F.when(kind == 0, "u0").when(kind == 1, "u1").alias("unit_id"), value.alias("value"))
    none = F.lit(None).cast("string")
    contexts = orders.select(F.col("o_orderkey").alias("context_id"), F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-01")).alias("instant"), none.alias("start"), none.alias("end"), F.array().cast("array<string>").alias("members"))
    units = spark.createDataFrame([("u0", "usd"), ("u1", "shares")], "unit_id string, measure string")
    return facts.fact_lines(rows, contexts, units)


@query(f"""WITH {SQL_FACTS}, paged AS (SELECT *, (row_number() OVER (PARTITION BY concept ORDER BY pos, line) - 1) // 200 AS page FROM once)
SELECT 'tpch:' || concept || CASE WHEN page > 0 THEN '#' || CAST(page + 1 AS BIGINT) ELSE '' END AS locator, concept AS label, concept || ' — Example FY1998 Form 10-K.' || chr(10) || 'XBRL concept tpch:' || concept || '.' || chr(10) || string_agg(line, chr(10) ORDER BY pos, line) AS text,
count(*) AS fact_count, FALSE AS headline FROM paged GROUP BY concept, page""")
def fact_records_paged(spark, d):
    """Records of at most 200 lines: no row grows with the facts of its concept."""
    out = facts.fact_records(_lines(spark, d), spark.createDataFrame([], "key string, label string"), "Example", "FY1998", page=200)
    return out.withColumn("fact_count", F.col("fact_count").cast("long"))


VALUES = [(1, "63364000000", "usd"), (2, "5000000", "usd"), (3, "7.66", "usdPerShare"), (4, "1200", "shares"), (5, "3.0", None), (6, "3.14159", None), (7, "abc", "usd"), (8, "-2000000000", "USD"), (9, " 12 ", None), (10, "", None)]
SQL_VALUES = "vals(id, raw, unit) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{r}', {'NULL' if u is None else repr(u)})" for i, r, u in VALUES) + " ), allv AS (SELECT * FROM vals UNION ALL SELECT o_orderkey * 100, CAST(CAST(floor(o_totalprice) AS BIGINT) * 100 AS VARCHAR), CASE o_orderkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'shares' END FROM orders)"


@query(rf"""WITH {SQL_VALUES}, p AS (SELECT id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t, lower(coalesce(unit, '')) AS u, TRY_CAST(regexp_replace(raw, '^\s+|\s+$', '', 'g') AS DOUBLE) AS x FROM allv)
SELECT id, CASE WHEN x IS NULL THEN t WHEN contains(u, 'usd') AND abs(x) >= 1e9 THEN 'USD ' || format('{{:,.0f}}', x) || ' (' || format('{{:,.2f}}', x / 1e9::DOUBLE) || ' billion)' WHEN contains(u, 'usd') AND abs(x) >= 1e6 THEN 'USD ' || format('{{:,.0f}}', x) || ' (' || format('{{:,.1f}}', x / 1e6::DOUBLE) || ' million)'
WHEN contains(u, 'usd') THEN 'USD ' || format('{{:,.2f}}', x) WHEN contains(u, 'shares') THEN format('{{:,.0f}}', x) || ' shares' WHEN x = floor(x) THEN format('{{:,.0f}}', x) ELSE format('{{:,.2f}}', x) END AS value FROM p""")
def value_format(spark, d):
    unit = F.when(F.col("o_orderkey") % 3 == 0, "usd").when(F.col("o_orderkey") % 3 == 1, "shares")
    orders = table(spark, d, "orders").select((F.col("o_orderkey") * 100).alias("id"), (F.floor("o_totalprice").cast("long") * 100).cast("string").alias("raw"), unit.alias("unit"))
    rows = spark.createDataFrame(VALUES, "id long, raw string, unit string").unionByName(orders)
    return rows.select("id", formats.value_format(F.col("raw"), F.col("unit")).alias("value"))


@query("""WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS instant,
  CASE WHEN o_orderkey % 5 IN (1, 2) THEN strftime(o_orderdate, '%Y') || '-01-01' WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS s,
  CASE WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y') || '-12-31' WHEN o_orderkey % 5 = 2 THEN '2001-12-31' WHEN o_orderkey % 5 = 3 THEN '2002-06-30' END AS e FROM orders)
SELECT id, CASE WHEN instant IS NOT NULL THEN 'as of ' || instant WHEN s IS NULL OR e IS NULL THEN 'period not stated' WHEN s LIKE '%-01-01' AND e LIKE '%-12-31' AND left(s, 4) = left(e, 4) THEN 'FY' || left(s, 4) ELSE s || ' to ' || e END AS period FROM p""")
def period_label(spark, d):
    k, day, year = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy")
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, day).alias("i"), F.when(k.isin(1, 2), F.concat(year, F.lit("-01-01"))).when(k == 3, day).alias("s"),
        F.when(k == 1, F.concat(year, F.lit("-12-31"))).when(k == 2, "2001-12-31").when(k == 3, "2002-06-30").alias("e"))
    return rows.select("id", formats.period_label(F.col("i"), F.col("s"), F.col("e")).alias("period"))


# --- experiment tables --------------------------------------------------------------------------------------------

SQL_RUNS = """runs AS (SELECT p_partkey AS id, p_brand AS stage, p_container AS fusion_, (p_size % 10) / 10.0::DOUBLE AS r_at_3, (p_partkey * 7 % 100) / 100.0::DOUBLE AS mrr_at_10, (p_partkey * 13 % 100) / 100.0::DOUBLE AS ndcg_at_3, (p_partkey % 9 + 1) / 10.0::DOUBLE AS alpha FROM part)"""


def _runs(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("stage"), (F.col("p_size") % 10 / F.lit(10.0)).alias("r_at_3"), (k * 7 % 100 / F.lit(100.0)).alias("mrr_at_10"), (k * 13 % 100 / F.lit(100.0)).alias("ndcg_at_3"), ((k % 9 + 1) / F.lit(10.0)).alias("alpha"))


@query(f"WITH {SQL_RUNS.replace('p_container AS fusion_, ', '')} SELECT stage, id, r_at_3, mrr_at_10, ndcg_at_3 FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY r_at_3 DESC, mrr_at_10 DESC, ndcg_at_3 DESC, id) AS n FROM runs) WHERE n = 1")
def winner_select(spark, d):
    return evaluation.winner(_runs(spark, d), ["stage"], "r_at_3", "mrr_at_10", "ndcg_at_3", order="id").select("stage", "id", "r_at_3", "mrr_at_10", "ndcg_at_3")


@query(f"""WITH {SQL_RUNS.replace('p_container AS fusion_, ', '')}, r AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'rrf' ELSE 'weighted' END AS fusion FROM runs)
SELECT fusion, alpha, r_at_3, mrr_at_10 FROM r WHERE r_at_3 >= (SELECT max(r_at_3) FROM r) ORDER BY fusion = 'rrf' DESC, mrr_at_10 DESC, ndcg_at_3 DESC, alpha LIMIT 1""")
def fusion_tiebreak(spark, d):
    rows = _runs(spark, d).withColumn("fusion", F.when(F.col("id") % 4 == 0, "rrf").otherwise("weighted"))
    return evaluation.fusion_choice(rows).select("fusion", "alpha", "r_at_3", "mrr_at_10")


@query(f"""WITH a AS (SELECT role AS model, conv_id + turn * 3 AS ms, text AS answer, turn % 2 = 0 AS ok, conv_id % 7 = 0 AS blocked FROM conversations)
SELECT model, count(*) AS n, count(*) FILTER (WHERE blocked) AS n_blocked, {r6('sum(CASE WHEN NOT blocked THEN ms ELSE 0 END)::DOUBLE / greatest(count(*) FILTER (WHERE NOT blocked), 1)')} AS mean_ms,
{r6('sum(CASE WHEN NOT blocked THEN length(answer) ELSE 0 END)::DOUBLE / greatest(count(*) FILTER (WHERE NOT blocked), 1)')} AS mean_chars, {r6('count(*) FILTER (WHERE NOT blocked AND ok)::DOUBLE / greatest(count(*) FILTER (WHERE NOT blocked), 1)')} AS citation_rate FROM a GROUP BY model""")
def model_stats(spark, d):
    a = table(spark, d, "conversations").select(F.col("role").alias("model"), (F.col("conv_id") + F.col("turn") * 3).alias("ms"), F.col("text").alias("answer"), (F.col("turn") % 2 == 0).alias("citations_valid"), (F.col("conv_id") % 7 == 0).alias("blocked"))
    return evaluation.model_stats(a).select("model", "n", "n_blocked", *[round6(F.col(c)).alias(c) for c in ("mean_ms", "mean_chars", "citation_rate")])


@query("SELECT p_partkey AS id, 'article | recursive/' || p_size || ' | ' || p_brand || ' | a=' || format('{:,.2f}', (p_partkey % 9 + 1) / 10.0::DOUBLE) AS label FROM part")
def config_label(spark, d):
    alpha = F.concat(F.lit("a="), F.format_number((F.col("p_partkey") % 9 + 1) / F.lit(10.0), 2))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), formats.config_label(F.lit("article"), F.concat(F.lit("recursive/"), F.col("p_size").cast("string")), F.col("p_brand"), alpha).alias("label"))


@query("""SELECT n_nationkey AS id, '| ' || n_name || ' | ' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE format('{:,.4f}', n_nationkey / 7.0::DOUBLE) END || ' |' AS row_ FROM nation""")
def markdown_rows(spark, d):
    x = F.when(F.col("n_nationkey") % 3 != 0, F.format_number(F.col("n_nationkey") / F.lit(7.0), 4))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), formats.table_row(F.col("n_name"), x).alias("row_"))


@query("""SELECT n_nationkey AS id, '{"name":"' || n_name || '","key":' || n_nationkey || '}' AS json FROM nation""")
def json_rows(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))).alias("json"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.mode'), 'hybrid') AS mode FROM events""")
def config_scan_defaults(spark, d):
    """Known fields of a JSON text, others dropped, defaults for what is missing."""
    c = F.from_json("props", "k long, mode string")
    return table(spark, d, "events").select("event_id", F.coalesce(c["k"], F.lit(0)).alias("k"), F.coalesce(c["mode"], F.lit("hybrid")).alias("mode"))


@query("""SELECT replace(role || ':' || turn, ':', '_') AS slug, count(*) AS n FROM conversations GROUP BY ALL""")
def model_slug(spark, d):
    return table(spark, d, "conversations").groupBy(formats.slug(F.concat("role", F.lit(":"), F.col("turn").cast("string"))).alias("slug")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, chip FROM (SELECT conv_id, turn, unnest(string_split(regexp_replace(text || ' [1] see [22].', '(\\[\\d+\\])', chr(1) || '\\1' || chr(1), 'g'), chr(1))) AS chip FROM conversations) WHERE chip <> ''""".replace("\\\\", "\\"))
def citation_chips(spark, d):
    marked = F.regexp_replace(F.concat("text", F.lit(" [1] see [22].")), r"(\[\d+\])", "\x01$1\x01")
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split(marked, "\x01")).alias("chip")).where("chip <> ''")


# --- acceptance ---------------------------------------------------------------------------------------------------

CASES = [
    {"id": "A1", "behaviour": "answer", "expect_route": "en", "expect_doc": "d1", "must_include": ["Fee"], "must_not_include": ["united"]},
    {"id": "A2", "behaviour": "answer", "expect_route": "de"},
    {"id": "R1", "behaviour": "refuse"},
    {"id": "R2", "behaviour": "refuse_or_disclaim", "must_not_include": ["guess"]},
    {"id": "D1", "behaviour": "deflect"},
    {"id": "X1", "behaviour": "other"},
]
RESPONSES = [
    ("A1", False, None, "en", ["d1", "d2"], "The fee is 5 in the United States [1]"),
    ("A1", False, None, "en", ["d1"], "The fee is 5 [1]"),
    ("A2", False, None, "en", ["d1"], "Text [1]"),
    ("A2", True, "no_hits", None, [], "none"),
    ("R1", True, "out_of_scope_carrier:JetBlue", None, [], "no"),
    ("R1", True, "requires_live_data", None, [], "no"),
    ("R2", False, None, "en", ["d1"], "The documents do not cover that [1]"),
    ("R2", False, None, "en", ["d1"], "I guess the documents do not cover that [1]"),
    ("D1", True, "requires_live_data", None, [], "no"),
    ("X1", False, None, "en", ["d1"], "x"),
]
PASSED = [False, True, False, False, True, False, True, False, True, False]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', {i}::BIGINT, {p})" for i, (r, p) in enumerate(zip(RESPONSES, PASSED, strict=True))) + ') t(id, n, "pass")')
def acceptance_eval(spark, d):
    cases = sets.from_records(spark, CASES, sets.ACCEPTANCE)
    got = spark.createDataFrame([(*r, i) for i, r in enumerate(RESPONSES)], "id string, blocked boolean, reason string, route string, docs array<string>, answer string, n long")
    full = got.join(cases, "id")
    return full.select("id", "n", guards.judge_acceptance(full).alias("pass"))


@query("""SELECT CASE WHEN id LIKE 'A%' THEN 'required' ELSE 'other' END AS kind, count(*) AS n, count(*) FILTER (WHERE "pass") AS passed FROM (VALUES """ + ", ".join(f"('{r[0]}', {p})" for r, p in zip(RESPONSES, PASSED, strict=True)) + """) t(id, "pass") GROUP BY 1""")
def acceptance_counts(spark, d):
    kind = F.when(F.startswith("id", F.lit("A")), "required").otherwise("other").alias("kind")
    return acceptance_eval(spark, d).groupBy(kind).agg(F.count("*").alias("n"), F.count_if("pass").alias("passed"))


EVAL_ROWS = [
    {"id": "P1", "question": "q", "route": "passenger", "query_type": "keyword", "gold_doc": "d1", "gold_locators": ["p1"]},
    {"id": "P1", "question": "q", "route": "cargo", "query_type": "semantic", "gold_doc": "d1", "gold_locators": ["p1"]},
    {"id": "C1", "question": "q", "route": "train", "query_type": "fuzzy", "gold_doc": "d9", "gold_span": ""},
]


@query("""SELECT * FROM (VALUES ('P1', 'duplicate id'), ('P1', 'route and document differ'), ('C1', 'unknown route'), ('C1', 'unknown query type'), ('C1', 'unknown document'), ('C1', 'no label')) t(id, problem)""")
def eval_set_validation(spark, d):
    catalogue = spark.createDataFrame([("d1", "passenger")], "doc_id string, business_line string")
    return sets.eval_set_problems(sets.from_records(spark, EVAL_ROWS, sets.EVAL_SET), catalogue)


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def cache_missing(spark, d):
    return sets.missing_from_cache(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query(f"SELECT lang, count(*) AS records, CAST(floor(sum(length(text)) / greatest(count(*), 1)) AS BIGINT) AS mean_chars FROM documents GROUP BY lang")
def record_stats(spark, d):
    return facts.record_stats(table(spark, d, "documents").select("lang", "text"), "lang")


# --- XML sources --------------------------------------------------------------------------------------------------

INSTANCE = """<?xml version="1.0"?>
<x:xbrl xmlns:x="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:us-gaap="http://fasb.org/us-gaap/2025">
<x:context id="c1"><x:entity/><x:period><x:startDate>2025-01-01</x:startDate><x:endDate>2025-12-31</x:endDate></x:period></x:context>
<x:context id="c2"><x:entity><x:segment><xbrldi:explicitMember dimension="d">co:NorthMember</xbrldi:explicitMember></x:segment></x:entity><x:period><x:instant>2025-06-30</x:instant></x:period></x:context>
<x:unit id="usd"><x:measure>iso4217:USD</x:measure></x:unit>
<us-gaap:Assets contextRef="c2" unitRef="usd" decimals="0">5000000</us-gaap:Assets>
<us-gaap:NetIncomeLoss contextRef="c1" unitRef="usd">63364000000</us-gaap:NetIncomeLoss>
<us-gaap:NetIncomeLoss contextRef="c1" unitRef="usd">63364000000</us-gaap:NetIncomeLoss>
<us-gaap:SomeTextBlock contextRef="c1">prose</us-gaap:SomeTextBlock>
<us-gaap:Liabilities contextRef="c9" unitRef="usd">1</us-gaap:Liabilities>
<us-gaap:Empty contextRef="c1"/>
</x:xbrl>
"""
LINKBASE = """<?xml version="1.0"?>
<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"><link:labelLink>
<link:loc xlink:href="a.xsd#us-gaap_NetIncomeLoss" xlink:label="l1"/>
<link:loc xlink:href="a.xsd#co_NorthMember" xlink:label="l2"/>
<link:label xlink:label="t1" xlink:role="http://www.xbrl.org/2003/role/terseLabel">Short</link:label>
<link:label xlink:label="t1" xlink:role="http://www.xbrl.org/2003/role/label">Net income (loss)</link:label>
<link:label xlink:label="t2" xlink:role="http://www.xbrl.org/2003/role/label">North [Member]</link:label>
<link:labelArc xlink:from="l1" xlink:to="t1"/>
<link:labelArc xlink:from="l2" xlink:to="t2"/>
</link:labelLink></link:linkbase>
"""


def _written(spark, name: str, text: str) -> str:
    """The literal file where Spark's readers find it."""
    path = scratch(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


def _labels(spark) -> DataFrame:
    return facts.label_map(*xbrl.linkbase(spark, _written(spark, "linkbase", LINKBASE)))


@query("SELECT * FROM (VALUES ('us-gaap_NetIncomeLoss', 'Net income (loss)'), ('co_NorthMember', 'North [Member]')) t(key, label)")
def label_linkbase_join(spark, d):
    return _labels(spark).select("key", "label")


@query("""SELECT * FROM (VALUES
('us-gaap:Assets', 'Assets', 'Assets — Example FY2025 Form 10-K.' || chr(10) || 'Also known as: total assets, balance sheet total.' || chr(10) || 'XBRL concept us-gaap:Assets.' || chr(10) || '  - North, as of 2025-06-30: USD 5,000,000 (5.0 million)', 1::BIGINT, TRUE),
('us-gaap:NetIncomeLoss', 'Net income (loss)', 'Net income (loss) — Example FY2025 Form 10-K.' || chr(10) || 'Also known as: net income, net profit, net earnings, bottom line.' || chr(10) || 'XBRL concept us-gaap:NetIncomeLoss.' || chr(10) || '  - Consolidated, FY2025: USD 63,364,000,000 (63.36 billion)', 1::BIGINT, TRUE)) t(locator, label, text, fact_count, headline)""")
def xbrl_parse(spark, d):
    path = _written(spark, "instance", INSTANCE)
    labels = _labels(spark)
    lines = facts.fact_lines(xbrl.facts(spark, path), xbrl.contexts(spark, path), xbrl.units(spark, path), labels)
    return facts.fact_records(lines, labels, "Example", "FY2025").withColumn("fact_count", F.col("fact_count").cast("long"))


# --- facts and labels of a table, written as files and read again ---------------------------------------------------


def _instance_of_parts(spark, d) -> str:
    """An instance document with a context and a fact for each part, in four namespaces, one of them the filer's own."""
    part = table(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("value"))
    ns = F.element_at(F.array(*[F.lit(x) for x in ("us-gaap", "dei", "srt", "own")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    rows = part.select(F.col("p_partkey").alias("key"), F.concat(
        F.lit("<context id=\"c"), key, F.lit("\"><period><instant>2025-06-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit("</instant></period></context>"),
        F.lit("<"), ns, F.lit(":Concept"), (F.col("p_size")).cast("string"), F.lit(" unitRef=\"usd\" contextRef=\"c"), key, F.lit("\" decimals=\"2\">"), F.col("value"), F.lit("</"), ns, F.lit(":Concept"), F.col("p_size").cast("string"), F.lit(">"),
    ).alias("value"))
    names = 'xmlns:us-gaap="http://fasb.org/us-gaap/2025" xmlns:dei="http://xbrl.sec.gov/dei/2025" xmlns:srt="http://fasb.org/srt/2025" xmlns:own="http://www.example.com/filer/"'
    return _files(spark, "instance", rows, f'<xbrl {names}>\n<unit id="usd"><measure>iso4217:USD</measure></unit>', "</xbrl>")


def _files(spark, name: str, rows: DataFrame, head: str, tail: str, most: int = 1000) -> str:
    """Rows (key, value) as files of up to ``most`` lines between a head and a tail."""
    path = scratch(spark, name)
    whole = rows.groupBy(F.floor(F.col("key") / most)).agg(F.array_join(F.collect_list("value"), "\n").alias("body"))  # at most ``most`` lines
    whole.select(F.concat(F.lit(head + "\n"), "body", F.lit("\n" + tail)).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("""SELECT CASE p_partkey % 4 WHEN 0 THEN 'us-gaap' WHEN 1 THEN 'dei' WHEN 2 THEN 'srt' ELSE 'filer' END AS prefix, 'Concept' || p_size AS concept, 'c' || p_partkey AS context_id, 'USD' AS measure,
CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR) AS value, '2025-06-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS instant FROM part""")
def xbrl_facts_of_table(spark, d):
    path = _instance_of_parts(spark, d)
    units = xbrl.units(spark, path).dropDuplicates(["unit_id"])  # each file declares it
    out = xbrl.facts(spark, path).join(xbrl.contexts(spark, path), "context_id").join(units, "unit_id", "left")
    return out.select("prefix", "concept", "context_id", "measure", "value", "instant")


@query("""SELECT 'us-gaap_P' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'terse ' || p_name ELSE p_name END AS label FROM part""")
def linkbase_of_table(spark, d):
    """Each part has a terse label, two of three a standard one as well."""
    key = F.col("p_partkey").cast("string")
    terse = F.concat(F.lit("<label label=\"t"), key, F.lit("\" role=\"http://www.xbrl.org/2003/role/terseLabel\">terse "), F.col("p_name"), F.lit("</label>"))
    standard = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("<label label=\"t"), key, F.lit("\" role=\"http://www.xbrl.org/2003/role/label\">"), F.col("p_name"), F.lit("</label>"))).otherwise(F.lit(""))
    loc = F.concat(F.lit("<loc href=\"a.xsd#us-gaap_P"), key, F.lit("\" label=\"l"), key, F.lit("\"/><labelArc from=\"l"), key, F.lit("\" to=\"t"), key, F.lit("\"/>"))
    path = _files(spark, "linkbase", table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat(loc, terse, standard).alias("value")), "<linkbase>", "</linkbase>")
    return facts.label_map(*xbrl.linkbase(spark, path)).select("key", "label")


SQL_EVAL_SET = """q AS (SELECT 'q' || item_id % 150 AS id, CASE item_id % 4 WHEN 0 THEN 'passenger' WHEN 1 THEN 'cargo' WHEN 2 THEN 'financial' ELSE 'other' END AS route, CASE item_id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'semantic' ELSE 'odd' END AS query_type,
  item_id * 7 AS gold_doc, CASE WHEN item_id % 5 = 0 THEN [] ELSE ['p1'] END AS locs, CASE WHEN item_id % 2 = 0 THEN '' ELSE text END AS span FROM benchmark),
cat AS (SELECT doc_id AS gold_doc, CASE lang WHEN 'en' THEN 'passenger' WHEN 'de' THEN 'cargo' ELSE 'financial' END AS line FROM documents)"""


@query(f"""WITH {SQL_EVAL_SET}, k AS (SELECT * FROM q LEFT JOIN cat USING (gold_doc))
SELECT id, 'duplicate id' AS problem FROM q GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'unknown route' FROM k WHERE route = 'other' UNION ALL SELECT id, 'unknown query type' FROM k WHERE query_type = 'odd'
UNION ALL SELECT id, 'unknown document' FROM k WHERE line IS NULL UNION ALL SELECT id, 'route and document differ' FROM k WHERE line <> route
UNION ALL SELECT id, 'no label' FROM k WHERE len(locs) = 0 AND span = ''""")
def eval_set_of_table(spark, d):
    i = F.col("item_id")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    asked = table(spark, d, "benchmark").select(
        F.concat(F.lit("q"), (i % 150).cast("string")).alias("id"), pick(4, "passenger", "cargo", "financial", "other").alias("route"), pick(3, "keyword", "semantic", "odd").alias("query_type"),
        (i * 7).alias("gold_doc"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p1"))).alias("gold_locators"), F.when(i % 2 == 0, "").otherwise(F.col("text")).alias("gold_span"),
    )
    line = F.when(F.col("lang") == "en", "passenger").when(F.col("lang") == "de", "cargo").otherwise("financial")
    return sets.eval_set_problems(asked, table(spark, d, "documents").select("doc_id", line.alias("business_line")))


# --- grading by locators, runs, details -----------------------------------------------------------------------------

SQL_HITS = """gold AS (SELECT item_id AS query_id, item_id % 40 * 5 AS gold_doc, ['p' || (item_id % 9 + 1), 'p' || (item_id % 4 + 11)] AS gold_locators, text AS gold_span, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'de' END AS business_line FROM benchmark),
hits AS (SELECT query_id, r AS rank, CASE WHEN (query_id + r) % 3 = 0 THEN gold_doc + 1 ELSE gold_doc END AS doc_id, ['p' || (query_id % 7 + r), 'p' || (r + 9)] AS locators, CASE WHEN r = query_id % 11 THEN gold_span || ' etc' ELSE 'page ' || r END AS text
  FROM gold, range(1, 11) t(r) WHERE query_id % 13 <> 0),
grades AS (SELECT query_id, rank, CASE WHEN h.doc_id <> gold_doc THEN 0 WHEN contains(lower(text), lower(gold_span)) THEN 3 WHEN len(list_intersect(locators, gold_locators)) > 0 THEN 2 ELSE 1 END AS grade FROM hits h JOIN gold USING (query_id))"""


def _run(spark, d) -> tuple[DataFrame, DataFrame]:
    """Labelled questions, and ten made-up hits for most of them: some in the wrong document, some with the gold span."""
    i = F.col("item_id")
    loc = lambda x: F.concat(F.lit("p"), x.cast("string"))
    gold = table(spark, d, "benchmark").select(i.alias("query_id"), (i % 40 * 5).alias("gold_doc"), F.array(loc(i % 9 + 1), loc(i % 4 + 11)).alias("gold_locators"), F.col("text").alias("gold_span"), F.when(i % 2 == 0, "en").otherwise("de").alias("business_line"))
    q, r = F.col("query_id"), F.col("rank")
    rows = gold.where(q % 13 != 0).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(10))))
    hits = rows.select("query_id", "rank", F.when((q + r) % 3 == 0, F.col("gold_doc") + 1).otherwise(F.col("gold_doc")).alias("doc_id"), F.array(loc(q % 7 + r), loc(r + 9)).alias("locators"), F.when(r == q % 11, F.concat("gold_span", F.lit(" etc"))).otherwise(F.concat(F.lit("page "), r.cast("string"))).alias("text"))
    return gold, hits


@query(f"WITH {SQL_HITS} SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(grade AS BIGINT) AS grade FROM grades")
def locator_grades(spark, d):
    gold, hits = _run(spark, d)
    return ranking.graded(hits, gold).withColumns({"rank": F.col("rank").cast("long"), "grade": F.col("grade").cast("long")})


@query(f"""WITH {SQL_HITS}, cells AS (SELECT query_id, max(CASE WHEN grade >= 2 AND rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS r1, max(CASE WHEN grade >= 2 AND rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS r3,
  coalesce(1.0::DOUBLE / min(CASE WHEN grade >= 2 THEN rank END), 0) AS rr, sum(CASE WHEN rank <= 3 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 3 THEN grade / log2(ideal + 1) ELSE 0 END) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM grades) GROUP BY query_id)
SELECT count(*) AS n, {r6('avg(coalesce(r1, 0))')} AS r_at_1, {r6('avg(coalesce(r3, 0))')} AS r_at_3, {r6('avg(coalesce(rr, 0))')} AS mrr_at_10, {r6('avg(coalesce(dcg, 0))')} AS dcg_at_3, {r6('avg(CASE WHEN coalesce(best, 0) = 0 THEN 0 ELSE dcg / best END)')} AS ndcg_at_3,
  {r6("avg(CASE WHEN (CASE WHEN query_id % 13 = 0 THEN 'unknown' WHEN query_id % 5 = 0 THEN 'fr' ELSE business_line END) = business_line THEN 1.0::DOUBLE ELSE 0 END)")} AS route_accuracy
FROM gold LEFT JOIN cells USING (query_id)""")
def run_metrics(spark, d):
    gold, hits = _run(spark, d)
    q = F.col("query_id")
    routes = gold.select("query_id", F.when(q % 13 == 0, "unknown").when(q % 5 == 0, "fr").otherwise(F.col("business_line")).alias("route"))
    out = ranking.run_metrics(ranking.graded(hits, gold), gold, routes)
    return out.select("n", *[round6(F.col(c)).alias(c) for c in out.columns if c != "n"])


@query(f"""WITH {SQL_HITS}, g AS (SELECT query_id, string_agg(CAST(grade AS VARCHAR), ',' ORDER BY rank) AS grades FROM grades GROUP BY query_id)
SELECT query_id, business_line AS route, coalesce(grades, '') AS grades, coalesce(h.doc_id, -1) AS top_doc, coalesce(array_to_string(h.locators, ','), '') AS top_locators FROM gold LEFT JOIN g USING (query_id) LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h USING (query_id)""")
def question_details(spark, d):
    gold, hits = _run(spark, d)
    asked = gold.select("query_id", F.col("gold_span").alias("question"), F.col("business_line").alias("route"), F.lit("keyword").alias("query_type"))
    out = ranking.question_details(asked, hits, ranking.graded(hits, gold))
    return out.select("query_id", "route", F.array_join(F.transform("grades", lambda g: g.cast("string")), ",").alias("grades"), F.coalesce("top_doc", F.lit(-1)).alias("top_doc"), F.array_join("top_locators", ",").alias("top_locators"))


@query("SELECT doc_id, 1 - (1 - n_chars::DOUBLE / 65536) AS similarity FROM documents")
def distance_to_similarity(spark, d):
    from ..functions.vectors import similarity

    return table(spark, d, "documents").select("doc_id", similarity(1 - F.col("n_chars") / F.lit(65536.0)).alias("similarity"))
