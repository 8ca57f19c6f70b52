"""Queries on text, pages, units and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, corpus
from ..sources.html import PARSERS, parse_pages
from .registry import query, table

SAMPLES = [
    (-1, "inter-\nnational  rules"),
    (-2, "a \t b"),
    (-3, "x\r\ny\rz"),
    (-4, "a\n\n\n\nb \n c"),
    (-5, "“Curly” ‘quotes’ – and — dashes here"),
    (-6, "Page 4 of 23\n12\nG32 Limit ........ 10\nbody 77"),
    (-7, " \n "),
    (-8, "t h e s h a t t e r e d " * 12),
    (-9, "Good prose with proper words in every line. " * 6),
    (-10, "Bad � glyphs in otherwise proper prose. " * 8),
    (-11, "Contents ...... 1\nRule one ....... 2\nRule two ....... 3\nThe end\nMore\nBody"),
    (-12, "One\nTwo\nThree\nFour\nFive\nSix"),
]
SQL_SAMPLES = "samples(doc_id, text) AS (VALUES " + ", ".join("(" + str(i) + ", '" + t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '").replace("\t", "' || chr(9) || '") + "')" for i, t in SAMPLES) + ")"
SQL_TEXTS = f"{SQL_SAMPLES}, texts AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM samples UNION ALL SELECT doc_id, text FROM documents)"
W = r"[\p{L}\p{N}_]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_normalise(x: str) -> str:
    for pattern, new in ((r"\r\n?", "\n"), (rf"({W})-\n({W})", r"\1\2"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        new = new.replace("\n", "' || chr(10) || '")
        x = rf"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return sql_strip(x)


SQL_UNITS = """units AS (
  SELECT doc_id, lang AS business_line, i AS pos, 'p' || i AS locator, parts[i] AS text
  FROM (SELECT doc_id, lang, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents)))"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(SAMPLES, "doc_id long, text string").unionByName(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {SQL_TEXTS} SELECT doc_id, {sql_normalise('text')} AS text FROM texts")
def normalise_text(spark, d):
    return texts(spark, d).select("doc_id", T.normalise(F.col("text")).alias("text"))


SQL_FOLDED = r"""regexp_replace(translate(text, '‘’“”–—' || chr(160), '''''""-- '), '\s+', ' ', 'g')"""


@query(f"WITH {SQL_TEXTS} SELECT doc_id, lower({sql_strip(SQL_FOLDED)}) AS text FROM texts")
def match_normalise(spark, d):
    return texts(spark, d).select("doc_id", T.fold_for_match(F.col("text")).alias("text"))


@query()
def match_normalise_nfkd(spark, d):
    return texts(spark, d).select("doc_id", T.match_normalise(F.col("text")).alias("text"))


@query(rf"WITH {SQL_TEXTS} SELECT doc_id, lower(regexp_replace(text, '\d+', '#', 'g')) AS masked FROM texts")
def mask_digits(spark, d):
    return texts(spark, d).select("doc_id", T.mask_digits(F.col("text")).alias("masked"))


SQL_CLEAN = rf"""(length(b) >= 200 AND NOT contains(b, chr(65533)) AND len(regexp_extract_all(b, '[A-Za-z]{{2,}}')) > 0
  AND list_sum(list_transform(regexp_extract_all(b, '[A-Za-z]{{2,}}'), lambda w: length(w)))::DOUBLE / len(regexp_extract_all(b, '[A-Za-z]{{2,}}')) >= 3.0)"""


@query(f"WITH {SQL_TEXTS} SELECT doc_id, {SQL_CLEAN} AS clean FROM (SELECT doc_id, {sql_strip('text')} AS b FROM texts)")
def clean_page_flag(spark, d):
    return texts(spark, d).select("doc_id", T.is_clean(F.col("text")).alias("clean"))


SQL_FRONT = rf"(len(b) < 5 OR len(list_filter(b, lambda x: regexp_matches(x, '\.{{4,}}\s*\d+\s*$')))::DOUBLE / len(b) >= 0.30)"


@query(rf"WITH {SQL_TEXTS} SELECT doc_id, len(b) AS n_lines FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {sql_strip('x')} <> '') AS b FROM texts) WHERE NOT {SQL_FRONT}")
def front_matter_filter(spark, d):
    body = F.size(F.filter(T.lines(F.col("text")), lambda x: T.strip(x) != "")).cast("long")
    return corpus.without_front_matter(texts(spark, d)).select("doc_id", body.alias("n_lines"))


SQL_PAGES_BODY = rf"""pages_ AS (SELECT doc_id, source AS grp, text FROM documents),
body AS (SELECT doc_id, grp, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS b FROM pages_),
edges AS (SELECT grp, unnest(list_concat(b[1:3], b[greatest(len(b) - 2, 1):len(b)])) AS line FROM body),
counted AS (SELECT grp, lower(regexp_replace(line, '\d+', '#', 'g')) AS line, count(*) AS n FROM edges GROUP BY ALL),
cutoff AS (SELECT grp, greatest(2, CAST(floor(count(*) * 0.02) AS BIGINT)) AS c FROM pages_ GROUP BY grp),
running AS (SELECT grp, line, n FROM counted JOIN cutoff USING (grp) WHERE n >= c)"""


def _pages(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("grp"), "text")


@query(f"WITH {SQL_PAGES_BODY} SELECT grp, line, n FROM running")
def running_lines(spark, d):
    return corpus.running_lines(_pages(spark, d), "grp", threshold=0.02)


@query(rf"""WITH {SQL_PAGES_BODY},
ln AS (SELECT doc_id, grp, i, parts[i] AS raw FROM (SELECT doc_id, grp, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, grp, string_split(text, chr(10)) AS parts FROM pages_))),
kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS t FROM ln
  WHERE NOT regexp_matches(raw, '(?i)^\s*(page\s+\d+\s+of\s+\d+|\d{{1,3}})\s*$')
  AND NOT EXISTS (SELECT 1 FROM running r WHERE r.grp = ln.grp AND r.line = lower(regexp_replace({sql_strip('raw')}, '\d+', '#', 'g'))) GROUP BY doc_id)
SELECT p.doc_id, {sql_strip("coalesce(t, '')")} AS text FROM pages_ p LEFT JOIN kept USING (doc_id)""")
def strip_running_lines(spark, d):
    pages = _pages(spark, d)
    return corpus.strip_running(pages, corpus.running_lines(pages, "grp", threshold=0.02), "grp", "doc_id")


SQL_HTML = {
    "strip_tags": "html",
    "no_chrome": r"regexp_replace(html, '(?is)<(script|style|nav|footer)\b.*?</(script|style|nav|footer)>', '', 'g')",
    "article": r"coalesce(nullif(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), ''), html)",
}


def sql_parse(parser: str) -> str:
    x = rf"regexp_replace(regexp_replace({SQL_HTML[parser]}, '(?i)</(p|div|h[1-6]|li|tr|article|section|header|footer|nav|title)>|<br ?/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return rf"""SELECT page_id, CAST(i AS BIGINT) AS page, {sql_normalise('parts[i]')} AS text, length(parts[i]) AS raw_chars, '{parser}' AS parser
FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT page_id, regexp_split_to_array({x}, '\n[ \t]*\n') AS parts FROM pages))"""


SQL_PARSED = " UNION ALL ".join(sql_parse(p) for p in PARSERS)


def _parsed(spark, d) -> DataFrame:
    pages, out = table(spark, d, "pages"), None
    for parser in PARSERS:
        one = parse_pages(pages, parser)
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"page": F.col("page").cast("long"), "raw_chars": F.col("raw_chars").cast("long")})


@query(SQL_PARSED)
def html_extract_units(spark, d):
    return _parsed(spark, d)


@query(f"SELECT parser, count(*) AS pages, count(*) FILTER (WHERE {SQL_CLEAN}) AS clean, floor(100.0 * count(*) FILTER (WHERE {SQL_CLEAN}) / count(*) * 1e6 + 0.5) / 1e6 AS clean_pct FROM (SELECT parser, {sql_strip('text')} AS b FROM ({SQL_PARSED})) GROUP BY parser")
def clean_text_pct_by_parser(spark, d):
    out = _parsed(spark, d).withColumn("ok", T.is_clean(F.col("text"))).groupBy("parser").agg(F.count("*").alias("pages"), F.count_if("ok").alias("clean"))
    return out.withColumn("clean_pct", T.round6(100.0 * F.col("clean") / F.col("pages")))


def _units(spark, d) -> DataFrame:
    return corpus.units(table(spark, d, "documents")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {SQL_UNITS}
SELECT 'pdf' AS kind, doc_id, business_line, locator, text, NULL::VARCHAR AS fact_count FROM units WHERE {sql_strip('text')} <> ''
UNION ALL
SELECT 'xbrl', p_partkey, 'financial', 'part:' || p_partkey, p_name, p_size::VARCHAR FROM part WHERE {sql_strip('p_name')} <> ''""")
def source_units(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("financial").alias("business_line"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("locator"), F.col("p_name").alias("text"), F.col("p_size").cast("string").alias("fact_count"))
    return corpus.load_corpus({"pdf": _units(spark, d).drop("pos"), "xbrl": part}).select("kind", "doc_id", "business_line", "locator", "text", "fact_count")


CATALOGUE = [("en", "passenger"), ("de", "cargo"), ("fr", "financial")]


@query("""SELECT doc_id, lang, coalesce(c.line, 'unknown') AS business_line
FROM documents LEFT JOIN (VALUES ('en', 'passenger'), ('de', 'cargo'), ('fr', 'financial')) c(l, line) ON lang = l""")
def catalog_left_join(spark, d):
    catalogue = F.broadcast(spark.createDataFrame(CATALOGUE, "lang string, line string"))  # a fixed list
    return table(spark, d, "documents").join(catalogue, "lang", "left").select("doc_id", "lang", F.coalesce("line", F.lit("unknown")).alias("business_line"))


def sql_chunks(size: int, overlap: int) -> str:
    step = size - overlap
    return rf"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM documents),
chunks AS (SELECT doc_id, i AS chunk_no, w[i * {step} + 1 : i * {step} + {size}] AS t
  FROM (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - {size}) / {step}.0), 0) AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0))"""


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query(f"WITH {sql_chunks(100, 0)} SELECT doc_id, chunk_no, array_to_string(t, ' ') AS text, len(t) AS n_tokens FROM chunks")
def chunk_fixed(spark, d):
    return _longs(chunking.chunk_fixed(table(spark, d, "documents"), 100), "chunk_no", "n_tokens")


@query(f"WITH {sql_chunks(100, 20)} SELECT doc_id, chunk_no, array_to_string(t, ' ') AS text, len(t) AS n_tokens FROM chunks")
def chunk_fixed_overlap(spark, d):
    return _longs(chunking.chunk_fixed(table(spark, d, "documents"), 100, 20), "chunk_no", "n_tokens")


#: documents have no rule headings: every fourth line becomes one
SQL_RULES = """ruled AS (SELECT doc_id, string_agg(CASE WHEN pos % 4 = 0 THEN 'RULE ' || pos || ': ' ELSE '' END || text, chr(10) ORDER BY pos) AS text FROM units GROUP BY doc_id)"""


@query(rf"""WITH {SQL_UNITS}, {SQL_RULES}, cut AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(RULE\s+\d+[:.]?|G\d{{1,3}}\b)', chr(1) || '\1', 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p FROM ruled)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_no, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM cut)""")
def chunk_section_aware(spark, d):
    marked = F.transform(T.lines(F.col("text")), lambda x, i: F.when((i + 1) % 4 == 0, F.concat(F.lit("RULE "), (i + 1).cast("string"), F.lit(": "), x)).otherwise(x))
    ruled = table(spark, d, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"))
    return _longs(chunking.chunk_sections(ruled), "chunk_no")


SQL_OFFSETS = """offsets AS (SELECT *, start_ + length(text) AS end_ FROM (
  SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ FROM units))"""


@query(f'WITH {SQL_UNITS}, {SQL_OFFSETS} SELECT doc_id, locator, pos, start_ AS "start", end_ AS "end" FROM offsets')
def chunk_offsets_running_sum(spark, d):
    return chunking.unit_offsets(_units(spark, d)).select("doc_id", "locator", "pos", "start", "end")


@query(f"""WITH {SQL_UNITS}, {SQL_OFFSETS}, spans AS (
  SELECT doc_id, i AS chunk_no, i * 400 AS cs, least(i * 400 + 500, n) AS ce FROM (
    SELECT doc_id, length(text) AS n, unnest(range(0, CAST(greatest(ceil((length(text) - 500) / 400.0), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0))
SELECT s.doc_id, chunk_no, string_agg(locator, ',' ORDER BY pos) AS locators
FROM spans s JOIN offsets o ON s.doc_id = o.doc_id AND start_ < ce AND cs < end_ GROUP BY ALL""")
def chunk_locators_range_join(spark, d):
    n = F.length("text")
    last = F.greatest(F.ceil((n - 500) / F.lit(400.0)), F.lit(0)).cast("int")
    spans = table(spark, d, "documents").where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    spans = spans.select("doc_id", F.col("i").cast("long").alias("chunk_no"), (F.col("i") * 400).alias("start"), F.least(F.col("i") * 400 + 500, F.col("n")).alias("end"))
    found = chunking.chunk_locators(spans, chunking.unit_offsets(_units(spark, d)))
    return found.select("doc_id", "chunk_no", F.array_join("locators", ",").alias("locators"))


@query()
def chunk_recursive(spark, d):
    return chunking.chunk(table(spark, d, "documents"), "recursive", 100, 20)


@query()
def chunk_rule_aware(spark, d):
    """Sections by rule headings, none over 60 words: long ones and texts without headings are split further."""
    marked = F.transform(T.lines(F.col("text")), lambda x, i: F.when((i + 1) % 4 == 0, F.concat(F.lit("RULE "), (i + 1).cast("string"), F.lit(": "), x)).otherwise(x))
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array_join(marked, "\n")).otherwise(F.col("text")).alias("text"))
    return chunking.chunk(docs, "rule_aware", 60, 10)


@query()
def chunk_corpus(spark, d):
    """Chunks of all units with their locators, line, title and meta; parts pass as they are."""
    paged = _units(spark, d).withColumns({"kind": F.lit("pdf"), "title": F.concat(F.lit("doc "), F.col("doc_id").cast("string"))})
    part = table(spark, d, "part").select((-F.col("p_partkey")).alias("doc_id"), F.lit("financial").alias("business_line"), F.lit(1).cast("long").alias("pos"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("locator"), F.col("p_name").alias("text"), F.lit("xbrl").alias("kind"), F.lit("parts").alias("title"))
    out = chunking.chunk_units(paged.unionByName(part), "fixed_ov", 80, 10)
    return out.withColumn("meta", F.array_join(F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","))
