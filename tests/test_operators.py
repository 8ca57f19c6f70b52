"""Operators on literal rows."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseek.functions import formats, text
from lodeseek.operators import chunking, corpus, evaluation, guards, routing, search
from lodeseek.sources import html, sets
from lodeseek.streaming import questions


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize(("raw", "want"), [("inter-\nnational", "international"), ("a \t b", "a b"), ("x\r\ny", "x\ny"), ("a\n\n\n\nb", "a\n\nb"), ("  \n a \n ", "a")])
def test_normalise(spark, raw, want):
    assert one(spark, raw, text.normalise) == want


def test_match_normalise(spark):
    assert one(spark, "“ﬁne”  –  ‘Ä’", text.match_normalise) == '"fine" - \'a\u0308\''


def test_clean_and_front_matter(spark):
    assert one(spark, "Good prose with proper words here. " * 8, text.is_clean)
    assert not one(spark, "t h e " * 60, text.is_clean)
    assert not one(spark, "Good prose � with words. " * 12, text.is_clean)
    assert one(spark, "A\nB\nC", text.is_front_matter)
    assert one(spark, "Rule A ..... 1\nRule B ..... 2\nx\ny\nz", text.is_front_matter)
    assert not one(spark, "\n".join("abcdefgh"), text.is_front_matter)


def test_windows(spark):
    for n, want in ((0, 0), (1, 1), (5, 1), (6, 2), (8, 2)):
        got = one(spark, " ".join(map(str, range(n))), lambda c: chunking.windows(text.words(c), 5, 2))
        assert len(got) == want
        assert {w for ws in got for w in ws} == {str(i) for i in range(n)}
    with pytest.raises(ValueError):
        chunking.windows(F.array(), 5, 5)
    with pytest.raises(ValueError):
        chunking.chunk(spark.range(0), "none")


def test_sections(spark):
    df = spark.createDataFrame([(1, "Intro\nRULE 20: A\nbody\nRULE 21: B"), (2, "plain")], "doc_id int, text string")
    got = [(r["doc_id"], r["text"]) for r in chunking.chunk_sections(df).orderBy("doc_id", "chunk_no").collect()]
    assert got == [(1, "Intro"), (1, "RULE 20: A\nbody"), (1, "RULE 21: B"), (2, "plain")]


def test_recursive_spans():
    body = "One two three. Four five six.\n\nSeven eight\nnine ten eleven twelve thirteen fourteen"
    spans = chunking.split_spans(body, 5, 2)
    assert all(len(body[a:b].split()) <= 5 for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered or body[i].isspace() for i in range(len(body)))
    assert chunking.split_spans("", 5, 0) == []


def test_running_lines(spark):
    pages = spark.createDataFrame([(i, "g", f"Header {i}\n" + "\n".join(f"{w} {chr(97 + i)}" for w in "abcdef") + f"\nPage {i} of 9") for i in range(4)], "doc_id int, grp string, text string")
    running = corpus.running_lines(pages, "grp")
    assert {r["line"] for r in running.collect()} == {"header #", "page # of #"}
    got = {r["doc_id"]: r["text"] for r in corpus.strip_running(pages, running, "grp", "doc_id").collect()}
    assert got[1] == "a b\nb b\nc b\nd b\ne b\nf b"
    short = spark.createDataFrame([(1, "g", "x\ny"), (2, "g", "z")], "doc_id int, grp string, text string")
    assert {r["line"]: r["n"] for r in corpus.running_lines(short, "grp").collect()} == {"x": 2, "y": 2, "z": 2}  # both edges


@pytest.mark.parametrize(
    ("question", "reason"),
    [("What's JetBlue's baggage policy?", "out_of_scope_carrier:JetBlue"), ("Tell me about the United States", "out_of_scope_carrier:United Airlines"), ("Where is my bag", "requires_live_data"), ("status of my JetBlue flight", "out_of_scope_carrier:JetBlue"), ("How long?", None)],
)
def test_guards(spark, question, reason):
    assert one(spark, question, lambda c: guards.before_retrieval(c)["reason"]) == reason


@pytest.mark.parametrize(("answer", "cited", "valid"), [("x [1] y [2]", [1, 2], True), ("x [1] y [3]", [1, 3], False), ("none", [], False), ("[0]", [0], False), ("[2][2][1]", [1, 2], True)])
def test_citations(spark, answer, cited, valid):
    assert one(spark, answer, guards.citations) == cited
    assert one(spark, answer, lambda c: guards.citations_valid(c, F.lit(2))) is valid


@pytest.mark.parametrize(
    ("raw", "unit", "want"),
    [("63364000000", "usd", "USD 63,364,000,000 (63.36 billion)"), ("5000000", "usd", "USD 5,000,000 (5.0 million)"), ("7.66", "usdPerShare", "USD 7.66"), ("1200", "shares", "1,200 shares"), ("3.0", None, "3"), ("3.14159", None, "3.14"), ("abc", "usd", "abc"), ("-2000000000", "usd", "USD -2,000,000,000 (-2.00 billion)")],
)
def test_values(spark, raw, unit, want):
    assert one(spark, raw, lambda c: formats.value_format(c, F.lit(unit).cast("string"))) == want


def test_periods(spark):
    rows = [("2025-06-30", None, None), (None, "2025-01-01", "2025-12-31"), (None, "2025-02-01", "2025-12-31"), (None, None, None)]
    got = spark.createDataFrame(rows, "i string, s string, e string").select(formats.period_label(F.col("i"), F.col("s"), F.col("e")).alias("p")).collect()
    assert [r["p"] for r in got] == ["as of 2025-06-30", "FY2025", "2025-02-01 to 2025-12-31", "period not stated"]


def test_route(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (1, 4, "b"), (2, 1, "b")], "query_id int, rank int, business_line string")
    assert {r["query_id"]: r["route"] for r in routing.decide(routing.votes(hits)).collect()} == {1: "b", 2: "b"}
    assert {r["query_id"]: r["route"] for r in routing.decide(routing.votes(hits, 1)).collect()} == {1: "a", 2: "b"}
    prior = spark.createDataFrame([(1, "c", 2.0)], "query_id int, business_line string, prior double")
    voted = {(r["query_id"], r["business_line"]): r["votes"] for r in routing.with_prior(routing.votes(hits), prior).collect()}
    assert voted[1, "c"] == pytest.approx(0.35 * (1 + 1 / 2 + 1 / 3 + 1 / 4))
    assert {r["rank"] for r in routing.scope(hits, 5).where("query_id = 1").collect()} == {1}


def test_route_of_equal_votes(spark):
    """Sums of equal parts in another order differ by a last bit; the earliest hit decides."""
    assert 0.1 + 0.2 > 0.3
    voted = spark.createDataFrame([(1, "a", 0.1 + 0.2, 2), (1, "b", 0.3, 1)], "query_id int, business_line string, votes double, first_rank int")
    assert [r["route"] for r in routing.decide(voted).collect()] == ["b"]


def test_stems_of_lists(spark):
    """Null and empty lists, in batches that are parts of longer ones."""
    rows = [(i, None if i % 5 == 0 else ["flies", "running", "über", "flies"][: i % 4]) for i in range(50)]
    want = {i: None if ws is None else [text.stem(w) for w in ws] for i, ws in rows}
    got = spark.createDataFrame(rows, "i int, ws array<string>").coalesce(1).select("i", text.stemmed(F.col("ws")).alias("s"))
    for batch in (10000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert {r["i"]: r["s"] for r in got.collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert want[3] == ["fli", "run", "über"] and want[4] == []


def test_words_are_folded_once(spark):
    """A search folds the words of the corpus once, those of the questions twice."""
    folded = spark.sparkContext.accumulator(0)

    def fold(c):
        @F.arrow_udf("array<string>")
        def counted(lists: pa.Array) -> pa.Array:
            folded.add(len(lists.flatten()))
            return lists

        return counted(c)

    corpus = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, ""), (4, None), (5, "green")], "item_id int, text string")
    asked = spark.createDataFrame([(1, "red fox")], "query_id int, question string")
    plain = search.Bm25Index(corpus).search(asked, 5).collect()
    assert search.Bm25Index(corpus, fold=fold).search(asked, 5).collect() == plain
    assert [r["item_id"] for r in sorted(plain, key=lambda r: r["rank"])] == [1, 2]
    assert folded.value == 6 + 2 * 2


def test_terms(spark):
    units = spark.createDataFrame([("cargo", "Air Waybill means a document\nCarrier means us"), ("passenger", "Checked Bag shall mean a bag\nCarrier means us")], "business_line string, text string")
    terms = routing.defined_terms(units)
    assert {(r["term"], r["business_line"]) for r in terms.collect()} == {("air waybill", "cargo"), ("checked bag", "passenger")}
    asked = spark.createDataFrame([(1, "Where is my Air Waybill?"), (2, "checked bags")], "query_id int, question string")
    assert [(r["query_id"], r["business_line"], r["prior"]) for r in routing.term_prior(asked, terms).collect()] == [(1, "cargo", 1.4)]


def test_terms_held_by_questions(spark):
    """As SQL finds them: (^|[^a-z0-9_])term($|[^a-z0-9_]) in the lower-cased question."""
    words = ["pour le", "air waybill", "checked bag", "a b c d e f g h i j k l", "fo'c'sle deck", "of x-"]
    terms = spark.createDataFrame([(w, "l") for w in words], "term string, business_line string")
    texts = {1: "aiè pour leê", 2: "éAIR WAYBILLß", 3: "checked bag's", 4: "checked  bag", 5: "checked\nbag", 6: "checked bags", 7: "_checked bag", 8: "checked bag2", 9: "checked bag", 10: "so: a b c d e f g h i j k l.", 11: "", 12: None,
             13: "a fo'c'sle deck/checked bag", 14: "of x-", 15: "of x-y", 16: "of x--", 17: "checked bag, checked bag", 18: "\U0001d11echecked bag\U0001d11e"}
    want = {}
    for i, t in texts.items():
        got = sum(1 + 0.4 * w.count(" ") for w in words if re.search(f"(^|[^a-z0-9_]){re.escape(w)}($|[^a-z0-9_])", (t or "").lower()))
        want |= {i: pytest.approx(got)} if got else {}
    asked = spark.createDataFrame(list(texts.items()), "query_id int, question string")
    assert {r["query_id"]: r["prior"] for r in routing.term_prior(asked, terms).collect()} == want
    assert set(want) == {1, 2, 3, 9, 10, 13, 14, 16, 17, 18}


def test_span_hits(spark):
    units = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "other text")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, "uick brown fo"), (2, "r t"), (3, "missing span text")], "id int, span string")
    assert {(r["id"], r["doc_id"]) for r in evaluation.span_hits(spans, units).collect()} == {(1, 1), (2, 2)}


def test_parsers(spark):
    page = spark.createDataFrame([(1, "<html><nav>menu</nav><article><p>Hello &amp; bye</p></article><script>x()</script></html>")], "page_id int, html string")
    got = {p: " ".join(r["text"] for r in html.parse_pages(page, p).collect()).strip() for p in html.PARSERS}
    assert got["article"] == got["no_chrome"] == "Hello & bye"
    assert "menu" in got["strip_tags"]
    with pytest.raises(ValueError):
        html.parse_pages(page, "none")


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"mode": "sparse", "unknown": 1, "top_k": 3}')
    got = sets.load_config(spark, f"file://{tmp_path}/c.json")
    assert (got.mode, got.top_k, got.fusion) == ("sparse", 3, "weighted")
    assert sets.load_config(spark, f"file://{tmp_path}/none.json") == sets.PipelineConfig()
    assert got.index_key() == sets.PipelineConfig().index_key()


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "e.yaml").write_text("- id: P1\n  question: q\n  gold_locators: [p1]\n")
    row = sets.read_yaml(spark, f"file://{tmp_path}/e.yaml", sets.EVAL_SET).collect()[0]
    assert (row["id"], row["notes"], row["gold_locators"], row["route"]) == ("P1", "", ["p1"], None)


def test_save_stage(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = spark.createDataFrame([("a", 0.25, None), ("b", 1.0, 7)], "name string, score double, n int")
    sets.save_stage(rows, folder, "stage1", "First", notes="They differ.", extra="More.")
    assert (tmp_path / "stage1.md").read_text() == "# First\n\n| name | score | n |\n|---|---|---|\n| a | 0.2500 |  |\n| b | 1.0000 | 7 |\n\nMore.\n\n## Reading of these numbers\n\nThey differ.\n"
    assert spark.read.json(f"{folder}/stage1.json").count() == 2
    sets.save_stage(rows.limit(0), folder, "empty", "None", columns=["name"])
    assert "_(no rows)_" in (tmp_path / "empty.md").read_text()
    missing = sets.build_report(spark, "# Report\n\n{{stage1}}\n\n{{ stage9 }}\n", folder, f"{folder}/report.md")
    report = (tmp_path / "report.md").read_text()
    assert missing == ["stage9"] and "# First" not in report and "#### Reading of these numbers" in report and "No results of stage9" in report
    sets.refresh_notes(spark, folder, "stage1", "First", ["score"], lambda best: f"Best: {best['name']}")
    assert "Best: b" in (tmp_path / "stage1.md").read_text()


def test_read_through(spark, tmp_path):
    path, calls = f"file://{tmp_path}/cache", []

    def compute(todo):
        calls.append(sorted(r["id"] for r in todo.collect()))
        return todo.withColumn("twice", F.col("id") * 2)

    wanted = spark.createDataFrame([("m", 1), ("m", 2)], "model string, id long")
    assert sets.read_through(wanted, path, ["model", "id"], compute, ["model"]).count() == 2
    more = wanted.union(spark.createDataFrame([("n", 1)], "model string, id long"))
    assert sorted((r["model"], r["twice"]) for r in sets.read_through(more, path, ["model", "id"], compute, ["model"]).collect()) == [("m", 2), ("m", 4), ("n", 2)]
    assert calls == [[1, 2], [1]]


def a_pdf(pages, deflate):
    """A PDF file with a line of text a list entry of each page."""
    import zlib

    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>"]
    for i, lines in enumerate(pages):
        shown = lambda x: "(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"
        content = ("BT /F1 12 Tf 72 700 Td " + " ".join(f"{shown(x)} Tj 0 -14 Td" for x in lines) + " ET").encode("cp1252")
        data = zlib.compress(content) if deflate else content
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>", (f"<< /Length {len(data)} {'/Filter /FlateDecode' if deflate else ''} >>\nstream\n", data, "\nendstream")]
    out = b"%PDF-1.4\n"
    for n, o in enumerate(objects, 1):
        body = o.encode() if isinstance(o, str) else o[0].encode() + o[1] + o[2].encode()
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF\n"


@pytest.mark.parametrize("deflate", [False, True])
def test_pdf_pages(spark, tmp_path, deflate):
    from lodeseek.sources import pdf

    pages = [["Rule (one): baggage", "costs 5\\6 dollars – é"], [], ["Last page"]]
    (tmp_path / "a.pdf").write_bytes(a_pdf(pages, deflate))
    rows = pdf.parse_pdfs(spark, f"file://{tmp_path}").orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in rows] == [(1, "Rule (one): baggage\ncosts 5\\6 dollars – é"), (2, ""), (3, "Last page")]
    assert pdf._shown(b"[(Wo) -30 (rd) -400 (two)] TJ T* <48692041> Tj (\\101\\n) '") == "Word two\nHi A\nA\n".strip("\n")
    with pytest.raises(ValueError):
        pdf.parse_pdfs(spark, f"file://{tmp_path}", "none")


def test_token_count(spark):
    assert one(spark, "one two  three", chunking.token_count) == 3


def test_namespace_prefix(spark):
    from lodeseek.operators.facts import namespace_prefix

    for uri, want in (("http://fasb.org/us-gaap/2025", "us-gaap"), ("http://xbrl.sec.gov/dei/2025", "dei"), ("http://fasb.org/srt/2025", "srt"), ("http://www.filer.com/20251231", "own"), ("http://other.org/x/y/", "y")):
        assert one(spark, uri, lambda c: namespace_prefix(c, {"filer.com": "own"})) == want


def test_windows_take_time_in_proportion(spark):
    import time

    def seconds(n):
        docs = spark.range(8).selectExpr("id as doc_id", f"array_join(transform(sequence(1, {n}), i -> concat('w', i)), ' ') as text")
        began = time.time()
        chunking.chunk_fixed(docs, 100, 20).agg({"n_tokens": "sum"}).collect()
        return time.time() - began

    seconds(1000)
    assert seconds(160_000) < 10 * max(0.5, seconds(40_000))

def test_streams(spark, sf, tmp_path):
    spark.createDataFrame([(1, "Where is my bag"), (2, "quick fox")], "query_id long, question string").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("query_id long, question string").parquet(str(tmp_path / "q"))
    items = spark.createDataFrame([(7, "the quick fox")], "item_id long, text string")
    for name, df in (("guarded", questions.guarded(stream)), ("candidates", questions.candidates(stream, items))):
        run = df.writeStream.format("memory").queryName(name).start()
        run.processAllAvailable()
        run.stop()
    assert {r["query_id"]: r["verdict"]["blocked"] for r in spark.table("guarded").collect()} == {1: True, 2: False}
    assert [(r["query_id"], r["item_id"]) for r in spark.table("candidates").collect()] == [(2, 7)]
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "e").mkdir()
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("overwrite").parquet(str(tmp_path / "e"))
    schema = events.withColumn("ts", F.col("ts").cast("timestamp")).schema
    run = questions.counted(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").outputMode("complete").queryName("counted").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("counted").agg(F.sum("n")).collect()[0][0] == events.count()


def test_every_question_is_answered(spark, sf):
    from lodeseek.plans import search_queries

    asked = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    got = search_queries.answer_pipeline(spark, sf).where("query_id >= 0")
    assert got.count() == got.select("query_id").distinct().count() == asked


class FakeSession:
    """A session of a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: FakeSession.conf)


def test_a_cluster_must_name_a_shared_folder():
    from lodeseek.sources.scratch import scratch

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(FakeSession, "x")
    FakeSession.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(FakeSession, "x")


def test_pages_of_a_record(spark):
    from lodeseek.operators import facts

    rows = spark.createDataFrame([("p", "c", i, f"line {i % 5}") for i in range(10)], "prefix string, concept string, pos int, line string")
    got = facts.fact_records(rows, spark.createDataFrame([], "key string, label string"), "E", "Y", page=2).orderBy("locator").collect()
    assert [(r["locator"], r["fact_count"]) for r in got] == [("p:c", 2), ("p:c#2", 2), ("p:c#3", 1)]
    assert got[1]["text"].endswith("line 2\nline 3")


def test_running_lines_by_either_way(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "g", f"Head 7\nbody {i}\n\nfoot") for i in range(4)] + [(9, None, None)], "id int, grp string, text string")
    running = corpus.running_lines(pages, "grp")
    sent = {r["id"]: r["text"] for r in corpus.strip_running(pages, running, "grp", "id").collect()}
    monkeypatch.setattr(corpus, "MOST_SENT", 0)
    joined = {r["id"]: r["text"] for r in corpus.strip_running(pages, running, "grp", "id").collect()}
    assert sent == joined == {0: "", 1: "", 2: "", 3: "", 9: ""}  # body # runs as well, digits masked
