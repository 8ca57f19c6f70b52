"""Retrievers, stores, ablations, judging, the service and models behind functions."""

import io
import json
import math
import threading
import urllib.error
import urllib.request
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import evaluation, ranking, stores
from lodeseek.plans import answer as plans
from lodeseek.plans import judging, models
from lodeseek.plans.ablation import Ablation
from lodeseek.plans.service import Service
from lodeseek.sources import sets
from lodeseek.sources.scratch import scratch

TEXTS = {
    "d1": ("passenger", ["Checked bags may weigh fifty pounds. Heavier bags cost more.", "Pets travel in the cabin for a fee."]),
    "d2": ("cargo", ["Live animals are accepted as freight with a certificate.", "Perishable freight needs dry ice labels."]),
    "d3": ("financial", ["Total revenue was sixty billion dollars in the year.", "Operating income fell because fuel was dear."]),
}


@pytest.fixture(scope="module")
def units(spark):
    rows = [("pdf", d, line, f"Title {d}", i + 1, f"p{i + 1}", t) for d, (line, texts) in TEXTS.items() for i, t in enumerate(texts)]
    rows.append(("xbrl", "x", "financial", "Facts", 1, "us-gaap:Assets", "Assets were ninety billion dollars."))
    return spark.createDataFrame(rows, "kind string, doc_id string, business_line string, title string, pos int, locator string, text string").cache()


@pytest.fixture(scope="module")
def questions(spark):
    rows = [
        (1, "How heavy may checked bags be?", "passenger", "keyword", "d1", ["p1"], "fifty pounds"),
        (2, "What do animals need as freight?", "cargo", "semantic", "d2", ["p1"], "certificate"),
        (3, "What was total revenue in the year?", "financial", "keyword", "d3", ["p1"], "sixty billion"),
    ]
    return spark.createDataFrame(rows, "query_id long, question string, route string, query_type string, gold_doc string, gold_locators array<string>, gold_span string").cache()


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([(d, line) for d, (line, _) in TEXTS.items()] + [("x", "financial")], "doc_id string, business_line string").cache()


BASE = sets.PipelineConfig(strategy="fixed", size=12, overlap=0, top_k=3)


@pytest.fixture(scope="module")
def cache(spark):
    return plans.IndexCache(spark, scratch(spark, "indexes"))


def test_chunks_of_units(spark, cache, units):
    r = cache.get(BASE, lambda parser: units)
    rows = {x["chunk_id"]: x for x in r.chunks.collect()}
    assert rows["x::us-gaap:Assets"]["locators"] == ["us-gaap:Assets"] and rows["x::us-gaap:Assets"]["meta"] == {"strategy": "presplit"}
    first = rows["d1::fixed::0"]
    assert first["text"] == "Checked bags may weigh fifty pounds. Heavier bags cost more. Pets travel"
    assert first["locators"] == ["p1", "p2"] and first["title"] == "Title d1" and first["business_line"] == "passenger"
    assert first["meta"] == {"strategy": "fixed", "size": "12", "overlap": "0", "n_tokens": "12"}


def test_indexes_are_built_once(cache, units, questions):
    cache.get(BASE, lambda parser: units)
    before = cache.built
    cache.get(replace(BASE, mode="dense", rerank=True), lambda parser: units)  # the search is not part of the key
    assert cache.built == before
    cache.get(replace(BASE, size=20), lambda parser: units)
    assert cache.built == before + 1


@pytest.mark.parametrize("mode", ["dense", "sparse", "hybrid"])
def test_retrieve(cache, units, questions, mode):
    r = cache.get(BASE, lambda parser: units)
    hits = r.retrieve(questions, 2, mode=mode, fusion="rrf").join(r.chunks, "item_id").where("rank = 1")
    assert {x["query_id"]: x["doc_id"] for x in hits.collect()} == {1: "d1", 2: "d2", 3: "d3"}
    line = questions.select("query_id", "question", F.lit("cargo").alias("business_line"))
    got = r.retrieve(line, 5, mode=mode, filtered=True).join(r.chunks, "item_id")
    assert {x["business_line"] for x in got.collect()} <= {"cargo"}
    with pytest.raises(ValueError):
        r.retrieve(questions, mode="odd")
    with pytest.raises(ValueError):
        plans.Retriever(r.chunks, BASE).retrieve(questions, mode="dense")


def brute_hits(q, v, k):
    s = np.floor(q @ v.T * 1e6 + 0.5) / 1e6
    return [sorted(range(len(v)), key=lambda j: (-row[j], j))[:k] for row in s]


@pytest.mark.parametrize("name", ["exact", "flat", "cells"])
def test_stores(spark, name):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    v[50:60] = v[50]  # ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(v)], "item_id long, business_line string, v array<double>")
    asked = spark.createDataFrame([(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(q)], "query_id long, business_line string, qv array<double>")
    place = scratch(spark, name)
    options = {"cells": 4, "probes": 4} if name == "cells" else {}
    assert stores.get_store(name, spark, place, **options).build(items) >= 0
    store = stores.get_store(name, spark, place, **options)  # opened again
    got = {}
    for r in store.search(asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert [got[i] for i in range(7)] == brute_hits(q, v, 5)
    hits = store.search(asked, 5, filtered=True).collect()
    assert all(r["item_id"] % 2 == r["query_id"] % 2 for r in hits) and len(hits) == 35
    with pytest.raises(ValueError):
        stores.get_store("none", spark, place)


def test_many_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(stores, "BLOCK", 3)
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(40, 4)), rng.normal(size=(10, 4))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, qv array<double>")
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in stores.matrix_hits(asked, items, 3).collect()}
    assert got == {(i, n + 1): j for i, row in enumerate(brute_hits(q, v, 3)) for n, j in enumerate(row)}
    assert stores.matrix_hits(asked.limit(0), items, 3).count() == 0


def test_embedders(spark):
    df = spark.createDataFrame([(1, "bags bags fee"), (2, None), (3, "")], "id int, text string")
    rows = {r["id"]: np.array(r["v"]) for r in models.Embedder(32).documents(df, "text").collect()}
    want = np.zeros(32)
    for t in ("bags", "bags", "fee"):
        at, sign = models.term_place(t, 32)
        want[at] += sign
    assert np.allclose(rows[1], want / np.linalg.norm(want)) and not rows[2].any() and not rows[3].any()
    own = models.Embedder(3, "q: ", make=lambda: lambda texts: [[len(t), 1, 0] for t in texts])
    (row,) = own.queries(df.limit(1), "text").collect()
    assert np.allclose(row["qv"], np.array([16, 1, 0]) / math.hypot(16, 1))
    with pytest.raises(Exception, match="not 4"):
        models.Embedder(4, make=lambda: lambda texts: [[1.0, 2.0]] * len(texts)).queries(df, "text").collect()
    with pytest.raises(ValueError):
        models.get_embedder("none")


def test_limits_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = models.RateLimiter(2, 60, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        limiter.wait()
    assert slept == [60.0, 60.0]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "ok"

    assert models.retried(flaky, 3, 1.0, sleep=slept.append) == "ok" and slept[-2:] == [1.0, 2.0]
    with pytest.raises(OSError):
        models.retried(lambda: (_ for _ in ()).throw(OSError("no")), 2, sleep=lambda s: None)


@pytest.fixture()
def model_server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "fail" in body.get("prompt", ""):
                self.send_error(500)
                return
            reply = {"embeddings": [[1.0, 0.0]] * len(body["input"])} if "input" in body else {"response": f" {len(body['prompt'])} chars [1] "}
            data = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/"
    server.shutdown()
    server.server_close()


def test_models_over_http(spark, model_server):
    df = spark.createDataFrame([(1, "hello"), (2, "please fail"), (3, None)], "id int, p string").coalesce(1)
    rows = {r["id"]: r["r"] for r in df.withColumn("r", models.called(F.col("p"), models.http_generator(model_server, "m"))).collect()}
    assert rows[1]["text"] == "5 chars [1]" and rows[1]["error"] is None
    assert rows[2]["text"] is None and "500" in rows[2]["error"]
    assert rows[3]["text"] is None and rows[3]["error"] is None
    (v,) = models.Embedder(2, make=models.http_encoder(model_server, "m")).documents(df.limit(1), "p").collect()
    assert v["v"] == [1.0, 0.0]


def test_answers(spark, cache, units, questions, model_server):
    r = cache.get(BASE, lambda parser: units)
    more = questions.select("query_id", "question").union(spark.createDataFrame([(9, "Where is my bag?")], "query_id long, question string"))
    got = {x["query_id"]: x for x in plans.answer(more, r).collect()}
    assert got[9]["blocked"] and got[9]["reason"] == "requires_live_data" and got[9]["route"] is None
    assert [got[i]["route"] for i in (1, 2, 3)] == ["passenger", "cargo", "financial"]
    assert "fifty pounds" in got[1]["answer"] and got[1]["citations_valid"] and got[1]["docs"][0] == "d1"
    silent = {x["query_id"]: x for x in plans.answer(more, r, generate=plans.unwritten).collect()}
    assert silent[1]["answer"] == "" and silent[1]["sources"].startswith("[1] Title d1, page 1")
    called = {x["query_id"]: x for x in plans.answer(more, r, generate=plans.prompted(models.http_generator(model_server, "m"))).collect()}
    assert called[2]["answer"].endswith("chars [1]") and called[2]["citations_valid"] and called[2]["generation_ms"] > 0
    weak = plans.answer(more, r, threshold=1.01).where("query_id = 1").collect()[0]
    assert weak["blocked"] and weak["reason"].startswith("weak_evidence:")


def test_run(cache, units, questions, catalogue):
    a = Ablation(cache, lambda parser: units, questions, catalogue)
    done = a.run(replace(BASE, mode="sparse"))
    row = done.scores.collect()[0]
    assert row["n"] == 3 and row["r_at_1"] == 1.0 and row["mrr_at_10"] == 1.0 and row["route_accuracy"] == 1.0
    assert {x["query_type"]: x["n"] for x in done.by("query_type").collect()} == {"keyword": 2, "semantic": 1}
    detail = {x["query_id"]: x for x in done.details.collect()}
    assert detail[1]["top_doc"] == "d1" and detail[1]["grades"][0] == 3 and "p1" in detail[1]["top_locators"]
    assert done.n_chunks >= 4 and done.query_ms > 0


def test_stages_carry_their_winners(spark, cache, units, questions, catalogue, tmp_path):
    broken = units.withColumn("text", F.regexp_replace("text", "fifty|certificate|sixty", "##"))
    a = Ablation(cache, lambda parser: units if parser == "good" else broken, questions, catalogue)
    folder = f"file://{tmp_path}"
    final = a.run_all(folder, BASE, ["bad", "good"], grid=[("fixed", 4, 0), ("rule_aware", 12, 2)], embeddings=["hashed_small"], stores=["exact", "cells"])
    assert final.parser == "good" and (final.strategy, final.size) == ("rule_aware", 12) and final.embedding == "hashed_small"
    assert sets.load_config(spark, f"{folder}/final_config.json") == final
    page = (tmp_path / "stage2_chunking.md").read_text()
    assert page.startswith("# Chunking\n") and "| strategy | size |" in page and "## Reading of these numbers" in page
    assert (tmp_path / "stage6_fusion.md").exists() == (final.mode == "hybrid")
    rows = a.variants({"whole": lambda p: units, "broken": lambda p: broken}, replace(BASE, mode="sparse")).collect()
    assert rows[0]["variant"] == "whole" and rows[0]["r_at_1"] >= rows[1]["r_at_1"]
    terms = spark.createDataFrame([("freight", "cargo")], "term string, business_line string")
    assert {r["policy"]: r["n"] for r in a.routing_policies(BASE, terms).collect()} == {"top1": 3, "vote": 3, "vote_prior": 3}


def test_sweeps_go_on_where_they_ended(spark, cache, units, questions, tmp_path):
    r = cache.get(BASE, lambda parser: units)
    path, calls = f"file://{tmp_path}/answers", []

    def counting(df):
        calls.append(df.count())
        return plans.extractive_answer(df)

    two = questions.where("query_id <= 2")
    assert judging.generation_sweep({"m1": counting}, two, r, path).count() == 2 and calls == [2]
    both = judging.generation_sweep({"m1": counting, "m2": counting}, questions, r, path)
    assert both.count() == 6 and sum(calls[1:]) == 4  # one more of m1, three of m2
    records = both.withColumn("ideal_answer", F.lit("fifty pounds"))
    scored = judging.judge_sweep(judging.JUDGES, records, f"file://{tmp_path}/scores")
    assert scored.count() == 6 and set(scored.collect()[0]["metrics"]) >= {"proxy_faithfulness", "proxy_hallucination"}
    again = judging.judge_sweep({"lexical": lambda df: (_ for _ in ()).throw(AssertionError("judged twice"))}, records, f"file://{tmp_path}/scores")
    assert again.count() == 6


def test_model_judge(spark):
    df = spark.createDataFrame([("m", 1, "q?", "good [1]", ["c"], "ideal"), ("m", 2, "q?", "bad", ["c"], "ideal")], "model string, query_id long, question string, answer string, contexts array<string>, ideal_answer string")

    def make():
        def reply(prompt):
            if "bad" in prompt:
                raise OSError("down")
            return "I think\n0.75"

        return reply

    rows = {r["query_id"]: r for r in judging.model_judge(make)(df).collect()}
    assert rows[1]["faithfulness"] == 0.75 and rows[1]["g_eval"] == 0.75 and math.isnan(rows[2]["relevancy"])


def test_rescoring_keeps_the_rest(spark):
    records = spark.createDataFrame([(1, "one two", ["one"], "two words", "one two")], "id long, answer string, contexts array<string>, ideal_answer string, gold_text string")
    scores = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.8, 0.4)], "id long, proxy_relevancy double, proxy_hallucination double")
    got = {r["id"]: r.asDict() for r in judging.rescored(scores, records).collect()}
    assert got[1] == {"id": 1, "proxy_relevancy": 0.9, "proxy_hallucination": 0.0, "proxy_hallucination_context": "gold_source"}
    assert got[2]["proxy_hallucination"] == 0.4 and got[2]["proxy_hallucination_context"] == "retrieved"


def test_acceptance_run(spark, cache, units):
    r = cache.get(BASE, lambda parser: units)
    cases = spark.createDataFrame([
        ("A1", "How heavy may checked bags be?", "answer", "passenger", "d1", ["fifty"], ["freight"]),
        ("A2", "Where is my bag?", "deflect", None, None, [], []),
        ("A3", "Does Ryanair allow pets?", "refuse", None, None, [], []),
        ("A4", "How heavy may checked bags be?", "answer", "cargo", None, [], []),
    ], "id string, question string, behaviour string, expect_route string, expect_doc string, must_include array<string>, must_not_include array<string>")
    assert {x["id"]: x["passed"] for x in judging.acceptance_run(cases, r).collect()} == {"A1": True, "A2": True, "A3": True, "A4": False}


def test_label_gate(spark, units, questions, catalogue):
    labelled = questions.withColumn("id", F.concat(F.lit("Q"), F.col("query_id").cast("string")))
    out = io.StringIO()
    assert judging.run_gate(labelled, catalogue, lambda p: units, ["a", "b"], "a", out=out) == 0
    assert out.getvalue() == "a: 100.0% of spans found\nb: 100.0% of spans found\n0 problems\n"
    wrong = labelled.withColumns({"gold_locators": F.array(F.lit("p9")), "gold_span": F.when(F.col("query_id") == 1, "nowhere").otherwise(F.col("gold_span"))})
    out = io.StringIO()
    assert judging.run_gate(wrong, catalogue, lambda p: units, ["a"], "a", out=out) == 1
    assert "Q1: unknown locator p9" in out.getvalue() and "Q1: span not in the document" in out.getvalue() and out.getvalue().endswith("4 problems\n")


def test_service(spark, cache, units):
    service = Service(["How heavy may bags be?"]).start()
    base = f"http://127.0.0.1:{service.port}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, None if body is None else json.dumps(body).encode())) as reply:
                return reply.status, json.loads(reply.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert call("/health") == (200, {"status": "starting"}) and call("/ask", {"question": "x"})[0] == 503 and call("/config")[0] == 503
    service.retriever = cache.get(BASE, lambda parser: units)
    assert call("/health")[1]["status"] == "ok" and call("/config")[1]["size"] == 12 and call("/examples")[1]["examples"]
    status, body = call("/ask", {"question": "How heavy may checked bags be?"})
    assert status == 200 and body["route"] == "passenger" and body["citations_valid"]
    assert call("/ask", {"question": " "})[0] == 422 and call("/none")[0] == 404
    service.options = {"generate": lambda df: (_ for _ in ()).throw(OSError("model down"))}
    assert call("/ask", {"question": "How heavy may checked bags be?"})[0] == 502
    service.stop()


def test_metrics_of_runs(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, business_line string")
    none = spark.createDataFrame([], "query_id long, rank int, grade int")
    row = ranking.run_metrics(none, asked.limit(0)).collect()[0]
    assert row["n"] == 0 and row["r_at_1"] == 0 and row["ndcg_at_3"] == 0 and row["route_accuracy"] is None
    assert ranking.run_metrics(none, asked).collect()[0]["n"] == 2
    with pytest.raises(Exception, match="differ in length"):
        ranking.run_metrics(none, asked, spark.createDataFrame([(1, "a")], "query_id long, route string")).collect()
    gold = spark.createDataFrame([(1, "d", ["p1"], "Gold  Span")], "query_id long, gold_doc string, gold_locators array<string>, gold_span string")
    hits = spark.createDataFrame([(1, 1, "d", ["p9"], "the gold span here"), (1, 2, "d", ["p1", "p2"], "x"), (1, 3, "d", ["p3"], "x"), (1, 4, "e", ["p1"], "gold span")], "query_id long, rank int, doc_id string, locators array<string>, text string")
    assert [r["grade"] for r in ranking.graded(hits, gold).orderBy("rank").collect()] == [3, 2, 1, 0]


def test_gold_text_comes_in_label_order(spark, units):
    asked = spark.createDataFrame([("Q", "d1", ["p2", "p1"], "ideal"), ("R", "none", ["p1"], "ideal")], "id string, gold_doc string, gold_locators array<string>, ideal_answer string")
    got = {r["id"]: r["gold_text"] for r in evaluation.gold_text(asked, units).collect()}
    assert got["Q"].startswith("Pets travel") and got["R"] == "ideal"
