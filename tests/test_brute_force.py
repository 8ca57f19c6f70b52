"""Queries that no SQL expresses, against plain Python over the same tables."""

import math
import re
import unicodedata
from collections import Counter

import pytest

from lodeseek.functions.text import STOP_WORDS, stem
from lodeseek.operators import chunking
from lodeseek.plans import corpus_queries, search_queries
from lodeseek.plans.corpus_queries import SAMPLES


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_match_normalise_nfkd(spark, sf, documents):
    def fold(t):
        t = unicodedata.normalize("NFKD", t).translate(str.maketrans("‘’“”–— ", "''\"\"-- "))
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ").lower()

    want = {i: fold(t) for i, t in SAMPLES} | {i: fold(r["text"]) for i, r in documents.items()}
    assert {r["doc_id"]: r["text"] for r in corpus_queries.match_normalise_nfkd(spark, sf).collect()} == want


def test_bm25_stemmed(spark, sf, documents):
    def terms(t):
        return [stem(w) for w in re.findall(r"[^\W]{2,}", t.lower()) if w not in STOP_WORDS]

    held = {i: terms(r["text"]) for i, r in documents.items()}
    mean = sum(map(len, held.values())) / len(held)
    df = Counter(t for ts in held.values() for t in set(ts))
    want = {}
    for q in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        asked = set(terms(" ".join(q["text"].split(" ")[:8])))
        scores = {}
        for i, ts in held.items():
            counts = Counter(ts)
            s = sum(math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * counts[t] / (counts[t] + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in asked if counts[t])
            if any(counts[t] for t in asked):
                scores[i] = math.floor(s * 1e6 + 0.5) / 1e6
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10], 1):
            want[q["item_id"], rank] = (i, s)
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in search_queries.bm25_stemmed(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in got)
    assert sum(got[k][0] == want[k][0] for k in got) >= 0.99 * len(got)


def naive_fixed(text, size, step):
    words = text.split()
    out = []
    for i in range(0, len(words), step):
        out.append(words[i : i + size])
        if i + size >= len(words):
            break
    return out


def test_chunk_recursive(spark, sf, documents):
    by_doc = {}
    for r in corpus_queries.chunk_recursive(spark, sf).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, r in documents.items():
        chunks = sorted(by_doc.get(i, []), key=lambda c: c["chunk_no"])
        assert [(c["start"], c["end"], c["text"]) for c in chunks] == [(c["start"], c["end"], r["text"][c["start"] : c["end"]]) for c in chunks]
        covered = set()
        for c in chunks:
            assert len(c["text"].split()) <= 100 and c["text"] == c["text"].strip()
            covered.update(range(c["start"], c["end"]))
        assert all(k in covered or ch.isspace() for k, ch in enumerate(r["text"]))
        assert all(a["start"] < b["start"] and a["end"] < b["end"] for a, b in zip(chunks, chunks[1:], strict=False))


def test_chunk_rule_aware(spark, sf, documents):
    by_doc = {}
    for r in corpus_queries.chunk_rule_aware(spark, sf).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, r in documents.items():
        chunks = sorted(by_doc.get(i, []), key=lambda c: c["chunk_no"])
        assert all(len(c["text"].split()) <= 60 for c in chunks)
        lines = r["text"].split("\n")
        if i % 2 == 0:
            ruled = "\n".join(f"RULE {k}: {x}" if k % 4 == 0 else x for k, x in enumerate(lines, 1))
            sections = [s.strip() for s in re.split(r"(?m)(?=^RULE \d+:)", ruled) if s.strip()]
            short = [s for s in sections if len(s.split()) <= 60]
            assert set(short) <= {c["text"] for c in chunks}
            covered = {k for c in chunks for k in range(c["start"], c["end"])}
            assert all(c["text"] == ruled[c["start"] : c["end"]] for c in chunks)
            assert all(k in covered or ch.isspace() for k, ch in enumerate(ruled))
        else:
            assert [(c["start"], c["text"]) for c in chunks] == [(a, r["text"][a:b].strip()) for a, b in ((a + len(r["text"][a:b]) - len(r["text"][a:b].lstrip()), b) for a, b in chunking.split_spans(r["text"], 60, 10))]


def test_chunk_corpus(spark, sf, documents):
    got = {r["chunk_id"]: r for r in corpus_queries.chunk_corpus(spark, sf).collect()}
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    for p in parts:
        row = got.pop(f"{-p['p_partkey']}::part:{p['p_partkey']}")
        assert (row["locators"], row["text"], row["meta"]) == ([f"part:{p['p_partkey']}"], p["p_name"], "strategy=presplit")
    for i, r in documents.items():
        lines = r["text"].split("\n")
        offsets, at = [], 0
        for x in lines:
            offsets.append((at, at + len(x)))
            at += len(x) + 1
        text = " ".join(lines)
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        for n, words in enumerate(naive_fixed(text, 80, 70)):
            row = got.pop(f"{i}::fixed_ov::{n}")
            a, b = spans[n * 70][0], spans[n * 70 + len(words) - 1][1]
            assert row["text"] == text[a:b] and row["title"] == f"doc {i}" and row["business_line"] == r["lang"]
            assert row["locators"] == [f"p{k}" for k, (s, e) in enumerate(offsets, 1) if s < b and a < e]
            assert row["meta"] == f"n_tokens={len(words)},overlap=10,size=80,strategy=fixed_ov"
    assert not got
