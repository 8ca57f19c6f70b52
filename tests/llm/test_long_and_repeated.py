"""Texts of several megabytes, repeated rows and equal ids, for every operator on texts."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from lodeseek.llm import langid, licenses, linededup, neardup, quality
from lodeseek.llm.bpe import encode_decode
from lodeseek.llm.dac import round_trip
from lodeseek.llm.packing import pack
from tests.llm.test_tokens import BYTES, WORDS, library

LONG = " ".join(f"word{i % 977} und so weiter" for i in range(150_000))  # 3 MB
SOLID = "abcdefg" * 60_000  # one word of 400 kB
LINES = "\n".join(f"line {i % 5000}" for i in range(200_000))
TEXTS = {1: LONG, 2: SOLID, 3: LINES, 4: "short text", 5: "short text", 6: None}


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(TEXTS.items()) + [(4, "short text"), (4, "another text under the same id")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def ids():
    t = library(BYTES)
    return {text: t.encode(text or "", add_special_tokens=False).ids for text in [*TEXTS.values(), "another text under the same id"]}


def test_token_file(docs, ids):
    got = sorted(tuple(r) for r in round_trip(docs, BYTES, segment_ids=50_000).collect())
    start, want = 0, []
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    for doc_id, text in sorted(rows):
        row = np.array([*ids[text or None], 2], "<u4")
        want.append((doc_id, start, len(row), zlib.crc32(row.tobytes())))
        start += len(row)
    assert got == sorted(want)


def test_packing(docs, ids):
    got = pack(docs, BYTES).toPandas()
    assert got.length.sum() == sum(len(ids[r["text"]]) + 1 for r in docs.collect())
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    long = got[got.doc_id == 1].sort_values("piece")
    row = np.array([*ids[LONG], 0], "<u4")
    assert [zlib.crc32(row[p.start : p.start + p.length].tobytes()) for p in long.itertuples()] == long.ids_crc32.tolist()
    assert len(got[got.doc_id == 4]) == 3


def test_bpe(docs):
    t = library(WORDS)
    got = encode_decode(docs, WORDS).collect()
    assert len(got) == docs.count()
    for r in got:
        want = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_lines(docs):
    got = linededup.drop_common_lines(docs, min_docs=3)
    rows = sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in got.select("doc_id", "n_lines", "n_dropped").collect())
    assert rows == [(1, 1, 0), (2, 1, 0), (3, 200_000, 0), (4, 1, 0), (4, 1, 1), (4, 1, 1), (5, 1, 1), (6, 1, 0)]


def test_near_duplicates(spark, docs):
    copy = LONG.replace("word5 ", "Wort5 ", 1)
    got = {(r["doc_id"], r["group_id"]) for r in neardup.near_duplicates(docs.union(spark.createDataFrame([(7, copy)], docs.schema))).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 1)}


def test_licenses(spark):
    text = LONG + " " + licenses.NOTICES["MIT"] + " " + LONG
    rows = spark.createDataFrame([(1, text), (1, text), (2, SOLID)], "doc_id long, text string")
    got = [(r["doc_id"], r["license"], r["first_word"]) for r in licenses.scan(rows).collect()]
    assert got == [(1, "MIT", len(neardup.word_hashes(LONG)))] * 2


def test_quality(spark, docs):
    good, bad = ["Plain words in a row make good prose. " * 20] * 30, ["BUY!!! NOW!!! $$$ " * 40] * 30
    rows = spark.createDataFrame([(100 + i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, int(i < 30)) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(rows, labels)
    got = quality.score(docs.union(rows), model).collect()
    assert len(got) == docs.count() + 60 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["text"] == "short text"}) == 1
    assert all(r["predicted"] == int(r["doc_id"] < 130) for r in got if r["doc_id"] >= 100)


TINY = [("the house on the hill the river", "en"), ("das haus auf dem berg der fluss", "de"), ("la maison sur la colline la riviere", "fr")] * 6


def test_language_by_all_labellings(spark):
    """The predicted language and score against the sum over all ways to label a text's words."""
    model = langid.train(TINY, words_each=4, rounds=10)
    texts = ["the haus sur", "das haus the hill", "colline", "x y", "", None, "fluss la la the", "donaudampfschifffahrtsgesellschaftskapitaen the"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts])], "doc_id long, text string")
    got = {}
    for r in langid.identify(rows, model).collect():
        got.setdefault(r["text"], set()).add((r["lang_pred"], round(r["score"], 9)))
    for text in texts:
        words = langid.words_of(text or "")
        if not words:
            assert got[text] == {("und", 0.0)}
            continue
        scores = [sum((model.weights[f].astype(float) for f in langid.word_features([w])[0] if f >= 0), np.zeros(3)) for w in words]
        mass, total = np.zeros(3), 0.0
        for y in itertools.product(range(3), repeat=len(words)):
            p = np.exp(model.start[y[0]] + sum(s[k] for s, k in zip(scores, y, strict=True)) + sum(model.transition[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            for k in y:
                mass[k] += p
        (name, score), = got[text]
        assert name == model.languages[int(mass.argmax())] and score == pytest.approx(mass.max() / total / len(words), abs=1e-5)


def test_language_reads_all_of_a_long_run(spark):
    """In a run of letters longer than a word, what stands in the middle counts; every label is learned."""
    many = [(f"{c}q{c}w {c}e{c}r {c}t{c}z " * 3, f"l{i:03d}") for i, c in enumerate(chr(0x4E00 + k) for k in range(80))]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(many * 3)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 80
    middle = "q" * 40 + many[70][0].replace(" ", "") * 8 + "q" * 40
    got = langid.identify(spark.createDataFrame([(1, middle), (2, LONG), (3, SOLID)], "doc_id long, text string"), model).collect()
    assert got[0]["lang_pred"] == "l070" and all(0 < r["score"] <= 1 for r in got)
    short = langid.fit(docs, most_rows=80)
    assert len(short.languages) == 80
