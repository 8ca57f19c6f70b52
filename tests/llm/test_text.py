"""Line dedup, near-dedup, license scan, language ID, quality: against brute force and on held-out rows."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest


from lodeseek.llm import langid, licenses, linededup, neardup, quality, queries
from lodeseek.llm.graph import components

ODD = [None, "", "\n", "  \n\t", "!!!", "12 34", "a", "word " * 30000]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, f"k{i}", 9) for i, t in enumerate(texts)], "doc_id long, text string, key string, n_lines int")


def brute_lines(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        kept = [x for x in (t or "").split("\n") if seen[key(x)] < least]
        out.append(((t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (8, 2), (5, 3)])
def test_lines(spark, batches, fanout):
    rng = random.Random(1)
    pool = ["Head", " head ", "HEAD\t", "foot", "Ähre", "ähre", "x y", "", "  ", "\x0bz\x0c", "rare 1", "rare 2"]
    texts = ODD + ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    docs = rows(spark, texts)
    got = linededup.drop_common_lines(docs, min_docs=10, batches=batches, fanout=fanout)
    assert got.columns == docs.columns + ["n_dropped"]
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()}
    assert found == dict(enumerate(brute_lines(texts, 10)))
    assert linededup.drop_common_lines(docs.limit(0)).count() == 0


def test_lines_query(spark, sf):
    got = {r["doc_id"]: tuple(r) for r in queries.op2_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == {r[0]: r for r in con.execute("SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (" + queries.OP2_SQL + ")").fetchall()}


def test_kept_runs(spark, tmp_path):
    """Runs saved after some batches go on with later ones."""
    rng = random.Random(7)
    texts = ["\n".join(rng.choice(["head", "foot", "x", "y", "z", f"own {i}"]) for _ in range(4)) for i in range(40)]
    docs = rows(spark, texts)
    runs = linededup.LineRuns(spark, min_docs=10, fanout=2)
    for i in range(3):
        runs.add_documents(docs.where(f"doc_id % 5 = {i}"))
    runs.save(f"file://{tmp_path}/kept")
    again = linededup.LineRuns.open(spark, f"file://{tmp_path}/kept")
    for i in (3, 4):
        again.add_documents(docs.where(f"doc_id % 5 = {i}"))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.drop_lines(docs, again.common()).collect()}
    assert got == dict(enumerate(brute_lines(texts, 10)))


def test_long_documents_take_time_in_proportion(spark):
    """Many common lines in a text: four times the lines take far less than sixteen times the time."""
    import time

    def seconds(n):
        docs = spark.range(10).selectExpr("id as doc_id", f"array_join(transform(sequence(1, {n}), i -> concat('line ', i)), '\n') as text")
        began = time.time()
        assert linededup.drop_common_lines(docs, batches=1).agg({"n_dropped": "sum"}).collect()[0][0] == 10 * n
        return time.time() - began

    seconds(1000)
    assert seconds(40_000) < 8 * max(1.0, seconds(10_000))


def test_repeated_rows(spark):
    docs = rows(spark, ["a\nb"]).union(rows(spark, ["a\nb"]))
    assert linededup.drop_common_lines(docs, min_docs=2).select("text", "n_dropped").distinct().collect() == [("", 2)]


def brute_groups(texts, least=0.8):
    k = [neardup.kmers(neardup.word_hashes(t), 5) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(k[i]) and len(k[j]) and neardup.aligned(k[i], k[j], least)[0] >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def near_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = list(ODD)
    passage = " ".join(word() for _ in range(60))
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [word()]
            texts.append((" " if rng.random() < 0.5 else "\n").join(copy).upper())
    texts += [passage + " " + " ".join(word() for _ in range(30)) for _ in range(12)]  # a passage alone makes no copy
    return texts


def test_near_duplicates(spark, monkeypatch):
    texts = near_texts()
    want = brute_groups(texts)
    monkeypatch.setattr(neardup, "TILE", 3)
    for options in ({}, {"tables": 40, "rows": 1, "l": 1}):  # the second: large mixed buckets
        got = {r["doc_id"]: r for r in neardup.near_duplicates(rows(spark, texts), **options).collect()}
        assert [got[i]["group_id"] for i in range(len(texts))] == want
        assert all(r["kept"] == (r["group_id"] == i) for i, r in got.items())
    kept = neardup.keep_one(rows(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == set(want)
    assert kept.columns == rows(spark, texts).columns


def test_near_duplicates_odd_rows(spark):
    same = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, "ONE two, three four five six"), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(same).select("doc_id", "class_id", "group_id", "kept").collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, None, None, True), (2, 1, 1, False), (3, 3, 3, True)], key=str)
    assert sorted((r["doc_id"] for r in neardup.keep_one(same).collect()), key=str) == sorted([1, None, 3], key=str)
    assert neardup.near_duplicates(same.limit(0)).count() == 0
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    mixed = spark.createDataFrame([(1, text), (1, "other words of quite another text with the same id"), (2, text + " one"), (3, "other words of quite another text with the same id")], "doc_id long, text string")
    got = sorted(tuple(r) for r in neardup.near_duplicates(mixed).collect())
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert {(r["doc_id"], r["text"]) for r in neardup.keep_one(mixed).collect()} == {(1, text), (1, "other words of quite another text with the same id")}


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.permutation(30)[: rng.integers(1, 30)].astype(np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.permutation(60)[:8].astype(np.uint64)])
        b = b[np.sort(np.unique(b, return_index=True)[1])]
        lcs = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                lcs[i + 1, j + 1] = lcs[i, j] + 1 if a[i] == b[j] else max(lcs[i, j + 1], lcs[i + 1, j])
        want = 2 * lcs[-1, -1] / (len(a) + len(b))
        got = neardup.aligned(a, b, 0.8)[0]
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def edited(rng, words, share):
    """A copy with that share of the words replaced, at random places."""
    copy = words.copy()
    at = rng.choice(len(words), int(share * len(words)), replace=False)
    copy[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
    return copy


@pytest.mark.parametrize("n", [60, 200, 1000])
def test_edited_copies_meet_and_are_similar(n):
    """Copies with 3 of 100 words replaced are similar; pairs at the threshold share a bucket."""
    rng = np.random.default_rng(n)
    met = pairs = 0
    for _ in range(300):
        words = rng.integers(0, 2**63, n).astype(np.uint64)
        a = neardup.kmers(words, 5)
        assert neardup.aligned(a, neardup.kmers(edited(rng, words, 0.03), 5), 0.8)[0] >= 0.8
        b = neardup.kmers(edited(rng, words, 0.045), 5)
        if neardup.aligned(a, b, 0.8)[0] >= 0.8:
            pairs += 1
            met += (neardup.order_minhash(a, 30, 1, 4) == neardup.order_minhash(b, 30, 1, 4)).any()
    assert pairs > 30 and met / pairs >= 0.985


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(2000, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_licenses(spark):
    mit, apache = licenses.NOTICES["MIT"], licenses.NOTICES["Apache-2.0"]
    filler = "lorem ipsum dolor sit amet " * 40
    words = mit.split()
    broken = " ".join(words[:14] + ["XX"] + words[14:])
    texts = [*ODD, filler + mit.upper() + filler, apache, broken, " ".join(words[:8]), apache + "\n" + mit, filler]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(rows(spark, texts)).collect()}
    n = len(ODD)
    assert got == {(n, "MIT"), (n + 1, "Apache-2.0"), (n + 2, "MIT"), (n + 4, "Apache-2.0"), (n + 4, "MIT")}
    assert licenses.scan(rows(spark, texts).limit(0)).count() == 0
    twice = licenses.scan(rows(spark, [filler.join([mit, mit, apache, ""]), licenses.BODIES["BSD-3-Clause-text"]])).collect()
    assert sorted(r["first_word"] for r in twice if r["doc_id"] == 0 and r["license"] == "MIT") == [0, len(neardup.word_hashes(mit + filler))]
    assert {r["license"] for r in twice if r["doc_id"] == 0} == {"MIT", "Apache-2.0"}
    assert {r["license"] for r in twice if r["doc_id"] == 1} == {"BSD", "BSD-2-Clause-text", "BSD-3-Clause-text"}
    same = licenses.scan(rows(spark, [apache]).union(rows(spark, [apache]))).count()
    assert same == 2


def test_licenses_against_all_windows(spark, sf):
    """Every template against every stretch of its length, without bands."""
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = neardup.word_hashes(r["text"])
        for name, notice in licenses.TEMPLATES.items():
            own = neardup.word_hashes(notice)
            k = min(5, len(own))
            t, h = licenses.shingles(own, k), licenses.shingles(words, k)
            m, step = len(t), max(1, len(t) // 8)
            hit = np.isin(h, t)
            for w in np.flatnonzero(hit):
                a, z = max(0, w - m), w + m + step
                if len(np.unique(h[a:z][hit[a:z]])) / len(np.unique(t)) >= 0.8:
                    want.add((r["doc_id"], name))
                    break
    got = {(r["doc_id"], r["license"]) for r in queries.op6_license_scan(spark, sf).collect()}
    assert got == want and want


def test_language(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = queries.op5_language_id(spark, d).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98
    assert got.score.between(0, 1).all()
    model = langid.fit(docs)
    odd = langid.identify(rows(spark, ODD), model).collect()
    assert [r["lang_pred"] for r in odd[:6]] == ["und"] * 6 and odd[7]["lang_pred"] != "und"
    assert langid.identify(rows(spark, []), model).count() == 0
    assert langid.identify(rows(spark, ["abc"]), langid.fit(docs.limit(0))).collect()[0]["lang_pred"] == "und"


def test_forward_backward():
    """Against the sum over all labellings."""
    import itertools

    rng = np.random.default_rng(1)
    T, s = rng.normal(size=(3, 3)), rng.normal(size=3)
    es = [rng.normal(size=(n, 3)) for n in (4, 1, 0, 3)]
    marginals, pairs = langid.forward_backward(es, T, s)
    all_pairs = np.zeros((3, 3))
    for e, m in zip(es, marginals, strict=True):
        want, total, p = np.zeros((len(e), 3)), 0.0, np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=len(e)) if len(e) else []:
            w = np.exp(s[y[0]] + sum(e[t, y[t]] for t in range(len(e))) + sum(T[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            for t in range(len(e)):
                want[t, y[t]] += w
            for a, b in zip(y, y[1:], strict=False):
                p[a, b] += w
        if len(e):
            assert np.allclose(m, want / total)
            all_pairs += p / total
    assert np.allclose(pairs, all_pairs)


def test_code_switching():
    model = langid.train([("the house is on the hill and the river runs " * 4, "en"), ("das haus ist auf dem berg und der fluss fliesst " * 4, "de")] * 8, words_each=6)
    words = model.emissions(["the house is on the hill das haus ist auf dem berg"])
    (m,), _ = langid.forward_backward(words, model.transition, model.start)
    assert [model.languages[i] for i in m.argmax(1)] == ["en"] * 6 + ["de"] * 6


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op8_quality_classifier(spark, d).join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    for label, least in ((1, 0.97), (0, 0.88)):
        some = got[got.quality == label]
        assert (some.predicted == label).mean() >= least
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_quality_by_hand(spark, sf):
    """Scores against compressing each chunk anew; odd rows; rows without labels."""
    import zstandard

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    for r in quality.score(docs.select("doc_id", "text").limit(60).union(rows(spark, ODD).select("doc_id", "text")), model).collect():
        sizes = []
        for words in (model.good, model.bad):
            tool = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_checksum=False, write_dict_id=False)
            data = (r["text"] or "").encode()
            sizes.append(sum(len(tool.compress(data[i : i + 200])) for i in range(0, len(data), 200)))
        raw = (sizes[1] - sizes[0]) / (sum(sizes) + 100)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.slope * raw + model.level))), abs=0.02)
    got = quality.score(rows(spark, ["same words here", "same words here"]), model).collect()
    assert got[0]["score"] == got[1]["score"]
    assert quality.score(rows(spark, []), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(rows(spark, ODD), none).collect()} == {0.5}
    few = quality.fit(rows(spark, ["fine words", "BAD!! BAD!!"]), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(rows(spark, ODD), few).collect())
