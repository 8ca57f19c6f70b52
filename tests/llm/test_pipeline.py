"""The pipeline: every stage on what the one before kept, against the operators' brute-force versions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeseek.llm import langid, quality
from lodeseek.llm.common import fold
from tests.llm.test_text import brute_groups, brute_lines

ODD = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (10**6 + 2, "!!! ??? 123", "en", "src1", 11), (None, "a text without an id but with words of some kind in it", "en", None, 1)]


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(ODD, docs.schema)).withColumns({"score": F.lit("mine"), "kept": F.lit(7), "_id": F.lit(0)})
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
        assert {(r["score"], r["kept"], r["_id"]) for r in df.select("score", "kept", "_id").distinct().collect()} == {("mine", 7, 0)}


def test_classifiers(spark, sf, steps):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(fold("doc_id", 4) != 2)
    model = quality.fit(steps[0], labels)
    want = {i for i, t in texts(steps[0]).items() if model.probability(model.raw([t]))[0] >= 0.7}
    assert set(texts(steps[1])) == want
    model = langid.fit(steps[1].where(fold("doc_id", 5) != 0))
    want = set()
    for i, t in texts(steps[1]).items():
        (lang,), score = model.predict([t])
        if lang != "und" and score[0] >= corpus_pipeline.LANGUAGE_SHARE:
            want.add(i)
    assert set(texts(steps[2])) == want
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert len(good & want) >= 0.95 * len(good)


def test_lines(steps):
    before, after = texts(steps[2]), texts(steps[3])
    want = brute_lines(list(before.values()), 10)
    assert after == {i: w[2] for i, w in zip(before, want, strict=True)}
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect())


def test_near_duplicates(steps):
    before = texts(steps[3])
    ids = sorted(i for i in before if i is not None)
    want = {ids[g] for g in set(brute_groups([before[i] for i in ids]))} | {i for i in before if i is None}
    assert set(texts(steps[4])) == want and len(want) < len(before)


def test_packing(steps):
    packed = steps[5].toPandas()
    assert len(set(packed.doc_id.dropna())) == steps[4].where("doc_id is not null").count()
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count()
