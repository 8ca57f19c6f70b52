"""Embedding near-dedup and nearest neighbours against brute force."""

import numpy as np
import pytest

from lodeseek.llm import ann, queries, vecdedup

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0] * 8, [NAN] + [1.0] * 7, [INF] * 8, [None] + [1.0] * 7, [1.0, 2.0]]


def vectors(n, seed=0, groups=6):
    """Scattered unit vectors, groups of near and exact copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    for g in range(groups):
        at = rng.integers(0, n, 12)
        x[at] = x[at[0]] + rng.normal(size=(12, 8)) * 0.05
        x[at[:3]] = x[at[0]]
    return x.astype(np.float32)


def frame(spark, x, odd=ODD, kind="float"):
    rows = [(i, [float(v) for v in r], 1, "a") for i, r in enumerate(x)] + [(len(x) + i, v, 1, "b") for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n_links int, rep string")


def brute(x, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ok = u @ u.T >= least
    np.fill_diagonal(ok, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(ok, label[None, :], len(x)).min(1))
        if (new == label).all():
            return ok.sum(1), label
        label = new


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links(spark, kind):
    x = vectors(400)
    links, label = brute(x, 0.95)
    assert links.sum()
    got = {r["vec_id"]: r for r in vecdedup.near_duplicate_vectors(frame(spark, x, kind=kind), 0.95, tile=4).collect()}
    assert len(got) == len(x) + len(ODD)
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert all(got[len(x) + i]["n_links"] == 0 and got[len(x) + i]["kept"] for i in range(len(ODD)))


def test_links_query(spark):
    d = "/root/testdata/sf0.1"
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()])
    links, label = brute(x, 0.95)
    got = queries.op4_embedding_near_dedup(spark, d).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == links.tolist() and got.component_id.tolist() == label.tolist()


def test_links_of_nothing(spark):
    assert vecdedup.near_duplicate_vectors(frame(spark, [], odd=[])).count() == 0
    assert vecdedup.near_duplicate_vectors(frame(spark, [])).count() == len(ODD)
    null = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vecdedup.near_duplicate_vectors(null).collect()}
    assert got == {None: (0, None, True), 1: (1, 1, True), 2: (1, 1, False)}


def test_links_of_repeated_ids(spark):
    """Every row is a vector of its own, whatever its id."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=8), rng.normal(size=8)
    near = lambda v: [float(c) for c in v + rng.normal(size=8) * 0.01]
    rows = [(1, [float(c) for c in a]), (1, [float(c) for c in b]), (2, near(a)), (3, near(b)), (4, near(b)), (4, [-float(c) for c in b]), (4, [-float(c) for c in b])]
    got = vecdedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, tile=2)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True)])


def test_links_within_clusters(spark):
    """Tight clusters, whose buckets are large and mixed."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 64))
    x = (centres[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, 64)) * 0.225).astype(np.float32)
    links, label = brute(x, 0.95)
    got = vecdedup.near_duplicate_vectors(frame(spark, x), 0.95).toPandas().sort_values("vec_id")[: len(x)]
    assert links.sum() and got.n_links.sum() >= 0.998 * links.sum() and (got.n_links <= links).all()
    assert (got.component_id.to_numpy() == label).mean() >= 0.99


def planted(n, norm, seed=0, pairs=1000, d=64):
    """n unit vectors around a common mean of about this norm; the first pairs lie at a cosine of 0.951 (i, pairs + i)."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.sqrt((1 - norm**2) / d)
    x[:, 0] += norm
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(pairs, d))
    off -= (off * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x[pairs : 2 * pairs] = 0.951 * x[:pairs] + np.sqrt(1 - 0.951**2) * off
    return x


@pytest.mark.parametrize("norm", [0.0, 0.71, 0.9])
@pytest.mark.parametrize("n", [2_000, 10_000, 10**6])
def test_planted_pairs_meet(n, norm):
    x = planted(min(n, 10_000), norm)
    model, tables, bits = vecdedup.index_of(x, n, 0.95, 128)
    codes = model.codes(x[:2000])[:, : tables * bits].reshape(2000, tables, bits)
    assert (codes[:1000] == codes[1000:]).all(2).any(1).mean() >= 0.996


def test_links_around_a_common_mean(spark):
    x = planted(4000, 0.9).astype(np.float32)
    links, _ = brute(x, 0.95)
    assert links.sum() >= 2000
    got = vecdedup.near_duplicate_vectors(frame(spark, x), 0.95).toPandas().sort_values("vec_id")
    assert got.n_links[: len(x)].sum() >= 0.998 * links.sum()


def test_nearest_query(spark):
    d = "/root/testdata/sf0.1"
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()])
    got = queries.op3_approximate_nearest_neighbours(spark, d).toPandas()
    found = total = 0
    for q, rows in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 21)) and q not in set(rows.vec_id)
        assert np.allclose(rows.score, s[rows.vec_id]) and (np.diff(rows.score) <= 0).all()
        found += len(set(np.argsort(-s, kind="stable")[:20]) & set(rows.vec_id))
        total += 20
    assert total == 20 * len(range(0, len(x), 20))
    assert found / total >= 0.9


def test_nearest_of_few(spark):
    x = vectors(12, groups=0)
    got = ann.nearest(frame(spark, x), every=5, k=20).toPandas()
    for q in (0, 5, 10):
        rows = got[got.query_id == q].sort_values("rank")
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))
        assert rows.vec_id.tolist() == want
    assert set(got.query_id) == {0, 5, 10}
    assert ann.nearest(frame(spark, [], odd=[])).count() == 0
    assert ann.nearest(frame(spark, [])).count() == 0
    tied = spark.createDataFrame([(i, [1.0, 0.0]) for i in (20, 3, 7, 5)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in ann.nearest(tied).orderBy("rank").collect()] == [3, 5, 7]


def recall(spark, x, **options):
    """The share of true neighbours found: rows whose score reaches the 20th best."""
    got = ann.nearest(frame(spark, x, kind="double"), **options).toPandas()
    found = 0
    for q, rows in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(rows) == min(20, len(x) - 1)
        found += (rows.score >= np.sort(s)[-20] * (1 - 1e-12)).sum()
    return found / len(got)


def shaped(kind, n, d=64):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = rng.normal(size=(6, d))[rng.integers(0, 6, n)] + x * 0.1
    elif kind == "copies":
        x[: n // 3] = x[0]
        x[n // 3 : n // 2] = x[n // 3] + rng.normal(size=(n // 2 - n // 3, d)) * 0.01
    elif kind == "mixed":
        x *= np.exp(rng.normal(size=(n, 1)) * 2)
    elif kind == "outlier":
        x[7] *= 1e9
    return x


@pytest.mark.parametrize("kind", ["scattered", "clusters", "copies", "mixed", "outlier"])
def test_nearest_of_shapes(spark, kind):
    assert recall(spark, shaped(kind, 2000)) >= 0.9


def test_nearest_with_hot_nodes(spark, monkeypatch):
    """Rows of nodes that many ask for come by broadcast, with the same result."""
    monkeypatch.setattr(ann, "FEW", 20)
    seen, real = [], ann.hot_nodes
    monkeypatch.setattr(ann, "hot_nodes", lambda front, total: seen.append(real(front, total)) or seen[-1])
    x = shaped("scattered", 600, 16)
    x[5] *= 50  # a hub
    assert recall(spark, x, every=3) >= 0.9
    assert any(5 in hot for hot in seen) and max(map(len, seen)) > 1


def test_nearest_of_copies(spark):
    """Ties among more equal vectors than are asked for go to the smaller ids."""
    x = np.concatenate([np.tile([[1.0, 2.0]], (100, 1)), [[0.5, 0.1], [3.0, 3.0]]])
    got = ann.nearest(frame(spark, x, odd=[], kind="double"), every=50).toPandas()
    assert set(got.query_id) == {0, 50, 100}
    for q, want in ((0, [101, *range(1, 20)]), (50, [101, *range(19)]), (100, [101, *range(19)])):
        rows = got[got.query_id == q].sort_values("rank")
        assert rows.vec_id.tolist() == want and rows["rank"].tolist() == list(range(1, 21))


def test_nearest_builds_until_settled(spark, monkeypatch):
    shares, settling = [], ann.settling

    def seen(graph, delta):
        last = graph.selectExpr("sum(replaced) r", "sum(size(nb)) n").collect()[0]
        shares.append(last["r"] / last["n"])
        return settling(graph, delta)

    monkeypatch.setattr(ann, "settling", seen)
    monkeypatch.setattr(ann, "CELL", 64)
    x = np.random.default_rng(3).normal(size=(1500, 32)).astype(np.float32)
    got = ann.nearest(frame(spark, x)).toPandas()
    assert shares[-1] <= 0.005 < min(shares[:-1])
    found = 0
    for q, rows in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        found += len(set(np.argsort(-s, kind="stable")[:20]) & set(rows.vec_id))
    assert found / len(got) >= 0.9
