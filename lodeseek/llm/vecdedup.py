"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

ITQ learns a rotation, on a bounded sample, that balances the signs of the centred, rotated unit vectors; the signs are
a binary code, of several rotations if the vectors are short.  The code is cut into substrings, one hash table each.
Codes whose Hamming distance is below the number of tables agree in one of them at least.  Pairs that meet in a table
are compared by cosine on the original vectors, in double precision, and counted in the first table where they meet.

Equal vectors are one class and stand in for each other with their number.  A bucket is cut into tiles by a hash, and
pairs of tiles are compared as matrices; a pair of tiles returns sums of links a vector and a spanning
forest of its links, never the links.  So hot buckets spread over many tasks, and no bucket is capped.  Tiles of large
buckets are larger, as a vector travels once for every tile of its bucket.  Vectors of equal codes are compared in the
first table alone: later on, buckets of a single code are left out.

Recall: centring widens the angle of a pair, so the share of bits that differ is measured on the sample, on pairs made
to lie exactly at the threshold (bit_errors).  The number of tables follows from it: such pairs are missed with a mean
probability of 1 / 2000 at most (fewest_tables).  The length of the substrings is the cheapest one for the number of
vectors (fitted_shape); where one bucket with all vectors is cheaper than any tables, all pairs are compared.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths do not link; every row is a vector of its own, so rows of equal id have each their own links, and
equal rows link with each other; null ids stay alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, parts
from .graph import components


#: Vectors in a tile of a large bucket.
LARGE = 1024


@dataclass
class ITQ:
    mean: np.ndarray
    basis: np.ndarray  # dimensions x bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bits of unit vectors, shape (rows, bits)."""
        return ((x - self.mean) @ self.basis > 0).astype(np.uint8)


def learn(x: np.ndarray, bits: int, rounds: int = 30) -> ITQ:
    """Principal directions, then rotations that bring the projections near their signs; more bits than dimensions
    take further rotations, each from another random start."""
    rng = np.random.default_rng(0)
    if not len(x):
        return ITQ(np.zeros(x.shape[1]), np.zeros((x.shape[1], bits)))
    mean = x.mean(0)
    axes = np.linalg.eigh((x - mean).T @ (x - mean))[1].T[::-1]  # of the small square matrix, whatever the sample
    bases = []
    for at in range(0, bits, x.shape[1]):
        n = min(x.shape[1], bits - at)
        v = (x - mean) @ axes[:n].T
        r = np.linalg.qr(rng.normal(size=(n, n)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        bases.append(axes[:n].T @ r)
    return ITQ(mean, np.concatenate(bases, 1) if bases else np.zeros((x.shape[1], 0)))


def good_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part; floats stay floats until they are compared."""
    return all_vectors(df, id_col, vec_col).where("fine").drop("fine")


def all_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, fine) of every row; ``fine`` says which take part."""
    v = F.col(vec_col)
    v = v if df.schema[vec_col].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    named = F.col(id_col).isNotNull() & v.isNotNull()
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(named & fine, F.lit(False)).alias("fine"))


def unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicate_vectors(df: DataFrame, least: float = 0.95, tile: int = 128, fit_rows: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.  ITQ is fitted on at most ``fit_rows`` vectors, chosen by a
    hash of their ids; all vectors are indexed."""
    bounded_batches(df.sparkSession)
    keys = [F.when(F.col("fine"), x).alias(n) for n, x in (("d", F.size("v")), ("h1", F.xxhash64("v")), ("h2", F.xxhash64(F.lit("vector"), F.col("v"))))]
    rows = all_vectors(df, id_col, vec_col).select("id", "v", *keys)
    classes = rows.where("d is not null").groupBy("d", "h1", "h2").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")  # written, so that the numbers stay
    sizes = [r["d"] for r in classes.select("d").distinct().collect()]  # vector lengths, a handful
    out, edges = None, None
    for d in sizes:
        links, forest = _links(classes.where(F.col("d") == d), d, least, tile, fit_rows)
        out, edges = (links, forest) if out is None else (out.unionByName(links), edges.unionByName(forest))
    if out is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    named = classes.select("rep", "least_id").join(components(edges), F.col("rep") == F.col("node")).select("rep", "least_id", "component")
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    groups = named.join(names, "component").select("rep", "component_id")
    of_class = classes.select("d", "h1", "h2", "rep", "least_id", "copies").join(out, "rep", "left").join(groups, "rep", "left")
    of_class = of_class.select("d", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    full = rows.select(F.col("id").alias("vec_id"), "d", "h1", "h2").join(of_class, ["d", "h1", "h2"], "left")
    full = full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return full.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def bit_errors(model: ITQ, x: np.ndarray, least: float, rows: int = 2000) -> np.ndarray:
    """Share of bits that differ between vectors of the sample and others at a cosine of ``least`` to them, off in any
    direction and off towards another vector of the sample: (2, rows)."""
    rng, x = np.random.default_rng(1), x[:rows]
    codes, out = model.codes(x), []
    for off in (rng.normal(size=x.shape), np.roll(x, 1, 0) - x):
        off = off - (off * x).sum(1, keepdims=True) * x
        off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
        near = least * x + np.sqrt(max(1 - least * least, 0)) * off
        near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-12)
        out.append((codes != model.codes(near)).mean(1))
    return np.stack(out)


def fewest_tables(errors: np.ndarray, bits: int, most: int = 1 << 14) -> int:
    """The least number of tables that miss pairs of such shares of differing bits with a mean probability of at most
    1 / 2000, of either kind; more than ``most`` if those do not suffice."""
    miss = 1 - (1 - errors) ** bits
    enough = lambda tables: (miss**tables).mean(1).max() <= 1 / 2000
    low, high = 1, most + 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid + 1, high)
    return low


def fitted_shape(n: int, d: int, errors: np.ndarray, tile: int) -> tuple[int, int]:
    """(tables, bits) that move the fewest bytes: each table moves a vector and its earlier codes once for every tile
    of its bucket.  (1, 0) compares all pairs."""
    cost = lambda tables, bits: tables * (1 + n / 2**bits / tile) * (4 * d + 2 * tables + 40)
    most = int(np.clip(np.ceil(np.log2(max(n, 2))), 20, 30))  # substrings lengthen with the table, so that buckets do not grow
    shapes = [(1, 0)] + [(t, bits) for bits in range(4, most + 1) if (t := fewest_tables(errors, bits)) <= 1 << 14]
    return min(shapes, key=lambda s: cost(*s))


def index_of(x: np.ndarray, n: int, least: float, tile: int) -> tuple[ITQ, int, int]:
    """(model, tables, bits) for ``n`` vectors of which the unit vectors ``x`` are a sample."""
    d = x.shape[1]
    if n <= tile or len(x) < 2:
        return learn(x, 0), 1, 0
    model = learn(x, max(512, d))
    tables, bits = fitted_shape(n, d, bit_errors(model, x, least), tile)
    return (model if tables * bits <= model.basis.shape[1] else learn(x, tables * bits)), tables, bits


def _links(classes: DataFrame, d: int, least: float, tile: int, fit_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rep, links): the number of other vectors linked with each class; (a, b): links enough to span the components."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(fit_rows).select("v").collect()
    fitted, tables, bits = index_of(unit(r["v"] for r in sample), classes.count(), least, tile)
    model = spark.sparkContext.broadcast(fitted)
    powers = 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def substrings(vs: pd.Series) -> pd.Series:
        if not len(vs):
            return pd.Series([], dtype=object)
        codes = model.value.codes(unit(vs))[:, : tables * bits].reshape(len(vs), tables, bits)
        return pd.Series(list((codes @ powers).astype(np.int32)))

    coded = cut(classes.select("rep", "copies", "v", substrings("v").alias("code")).withColumn("whole", F.xxhash64("code")), "vector-codes")
    filed = coded.select("rep", "whole", F.posexplode("code").alias("t", "key"))
    counts = filed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("whole").alias("x"), F.max("whole").alias("y"))
    counts = counts.where((F.col("n") > 1) & ((F.col("t") == 0) | (F.col("x") != F.col("y")))).select("t", "key", "n")
    filed = filed.join(counts, ["t", "key"])
    # tiles of up to LARGE vectors where a bucket has many of them
    size = F.least(F.lit(LARGE), F.greatest(F.lit(tile), F.col("n") / 8))
    filed = filed.withColumn("tiles", F.ceil(F.col("n") / size).cast("int"))
    filed = filed.withColumn("tile", F.pmod(F.xxhash64("rep", "t"), F.col("tiles")).cast("int"))
    # each tile meets every tile of its bucket: as the left side in (i, j), as the right side in (j, i)
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least("tile", j).alias("i"), F.greatest("tile", j).alias("j")))
    dealt = filed.select("rep", "t", "key", "tile", F.explode(pairs).alias("p")).join(coded, "rep")
    dealt = dealt.select("t", "key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "tile", "rep", "copies", "v", F.slice("code", F.lit(1), F.col("t")).alias("earlier"))
    dealt = dealt.repartition(parts(spark), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_groups(batches, ["t", "key", "i", "j"]):
            yield compare_tiles(block, least)

    found = cut(dealt.mapInPandas(run, "a long, b long, links long"), "vector-links")
    links = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    return links, found.where("links = 0").select("a", "b")


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Blocks of sorted rows that end where a group ends."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[by].to_numpy()
        differ = np.flatnonzero((keys != keys[-1]).any(1))
        begun = differ[-1] + 1 if len(differ) else 0  # the last group begins here, or earlier
        if begun or (held and not (held[-1][by].iloc[-1].to_numpy() == keys[0]).all()):
            done = [*held, batch.iloc[:begun]]
            held = []
            yield pd.concat(done, ignore_index=True)
        held.append(batch.iloc[begun:])
    if held:
        yield pd.concat(held, ignore_index=True)


def compare_tiles(block: pd.DataFrame, least: float) -> pd.DataFrame:
    """For each pair of tiles (or one tile) in a block: the links that no earlier table finds, as a row (a, a, number)
    for each class with links and rows (a, b, 0) that span their components."""
    keys = block[["t", "key", "i", "j"]].to_numpy()
    edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(block)]
    all_x, rep, copies, tiles = unit(block["v"]), block["rep"].to_numpy(np.int64), block["copies"].to_numpy(np.int64), block["tile"].to_numpy()
    codes, out = block["earlier"].to_numpy(), []
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a < 2:
            continue
        t, _, i, j = keys[a]
        x = all_x[a:b]
        ok = x @ x.T >= least
        np.fill_diagonal(ok, False)
        if i != j:
            ok &= tiles[a:b, None] != tiles[None, a:b]
        if not ok.any():
            continue
        if t:
            one, two = np.nonzero(ok)
            code = np.stack(codes[a:b])
            ok[one, two] = (code[one] != code[two]).all(1)
        n = ok @ copies[a:b]
        some = np.flatnonzero(n)
        if not len(some):
            continue
        out.append(np.stack([rep[a:b][some], rep[a:b][some], n[some]], 1))
        ok, label = ok[np.ix_(some, some)], np.arange(len(some))
        while True:
            new = np.minimum(label, np.where(ok, label[None, :], len(some)).min(1))
            if (new == label).all():
                break
            label = new
        own = np.flatnonzero(label != np.arange(len(some)))
        out.append(np.stack([rep[a:b][some[own]], rep[a:b][some[label[own]]], np.zeros(len(own), np.int64)], 1))
    rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return pd.DataFrame(rows, columns=["a", "b", "links"])
