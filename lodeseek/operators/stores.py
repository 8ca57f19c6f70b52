"""Vector stores: written once as Parquet, opened again, searched by a stated set of queries.

A store holds (item_id, business_line, v).  ``exact`` filters by business line before ranking, ``flat`` ranks first and
filters what it fetched beyond need, ``cells`` looks into the nearest cells only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import top_k
from .search import over_fetch

#: Queries that one pass over the vectors answers; more of them take more passes.
BLOCK = 4096
HITS = "query_id long, item_id long, score double"


def _best(q: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of each query, ties to the smaller item."""
    order = np.lexsort((item, -score, q))
    begun = np.concatenate([[True], q[order][1:] != q[order][:-1]])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(begun, np.arange(len(order)), 0))
    return order[rank < k]


def _block_hits(queries: list, items: DataFrame, k: int, same: bool) -> DataFrame:
    """The best ``k`` items of each of a bounded list of queries in each task: a matrix product a batch."""
    ids = np.array([r["query_id"] for r in queries], np.int64)
    lines = [r["business_line"] for r in queries] if same else []
    x = np.array([r["qv"] for r in queries], np.float64)
    shared = items.sparkSession.sparkContext.broadcast((ids, lines, x))  # at most BLOCK queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lines, x = shared.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            score = np.floor(x @ v.T * 1e6 + 0.5) / 1e6
            if lines:
                named = batch["business_line"].to_pylist()
                score[np.array([[a != b or b is None for a in named] for b in lines])] = -np.inf
            floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(x), -np.inf)
            row, col = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
            held = (np.concatenate([held[0], ids[row]]), np.concatenate([held[1], batch["item_id"].to_numpy()[col]]), np.concatenate([held[2], score[row, col]]))
            some = _best(*held, k)
            held = tuple(a[some] for a in held)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in held], ["query_id", "item_id", "score"])

    return items.select("item_id", "v", *(["business_line"] if same else [])).mapInArrow(run, HITS)


def matrix_hits(queries: DataFrame, items: DataFrame, k: int, same: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank): the best ``k`` items (item_id, v) by inner product of each of queries (query_id,
    qv), exactly; with ``same`` only items of the query's business line.  Scores are rounded at six places.

    Items are read once for every BLOCK queries and never shuffled; queries of another length than most find nothing.
    """
    n = queries.count()
    out = None
    for b in range(-(-n // BLOCK)):
        some = queries if n <= BLOCK else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK))) == b)
        asked = some.where("qv is not null").select("query_id", "qv", *(["business_line"] if same else [])).collect()  # about BLOCK
        if asked:
            d = len(asked[0]["qv"])
            hits = _block_hits([r for r in asked if len(r["qv"]) == d], items.where(F.size("v") == d), k, same)
            out = hits if out is None else out.unionByName(hits)
    return top_k(out if out is not None else items.sparkSession.createDataFrame([], HITS), k)


@dataclass(frozen=True)
class Capabilities:
    metadata_filtering: bool
    persistence: bool
    exact: bool


class ExactStore:
    """Vectors partitioned by business line; a filter reads its partition only."""

    capabilities = Capabilities(metadata_filtering=True, persistence=True, exact=True)

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, items: DataFrame) -> float:
        """Writes the store anew; the seconds it took."""
        began = time.time()
        items.select("item_id", "v", F.col("business_line").alias("line"), "business_line").write.mode("overwrite").partitionBy("line").parquet(f"{self.path}/vectors")
        return time.time() - began

    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, filtered: bool = False) -> DataFrame:
        """(query_id, item_id, score, rank) of queries (query_id, qv and, to filter, business_line)."""
        items = self.items()
        if filtered:
            lines = [r[0] for r in queries.select("business_line").distinct().collect()]  # a handful
            items = items.where(F.col("line").isin(lines))
        return matrix_hits(queries, items, k, filtered)


class FlatStore(ExactStore):
    """Without a filter of its own: it fetches twelve times as many and filters those, which may leave fewer than k."""

    capabilities = Capabilities(metadata_filtering=False, persistence=True, exact=True)

    def search(self, queries: DataFrame, k: int, filtered: bool = False) -> DataFrame:
        if not filtered:
            return matrix_hits(queries, self.items(), k)
        wide = matrix_hits(queries.select("query_id", "qv"), self.items(), 12 * k)
        wide = wide.join(self.items().select("item_id", "business_line"), "item_id").join(F.broadcast(queries.select("query_id", F.col("business_line").alias("wanted"))), "query_id")
        return over_fetch(wide, F.col("business_line") == F.col("wanted"), k).select("query_id", "item_id", "score", "rank")


class CellStore(ExactStore):
    """Vectors by the nearest of some centres, learned on a bounded sample; a query looks into its nearest cells."""

    capabilities = Capabilities(metadata_filtering=True, persistence=True, exact=False)

    def __init__(self, spark: SparkSession, path: str, cells: int = 64, probes: int = 8, fit_rows: int = 20_000):
        super().__init__(spark, path)
        self.cells, self.probes, self.fit_rows = cells, probes, fit_rows

    def build(self, items: DataFrame) -> float:
        began = time.time()
        sample = np.array([r["v"] for r in items.orderBy(F.xxhash64("item_id"), "item_id").limit(self.fit_rows).select("v").collect()], np.float64)
        centres = sample[: self.cells].copy()
        for _ in range(10 if len(sample) else 0):
            own = (sample @ centres.T).argmax(1)
            for c in range(len(centres)):
                if (own == c).any():
                    mean = sample[own == c].mean(0)
                    centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        nearest = self._nearest(centres, 1)
        placed = items.select("item_id", "v", "business_line", F.get(nearest("v"), F.lit(0)).alias("cell"))
        placed.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors")
        return time.time() - began

    @staticmethod
    def _nearest(centres: np.ndarray, n: int):
        @F.arrow_udf("array<int>")
        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vs in batches:
                x = np.array(vs.to_pylist(), np.float64).reshape(len(vs), -1)
                yield pa.array(list(np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)) if len(vs) else [], pa.list_(pa.int32()))

        return nearest

    def search(self, queries: DataFrame, k: int, filtered: bool = False) -> DataFrame:
        rows = sorted(self.spark.read.parquet(f"{self.path}/centres").collect(), key=lambda r: r["cell"])  # ``cells`` rows
        if not rows:
            return matrix_hits(queries, self.items(), k, filtered)
        nearest = self._nearest(np.array([r["centre"] for r in rows]), self.probes)
        asked = queries.withColumn("cell", F.explode(nearest("qv")))
        same = ["cell", "business_line"] if filtered else ["cell"]
        met = self.items().join(asked.select("query_id", "qv", *same), same)
        score = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
        return top_k(met.select("query_id", "item_id", (F.floor(score * 1e6 + 0.5) / 1e6).alias("score")), k)


STORES: dict[str, Callable[..., ExactStore]] = {"exact": ExactStore, "flat": FlatStore, "cells": CellStore}


def get_store(name: str, spark: SparkSession, path: str, **options) -> ExactStore:
    if name not in STORES:
        raise ValueError(f"unknown store {name!r}; known: {sorted(STORES)}")
    return STORES[name](spark, path, **options)
