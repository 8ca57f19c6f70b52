"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, greedy search walks it.

Building: each vector starts with its best neighbours in a few small cells (random hyperplanes cut the space, hashes
cut full cells).  Then, in each round, Spark joins the neighbours of each vector, forward and backward, with their
vectors; all pairs among them of which one is new are compared, and each vector keeps its best ``degree`` ones.  A
round samples a bounded number of neighbours in each direction, so that it costs the same a vector at any size; rounds
follow until one replaces at most a share ``delta`` of all neighbours, as many as the table needs.

Search: a node's row holds its neighbours with their vectors.  Each query keeps a beam of the best nodes seen (beam_of,
it grows with the table), begun with its own neighbours, if it is in the index, and with fixed entry nodes; in each
round the best nodes that were not expanded yet are joined with their rows and their neighbours scored.  Nodes that
many queries ask for at once are broadcast, as are vectors that are members of many neighbourhoods while the graph is
built: fewer than HOT of them, by the number of requests, so that no task gets all requests for one node.  It ends when no beam holds a node that was not expanded.  The best of each beam are scored
on the original vectors in double precision.  The node rows are persisted on the executors; what is lost with one of
them is read again from its written table.

Vectors are compared in single precision, each scaled by its largest component, and the product is scaled back in
double precision: vectors of very different length do not lose their digits.  Equal vectors are one node, which holds
the ``k + 1`` smallest ids of the rows that have it; no other row of theirs can be among the ``k`` nearest.  A query
stands for all rows of its node.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor those of
another length than most (of equally frequent lengths the smaller is taken); a query is never its own candidate; ties
go to the smaller id; null ids take no part, and of rows of equal id the one whose vector's hash is smallest does; with
fewer candidates than asked for, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_table, parts, release_shuffles
from .vecdedup import good_vectors, whole_groups

CELL = 2048
#: Nodes whose requests are more than 1 / HOT of all, and more than FEW, are answered by broadcast: fewer than HOT.
HOT, FEW = 1024, 4096
FOUND = "id long, other long, s double"


def packed(df: DataFrame) -> DataFrame:
    """df with ``h`` and ``w``: each vector in single precision as bytes, scaled by its largest component, and that."""

    @F.pandas_udf("h binary, w double")
    def scaled(vs: pd.Series) -> pd.DataFrame:
        out = []
        for v in vs:
            x = np.asarray(v, np.float64)
            top = np.abs(x).max()
            out.append(((x / top).astype(np.float32).tobytes(), top))
        return pd.DataFrame(out, columns=["h", "w"])

    return df.withColumn("_s", scaled("v")).withColumns({"h": F.col("_s.h"), "w": F.col("_s.w")}).drop("_s")


def distinct_vectors(df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, v, ids) of every different vector of the usual length, named by its smallest id, with its k + 1 smallest
    ids; (row, id): the rows and their vectors' names."""
    sizes = df.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    usual = df.where(F.size("v") == (sizes[0]["d"] if sizes else 0))
    keyed = usual.select("id", F.struct(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("vector"), F.col("v")).alias("h2"), "v").alias("x"))
    keyed = cut(keyed.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.*"), "ann-rows")
    first = Window.partitionBy("h1", "h2").orderBy("id")
    some = keyed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    nodes = some.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.min_by("v", "id").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = cut(packed(nodes.select("h1", "h2", F.col("node").alias("id"), "v", "ids")), "ann-vectors")
    rows = keyed.select("h1", "h2", F.col("id").alias("row")).join(nodes.select("h1", "h2", "id"), ["h1", "h2"]).select("row", "id")
    return nodes.drop("h1", "h2"), rows


def matrix(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)


def joined(block: pd.DataFrame, by: list[str], keep: int) -> pd.DataFrame:
    """All pairs within the groups of a block, of which one is new: for each row its best ``keep`` that beat its floor;
    of an id in many groups, the best ``keep`` of the block."""
    keys = block[by].to_numpy()
    edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(block)]
    x, ids, new, floor = matrix(list(block["h"])), block["id"].to_numpy(np.int64), block["fresh"].to_numpy(bool), block["floor"].to_numpy(np.float64)
    weight = block["w"].to_numpy(np.float64)
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a < 2:
            continue
        s = (x[a:b] @ x[a:b].T) * weight[a:b, None] * weight[None, a:b]
        np.fill_diagonal(s, -np.inf)
        s[~(new[a:b, None] | new[None, a:b])] = -np.inf
        if b - a > keep:
            best = np.argpartition(-s, keep, axis=1)[:, :keep]
        else:
            best = np.tile(np.arange(b - a), (b - a, 1))
        score = np.take_along_axis(s, best, 1)
        row, col = np.nonzero(score > floor[a:b, None])
        out.append((ids[a:b][row], ids[a:b][best[row, col]], score[row, col]))
    if not any(len(one) for one, _, _ in out):
        return pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "s": np.zeros(0)})
    one, other, s = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((other, one))
    order = order[np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (other[order][1:] != other[order][:-1])])]
    order = order[np.lexsort((-s[order], one[order]))]
    begun = np.concatenate([[True], one[order][1:] != one[order][:-1]])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(begun, np.arange(len(order)), 0))
    order = order[rank < keep]
    return pd.DataFrame({"id": one[order], "other": other[order], "s": s[order]})


def local_join(df: DataFrame, by: list[str], keep: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in whole_groups(batches, by):
            yield joined(block, by, keep)

    dealt = df.repartition(parts(df.sparkSession), *by).sortWithinPartitions(*by)
    return dealt.mapInPandas(run, FOUND)


def hot_nodes(front: DataFrame, total: int) -> list[int]:
    """The nodes with more than 1 / HOT of the ``total`` rows of front (node, ...), or of more: fewer than HOT."""
    most = max(FEW, total // HOT)
    return [r["node"] for r in front.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()] if total > most else []


def answered(front: DataFrame, rows: DataFrame, total: int, hint: str | None = None) -> DataFrame:
    """front (node, ...) joined with rows (node, ...); those of hot nodes are broadcast, so that no task gets all
    requests for one node."""
    hot = hot_nodes(front, total)
    join = lambda x, y: (x.hint(hint) if hint else x).join(y, "node")
    if not hot:
        return join(front, rows)
    asked = F.col("node").isin(hot)
    return join(front.where(~asked), rows).unionByName(front.where(asked).join(F.broadcast(rows.where(asked)), "node"))


def best_of(found: DataFrame, degree: int) -> DataFrame:
    """(id, nb, replaced): for each id its best ``degree`` others, each once, best first; an entry stays old if it was;
    the number of entries that were not there before."""
    once = found.repartition(parts(found.sparkSession), "id").groupBy("id", "other").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"), F.min("new").alias("new"))
    order = Window.partitionBy("id").orderBy(F.desc("s"), "other")
    top = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= degree)
    nb = F.transform(F.array_sort(F.collect_list(F.struct("r", "other", "s", "fresh"))), lambda x: F.struct(x["other"].alias("other"), x["s"].alias("s"), x["fresh"].alias("fresh")))
    return top.groupBy("id").agg(nb.alias("nb"), F.sum(F.col("new").cast("int")).alias("replaced"))


def settling(graph: DataFrame, delta: float) -> bool:
    """Whether the last round replaced more than a share ``delta`` of the neighbours.  Each replacement is by a nearer
    one, so this ends."""
    last = graph.agg(F.sum("replaced").alias("replaced"), F.sum(F.size("nb")).alias("all")).collect()[0]
    return (last["replaced"] or 0) > delta * (last["all"] or 0)


def build(vectors: DataFrame, degree: int = 32, sample: int = 12, cells: int = 8, delta: float = 0.005) -> DataFrame:
    """(id, nb) of every vector (id, h, w)."""
    spark = vectors.sparkSession
    n = vectors.count()
    bits = int(max(0, np.round(np.log2(max(n, 1) / CELL))))

    @F.pandas_udf("array<int>")
    def cell_codes(hs: pd.Series) -> pd.Series:
        if not len(hs):
            return pd.Series([], dtype=object)
        x, rng = matrix(list(hs)), np.random.default_rng(7)
        codes = [np.zeros(len(x), np.int64)]  # the first cutting is by hashes alone
        for _ in range(1, cells):
            planes = rng.normal(size=(x.shape[1], bits))
            codes.append(((x @ planes) > 0) @ (1 << np.arange(bits)))
        return pd.Series(list(np.stack(codes, 1).astype(np.int32)))

    coded = vectors.select("id", "h", "w", F.posexplode(cell_codes("h")).alias("t", "code"))
    sizes = coded.groupBy("t", "code").agg(F.ceil(F.count("*") / CELL).cast("int").alias("pieces"))
    coded = coded.join(sizes, ["t", "code"]).withColumn("piece", F.pmod(F.xxhash64("id", "t"), F.col("pieces")).cast("int"))
    coded = coded.withColumns({"fresh": F.lit(True), "floor": F.lit(float("-inf"))})
    started = local_join(coded.select("t", "code", "piece", "id", "h", "w", "fresh", "floor"), ["t", "code", "piece"], degree)
    graph = cut(best_of(started.withColumns({"fresh": F.lit(True), "new": F.lit(True)}), degree), "ann-graph")
    while settling(graph, delta):
        some = F.slice(F.filter("nb", lambda x: x["fresh"]), 1, sample)
        rest = F.slice(F.filter("nb", lambda x: ~x["fresh"]), 1, sample)
        picked = graph.select(F.col("id").alias("c"), F.explode(F.concat(some, rest)).alias("e")).select("c", F.col("e.other").alias("m"), F.col("e.fresh").alias("fresh"))
        order = Window.partitionBy("c", "fresh").orderBy(F.xxhash64("c", "m"), "m")
        back = picked.select(F.col("m").alias("c"), F.col("c").alias("m"), "fresh").withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).drop("r")
        members = picked.union(back).groupBy("c", "m").agg(F.max("fresh").alias("fresh"))
        floors = graph.select("id", F.when(F.size("nb") >= degree, F.element_at("nb", -1)["s"]).otherwise(F.lit(float("-inf"))).alias("floor"))
        known = vectors.select(F.col("id").alias("node"), "h", "w").join(floors.withColumnRenamed("id", "node"), "node", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        # a node has at most 4 * sample members, but may itself be a member of all others
        with_vectors = answered(members.withColumnRenamed("m", "node"), known, 4 * sample * n if n > 25 * FEW else 0)
        with_vectors = with_vectors.select("c", F.col("node").alias("id"), "h", "w", "fresh", "floor")
        found = local_join(with_vectors, ["c"], degree).withColumns({"fresh": F.lit(True), "new": F.lit(True)})
        # those that were compared now are old from here on
        aged = graph.select("id", F.explode("nb").alias("e")).select("id", "e.other", "e.s", "e.fresh")
        seen = picked.where("fresh").select(F.col("c").alias("id"), F.col("m").alias("other"), F.lit(False).alias("used"))
        aged = aged.join(seen, ["id", "other"], "left").select("id", "other", "s", (F.col("fresh") & F.coalesce("used", F.lit(True))).alias("fresh"), F.lit(False).alias("new"))
        before, graph = graph, cut(best_of(aged.unionByName(found), degree), "ann-graph")
        drop_table(before, spark)
        release_shuffles(spark)
    return graph


def node_rows(graph: DataFrame, vectors: DataFrame, forward: int, backward: int) -> DataFrame:
    """(node, others, ws, hs): the neighbours of each node, its own and some of those that have it, with their vectors
    in a row: at most forward + backward."""
    out = graph.select(F.col("id").alias("node"), F.explode(F.slice("nb", 1, forward)).alias("e")).select("node", F.col("e.other").alias("other"), F.col("e.s").alias("s"))
    order = Window.partitionBy("node").orderBy(F.desc("s"), "other")
    back = out.select(F.col("other").alias("node"), F.col("node").alias("other"), "s").withColumn("r", F.row_number().over(order)).where(F.col("r") <= backward).drop("r")
    both = out.union(back).select("node", "other").distinct()
    full = both.join(vectors.select(F.col("id").alias("other"), "h", "w"), "other")
    full = full.groupBy("node").agg(F.collect_list(F.struct("other", "h", "w")).alias("es"))
    in_a_row = F.aggregate("es.h", F.lit(b""), lambda row, h: F.concat(row, h))
    return full.select("node", F.col("es.other").alias("others"), F.col("es.w").alias("ws"), in_a_row.alias("hs"))


def beam_of(n: int) -> int:
    """Nodes in a beam: 160 up to 10,000 vectors, from there on it grows with the cube root of their number."""
    return max(160, int(np.ceil(160 * (n / 10_000) ** (1 / 3))))


def search(vectors: DataFrame, graph: DataFrame, queries: DataFrame, beam: int | None = None, entries: int = 64, forward: int = 24, backward: int = 16) -> DataFrame:
    """(q, ids): the nodes of the beam of each of queries (id, h, w), nearest first."""
    spark = vectors.sparkSession
    beam = beam or beam_of(vectors.count())
    width = max(16, beam // 10)
    rows = cut(node_rows(graph, vectors, forward, backward), "ann-nodes").repartition(parts(spark), "node").persist()
    fixed = vectors.select("id", "h", "w").orderBy(F.xxhash64("id"), "id").limit(entries).collect()
    entry_ids = np.array([r["id"] for r in fixed], np.int64)
    entry_x, entry_w = matrix([bytes(r["h"]) for r in fixed]) if fixed else None, np.array([r["w"] for r in fixed])

    def merged(q: int, ids: np.ndarray, s: np.ndarray, done: np.ndarray) -> tuple:
        """The best of a beam, each node once (an expanded copy wins), and whether any waits."""
        order = np.lexsort((~done, ids))
        ids, s, done = ids[order], s[order], done[order]
        one = np.concatenate([[True], ids[1:] != ids[:-1]]) & (ids != q)
        ids, s, done = ids[one], s[one], done[one]
        order = np.lexsort((ids, -s))[:beam]
        ids, s, done = ids[order], s[order], done[order]
        go = np.flatnonzero(~done)[:width]
        done = done.copy()
        done[go] = True
        return ids.tolist(), s.tolist(), done.tolist(), ids[go].tolist()

    state = "q long, h binary, w double, ids array<long>, s array<double>, done array<boolean>, go array<long>"

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, h, w, ids, s in zip(b["q"], b["h"], b["w"], b["ids"], b["s"], strict=True):
                more = (entry_x @ matrix([h])[0]) * entry_w * w
                ids = np.concatenate([np.asarray(ids if ids is not None else [], np.int64), entry_ids])
                s = np.concatenate([np.asarray(s if s is not None else [], np.float64), more])
                out.append((q, h, w, *merged(q, ids, s, np.zeros(len(ids), bool))))
            yield pd.DataFrame(out, columns=["q", "h", "w", "ids", "s", "done", "go"])

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, h, w, floor, others, ws, hs in zip(b["q"], b["h"], b["w"], b["floor"], b["others"], b["ws"], b["hs"], strict=True):
                s = (np.frombuffer(hs, np.float32).reshape(len(others), -1) @ matrix([h])[0]) * ws * w
                ok = s > floor
                if ok.any():
                    out.append((q, others[ok], s[ok]))
            yield pd.DataFrame(out, columns=["q", "ids", "s"])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, h, w, ids, s, done, new_ids, new_s in zip(b["q"], b["h"], b["w"], b["ids"], b["s"], b["done"], b["new_ids"], b["new_s"], strict=True):
                more = np.concatenate([np.asarray(x, np.int64) for x in new_ids]) if new_ids is not None and len(new_ids) else np.zeros(0, np.int64)
                more_s = np.concatenate([np.asarray(x, np.float64) for x in new_s]) if new_s is not None and len(new_s) else np.zeros(0)
                all_done = np.concatenate([np.asarray(done, bool), np.zeros(len(more), bool)])
                out.append((q, h, w, *merged(q, np.concatenate([np.asarray(ids, np.int64), more]), np.concatenate([np.asarray(s, np.float64), more_s]), all_done)))
            yield pd.DataFrame(out, columns=["q", "h", "w", "ids", "s", "done", "go"])

    own = graph.select(F.col("id").alias("q"), F.col("nb.other").alias("ids"), F.col("nb.s").alias("s"))
    begun = queries.select(F.col("id").alias("q"), "h", "w").join(own, "q", "left")
    now = cut(begun.mapInPandas(begin, state), "ann-beams") if fixed else cut(spark.createDataFrame([], state), "ann-beams")
    while total := now.agg(F.sum(F.size("go"))).collect()[0][0]:  # a node that left a beam is below its floor and cannot return, so this ends
        floor = F.when(F.size("ids") >= beam, F.element_at("s", -1)).otherwise(F.lit(float("-inf")))
        front = now.select("q", "h", "w", floor.alias("floor"), F.explode("go").alias("node"))
        asked = answered(front, rows, total, "shuffle_hash").select("q", "h", "w", "floor", "others", "ws", "hs")
        scored = asked.mapInPandas(expand, "q long, ids array<long>, s array<double>")
        new = scored.groupBy("q").agg(F.collect_list("ids").alias("new_ids"), F.collect_list("s").alias("new_s"))  # at most width rows
        before, now = now, cut(now.drop("go").join(new, "q", "left").mapInPandas(step, state), "ann-beams")
        drop_table(before, spark)
    rows.unpersist()
    return now.select("q", "ids")


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)


def exact(pairs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(q, best): for the vector q of each of pairs (q, id), the best k + 1 rows (score, id) of the vectors paired."""
    full = pairs.join(vectors.select("id", "v", "ids"), "id").join(vectors.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
    scored = full.select("q", inner_product(F.col("qv"), F.col("v")).alias("score"), F.explode("ids").alias("id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("best"))


def nearest(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score): builds the graph over all vectors and searches it for those rows whose id is
    divisible by ``every``."""
    bounded_batches(df.sparkSession)
    spark = df.sparkSession
    vectors, rows = distinct_vectors(good_vectors(df, id_col, vec_col), k)
    graph = build(vectors)
    asked = cut(rows.where(F.pmod(F.col("row"), F.lit(every)) == 0).select(F.col("row").alias("query_id"), F.col("id").alias("q")), "ann-queries")
    beams = search(vectors, graph, vectors.join(asked.select(F.col("q").alias("id")).distinct(), "id", "left_semi"), **options)
    # a vector's other rows are candidates as well
    pairs = beams.select("q", F.explode(F.array_append(F.slice("ids", 1, 4 * k), F.col("q"))).alias("id"))
    best = cut(exact(pairs, vectors, k), "ann-best")
    drop_table(graph, spark)
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    found = asked.join(best, "q").select("query_id", F.posexplode(others).alias("at", "e"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))
