"""Connected components by contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table, release_shuffles


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    In each round a node joins the neighbour that comes first in an order drawn anew by hashing (or stays), and the
    graph is contracted: paths and stars alike shrink by a constant factor, so that the rounds are logarithmic in the
    nodes.  No node's edges are ever gathered; sums are partial before each shuffle.
    """
    spark = edges.sparkSession
    live = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    maps, round_, old = [], 0, []
    while not live.isEmpty():
        round_ += 1
        both = live.union(live.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.lit(round_), c), c)
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(order(F.col("b"))).alias("m"))
        to = cut(best.select("node", F.when(F.col("m") < order(F.col("node")), F.col("m.b")).otherwise(F.col("node")).alias("into")), "contract")
        maps.append(to)
        from_a = to.select(F.col("node").alias("a"), F.col("into").alias("a2"))
        from_b = to.select(F.col("node").alias("b"), F.col("into").alias("b2"))
        joined = live.join(from_a, "a").join(from_b, "b").where("a2 <> b2")
        old.append(live)
        live = cut(joined.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        release_shuffles(spark)
    old.append(live)
    label = None
    for to in reversed(maps):
        if label is None:
            label = to.select("node", F.col("into").alias("root"))
        else:
            after = label.select(F.col("node").alias("into"), "root")
            label = to.join(after, "into", "left").select("node", F.coalesce("root", "into").alias("root"))
    if label is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = cut(label, "roots")
    names = label.groupBy("root").agg(F.min("node").alias("component"))
    out = cut(label.join(names, "root").select("node", "component"), "components")
    for t in [*maps, *old, label]:
        drop_table(t, spark)
    return out
