"""Line dedup with levelled sorted runs of line hashes, on DataFrame operations only.

A run is a table (key hash, number of documents) sorted by hash.  Batches of documents arrive one after the other:
the hashes of a batch are merge-anti-joined with the *settled* runs, which hold the keys whose fate is known (they are
in enough documents already, so that nothing more need be counted), and what is left becomes a new run of level 0.
When a level has ``fanout`` runs, they are merged into one run of the next level; keys that reach the threshold there
move to a settled run.  So each hash is rewritten as often as there are levels, the logarithm of the number of
batches.  At the end all runs are merged once, and the settled keys are those of common lines.

A key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends, with A-Z in lower case; keys are compared by 128
hash bits.  A key counts once for each document (row) that has it.

Runs can be kept: ``LineRuns.save`` names them in a folder, ``LineRuns.open`` goes on from there with later batches, and
``drop_lines`` applies what they hold to any documents.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` code points are never common;
a document whose lines all go has an empty text; equal rows are documents of their own; an empty table gives an
empty result; other columns pass through, but ``n_lines``, ``n_dropped`` and the text are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table, new_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(WHITE))


def hashes(key: Column) -> list[Column]:
    """128 bits: two chains of xxhash64 with different beginnings."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def keys_of(text: Column) -> Column:
    """The keys of a text's lines, in their order."""
    return F.transform(lines_of(F.translate(text, UPPER, LOWER)), lambda x: F.btrim(x, F.lit(WHITE)))


class LineRuns:
    """Levels of sorted runs (h1, h2, docs) in the shared folder, and settled runs (h1, h2)."""

    def __init__(self, spark, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: dict[int, list[DataFrame]] = defaultdict(list)
        self.settled: list[DataFrame] = []

    def _sorted(self, df: DataFrame, name: str) -> DataFrame:
        return cut(df.sortWithinPartitions(*HASH), name)

    def _unsettled(self, df: DataFrame) -> DataFrame:
        for run in self.settled:
            df = df.hint("merge").join(run.hint("merge"), HASH, "left_anti")
        return df

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("docs").alias("docs"))

    def add(self, batch: DataFrame) -> None:
        """Adds the counts (h1, h2, docs) of a batch of documents that no earlier batch had."""
        self.levels[0].append(self._sorted(self._unsettled(batch), "line-run"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        runs = self.levels.pop(level)
        merged = cut(self._merge(runs).withColumn("full", F.col("docs") >= self.min_docs), "line-merge")
        self.settled.append(self._sorted(merged.where("full").select(*HASH), "line-settled"))
        self.levels[level + 1].append(self._sorted(merged.where("not full").drop("full"), "line-run"))
        for run in [*runs, merged]:
            drop_table(run, self.spark)

    def add_documents(self, docs: DataFrame, min_chars: int = 1, text_col: str = "text") -> None:
        """Adds the lines of a batch of documents that no earlier batch had."""
        key = F.explode(F.array_distinct(keys_of(F.coalesce(F.col(text_col), F.lit(""))))).alias("key")
        self.add(docs.select(key).where(long_enough(min_chars)).select(*hashes(F.col("key"))).groupBy(*HASH).agg(F.count("*").alias("docs")))

    def common(self) -> DataFrame:
        """(h1, h2) of the keys in at least ``min_docs`` documents, each once, in a table."""
        runs = [r for rs in self.levels.values() for r in rs]
        last = [self._merge(runs).where(F.col("docs") >= self.min_docs).select(*HASH)] if runs else []
        found = [*self.settled, *last] or [self.spark.createDataFrame([], "h1 long, h2 long")]
        return cut(reduce(DataFrame.unionByName, found), "line-common")

    def save(self, path: str) -> None:
        """Writes the runs under ``path``, a new folder that all executors share."""
        kept = [(level, i, run) for level, runs in [*self.levels.items(), (-1, self.settled)] for i, run in enumerate(runs)]
        for level, i, run in kept:
            run.write.parquet(f"{path}/run-{level}-{i}")
        names = [(level, f"run-{level}-{i}") for level, i, _ in kept]
        self.spark.createDataFrame([(self.min_docs, self.fanout, names)], "min_docs int, fanout int, runs array<struct<level int, name string>>").coalesce(1).write.json(f"{path}/runs")

    @classmethod
    def open(cls, spark, path: str) -> LineRuns:
        """The runs that were saved under ``path``; their files stay as they are when runs are merged."""
        said = spark.read.schema("min_docs int, fanout int, runs array<struct<level int, name string>>").json(f"{path}/runs").collect()[0]
        out = cls(spark, said["min_docs"], said["fanout"])
        for level, name in said["runs"] or []:
            run = spark.read.schema("h1 long, h2 long" + (", docs long" if level >= 0 else "")).parquet(f"{path}/{name}")
            (out.levels[level] if level >= 0 else out.settled).append(run)
        return out

    def drop(self) -> None:
        """Deletes the runs; saved ones stay."""
        for run in [r for rs in self.levels.values() for r in rs] + self.settled:
            drop_table(run, self.spark)
        self.levels, self.settled = defaultdict(list), []


def long_enough(min_chars: int) -> Column:
    return F.col("key") != "" if min_chars <= 1 else F.char_length("key") >= min_chars


def digest(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_d")]


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 8, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines whose keys are in at least ``min_docs`` documents, with ``n_lines`` and ``n_dropped``.

    One pass over the texts writes the batches' counts, summed before the shuffle; a second one drops the lines.
    """
    spark = docs.sparkSession
    # the digest is taken before the lines are laid out, once a document
    each = docs.select(*digest(id_col, text_col), F.array_distinct(keys_of(F.coalesce(F.col(text_col), F.lit("")))).alias("_keys"))
    keyed = each.select("_id", "_d", F.explode("_keys").alias("key")).where(long_enough(min_chars))
    batch = F.pmod(F.xxhash64("_id", "_d"), F.lit(batches)).cast("int").alias("batch")
    counted = keyed.select(batch, *hashes(F.col("key"))).groupBy("batch", *HASH).agg(F.count("*").alias("docs"))
    path = new_table(spark, "line-batches")
    counted.write.partitionBy("batch").parquet(path)
    all_batches = spark.read.schema("h1 long, h2 long, docs long, batch int").parquet(path)

    runs = LineRuns(spark, min_docs, fanout)
    for k in range(batches):
        runs.add(all_batches.where(F.col("batch") == k).select(*HASH, "docs"))
    common = runs.common()
    runs.drop()
    drop_table(path, spark)
    return drop_lines(docs, common, min_chars, id_col, text_col)


def drop_lines(docs: DataFrame, common: DataFrame, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines whose keys are in ``common`` (h1, h2), with ``n_lines`` and ``n_dropped``.

    Only the places of a document's common lines are shuffled, and go back to it joined by its id and digest.  The kept
    lines are the stretches between them: the work on a document grows with its lines, not with lines times hits.
    """
    text = F.col(text_col)
    each = docs.select(*digest(id_col, text_col), keys_of(F.coalesce(text, F.lit(""))).alias("_keys"))
    keyed = each.select("_id", "_d", F.posexplode("_keys").alias("at", "key")).where(long_enough(min_chars))
    hits = keyed.select("_id", "_d", "at", *hashes(F.col("key"))).join(common, HASH, "left_semi")
    hits = hits.groupBy("_id", "_d").agg(F.sort_array(F.collect_set("at")).alias("_hits"))
    at = docs.withColumns({"_id": F.col(id_col), "_d": digest(id_col, text_col)[1]})
    found = at.join(hits, at["_id"].eqNullSafe(hits["_id"]) & (at["_d"] == hits["_d"]), "left").drop(hits["_id"]).drop(hits["_d"])
    lines = lines_of(text)
    between = F.zip_with(F.concat(F.array(F.lit(-1)), F.col("_hits")), F.concat(F.col("_hits"), F.array(F.size("_lines"))), lambda a, z: F.slice("_lines", a + 2, z - a - 1))
    found = found.withColumn("_lines", lines)
    found = found.withColumn("_kept", F.when(F.col("_hits").isNull(), F.col("_lines")).otherwise(F.flatten(between)))
    found = found.withColumn("n_lines", F.size("_lines").cast("long"))
    found = found.withColumn("n_dropped", F.col("n_lines") - F.size("_kept"))
    return found.withColumn(text_col, F.array_join("_kept", "\n")).drop("_id", "_d", "_hits", "_kept", "_lines")
