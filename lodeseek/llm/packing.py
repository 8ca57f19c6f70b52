"""Best-fit packing of tokenised documents into sequences of fixed length.

Best-fit decreasing depends on the lengths alone, and pieces of one length are interchangeable.  So the packing is
computed over the histogram of lengths (at most ``capacity`` entries, however large the corpus): a segment tree over
the remaining capacities finds the tightest one with an open bin in logarithmic time, and a run of equal pieces goes
into a run of equal bins at once.  The outcome is a table of placement rules whose size is bounded by the capacity.
Each piece then finds its own place from its length and its rank among the pieces of that length.

Defined cases: a null or empty text is a document of one id, the end id; equal rows are documents of their own; an
empty table gives an empty result; pieces of equal length are ranked by (bucket of their key, doc_id, text digest,
piece), and a null doc_id is kept as null.  Columns other than ``id_col`` and ``text_col`` are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, parts, released
from .word_cache import cached_encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, twin long"


class OpenBins:
    """Runs of bins by remaining capacity, below a segment tree that knows which capacities have any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = np.zeros(2 * self.size, bool)
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(self.size)]

    def _mark(self, remaining: int) -> None:
        node = remaining + self.size
        self.some[node] = bool(self.runs[remaining])
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def push(self, remaining: int, first: int, n: int) -> None:
        if remaining and n:
            self.runs[remaining].append((first, n))
            self._mark(remaining)

    def pop(self, remaining: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of a run with that remaining capacity."""
        first, n = self.runs[remaining].popleft()
        if n > most:
            self.runs[remaining].appendleft((first + most, n - most))
            n = most
        self._mark(remaining)
        return first, n

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` with an open bin: up, then down the tree."""
        node = length + self.size
        if self.some[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit_rules(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Placement rules (length, first item, items, items a bin, first bin, offset in the bin) of best-fit decreasing.

    Each bin of a run takes as many equal pieces as fit before the next one is touched, as the bin just used is the
    tightest while it still has room.
    """
    bins, opened, rules = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        item, left = 0, histogram[length]
        while left:
            remaining = bins.tightest(length)
            a_bin = (remaining or capacity) // length
            if remaining is None:
                remaining, first, n = capacity, opened, -(-left // a_bin)
                opened += n
            else:
                first, n = bins.pop(remaining, -(-left // a_bin))
            items = min(left, n * a_bin)
            rules.append((length, item, items, a_bin, first, capacity - remaining))
            full, over = divmod(items, a_bin)
            bins.push(remaining - a_bin * length, first, full)
            if over:
                bins.push(remaining - over * length, first + full, 1)
            item += items
            left -= items
    return np.array(rules, np.int64).reshape(-1, 6)


def place(rules: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sequence_id and offset of pieces by (length, rank among the pieces of that length)."""
    order = np.lexsort((rules[:, 1], rules[:, 0]))
    rules = rules[order]
    wide = int(max(rules[:, 1].max(), rank.max())) + 1
    rule = rules[np.searchsorted(rules[:, 0] * wide + rules[:, 1], length * wide + rank, side="right") - 1]
    nth = rank - rule[:, 1]
    return rule[:, 4] + nth // rule[:, 3], rule[:, 5] + nth % rule[:, 3] * length


def cut_into_pieces(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of those lengths: all of ``capacity`` ids but the
    first, which may be shorter."""
    n = -(-length // capacity)
    doc = np.repeat(np.arange(len(length)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    end = length[doc] - (n[doc] - 1 - piece) * capacity
    start = np.maximum(end - capacity, 0)
    return doc, piece, start, end - start


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of all documents, with the checksums of their ids and of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached_encoder(tokenizer)
        for batch in released(batches):
            for at, ids, ends, data, data_ends in encoder.blocks(batch["text"]):
                ids, ends = with_end(ids, ends, end_id)
                doc, piece, start, length = cut_into_pieces(np.diff(ends), capacity)
                raw, text = memoryview(ids).cast("B"), memoryview(np.ascontiguousarray(data))
                first = ends[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(first.tolist(), (first + length).tolist(), strict=True)]
                twin = np.array([zlib.crc32(text[a:z]) for a, z in zip(data_ends.tolist(), data_ends[1:].tolist(), strict=False)], np.int64)
                columns = [batch["doc_id"].take(pa.array(at + doc)), piece.astype(np.int32), start, length, np.array(crc, np.int64), twin[doc]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "piece", "start", "length", "ids_crc32", "twin"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    The pieces are written once.  Ranks within a length come from counts by (length, bucket), so that no task ever
    holds a whole length: a length that a third of all pieces share is spread over as many buckets as there are
    shuffle partitions.
    """
    spark = docs.sparkSession
    pieces = cut(tokenised_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "twin", "piece"), F.lit(parts(spark))).cast("int"))
    counts = cut(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    rules = best_fit_rules(histogram, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "twin", "piece")
    ranked = pieces.withColumn("nth", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
    shared = spark.sparkContext.broadcast(rules)  # bounded by the capacity, not by the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = place(shared.value, b["length"].to_numpy(), b["rank"].to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, at)], [*columns, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*columns, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
