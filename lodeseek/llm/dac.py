"""Token ids in directly addressable codes, as segments of binary columns in Parquet.

An id is split into chunks of 8 bits.  Level 0 holds the lowest chunk of every id, level k the k-th chunk of those ids
that need it; a bitmap at each level says which ids go on, and a rank directory (the number of set bits before each
block of 512) leads from a position at one level to its position at the next.  So any id is read by as many look-ups
as it has chunks, and nothing else is decoded.

A file is a Parquet table with one row a segment: ``part`` and ``seq`` (order of the segments), ``doc_ids`` and
``doc_starts`` (where each document begins in the segment, with the end at last), ``before`` (the ids of the part's
earlier segments) and, for each level, ``chunks``, ``bitmap`` and ``ranks``.  Documents are in ascending order of their ids over the segments; Spark reads and writes the
table wherever its storage is, and a segment holds about ``segment_ids`` ids, or a single longer document.

Defined cases: a null or empty text has only its end id; equal rows are documents of their own, in order of their
texts; rows without a doc_id stand first; an empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_table, parts, released
from .word_cache import cached_encoder, with_end

BLOCK = 512
SEGMENT = "part int, seq int, before long, n_ids long, doc_ids binary, doc_starts binary, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
WRITTEN = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("doc_starts", pa.binary()), *[(name, pa.list_(pa.binary())) for name in ("chunks", "bitmaps", "ranks")]])
NO_ID = -(2**63)


class Codes:
    """Directly addressable codes of a row of ids."""

    def __init__(self, chunks: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.chunks, self.bitmaps, self.ranks = chunks, bitmaps, ranks

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        rest, levels, bitmaps, ranks = ids.astype(np.uint32), [], [], []
        while True:
            levels.append((rest & 255).astype(np.uint8))
            more = rest > 255
            padded = np.zeros(-(-max(len(more), 1) // BLOCK) * BLOCK, bool)
            padded[: len(more)] = more
            bitmaps.append(np.packbits(padded, bitorder="little"))
            ranks.append((np.cumsum(padded.reshape(-1, BLOCK).sum(1)) - padded.reshape(-1, BLOCK).sum(1)).astype("<u4"))
            if not more.any():
                return cls(levels, bitmaps, ranks)
            rest = rest[more] >> 8

    def read(self, at: np.ndarray) -> np.ndarray:
        """The ids at any positions: a chunk a level, then on to the rank among the ids that go on."""
        at = np.asarray(at, np.int64)
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (level, bitmap, ranks) in enumerate(zip(self.chunks, self.bitmaps, self.ranks, strict=True)):
            out[live] |= level[at].astype(np.uint32) << np.uint32(8 * k)
            on = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            at, live = at[on], live[on]
            if not len(at):
                break
            block = at // BLOCK
            words = bitmap.view("<u8")
            word = at >> 6
            inside = np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            for back in range(1, BLOCK // 64):  # whole words between the block's start and the id's own word
                use = word - back >= block * (BLOCK // 64)
                inside += np.where(use, np.bitwise_count(words[np.maximum(word - back, 0)]), 0)
            at = ranks[block].astype(np.int64) + inside
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out, live = self.chunks[0].astype(np.uint32), np.arange(len(self.chunks[0]))
        for k in range(1, len(self.chunks)):
            live = live[np.unpackbits(self.bitmaps[k - 1], count=len(live), bitorder="little").view(bool)]
            out[live] |= self.chunks[k].astype(np.uint32) << np.uint32(8 * k)
        return out

    def row(self) -> dict:
        return {"chunks": [x.tobytes() for x in self.chunks], "bitmaps": [x.tobytes() for x in self.bitmaps], "ranks": [x.tobytes() for x in self.ranks]}

    @classmethod
    def of(cls, chunks, bitmaps, ranks) -> Codes:
        return cls([np.frombuffer(x, np.uint8) for x in chunks], [np.frombuffer(x, np.uint8) for x in bitmaps], [np.frombuffer(x, "<u4") for x in ranks])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends ``end_id`` and writes the segments in ascending order of the documents' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, before = cached_encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        docs_in, lengths_in, ids_in, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(ids_in)
            starts = np.cumsum([0, *np.concatenate(lengths_in)]).astype("<u8")
            row = {"part": part, "seq": seq, "before": before, "n_ids": len(ids), "doc_ids": np.concatenate(docs_in).astype("<i8").tobytes(), "doc_starts": starts.tobytes()}
            return pa.RecordBatch.from_pylist([row | Codes.encode(ids).row()], WRITTEN)

        for batch in released(batches):
            doc_ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for at, ids, ends, _, _ in encoder.blocks(batch["text"]):
                ids, ends = with_end(ids, ends, end_id)
                a = 0
                while a < len(ends) - 1:  # whole documents until the segment is full
                    z = min(len(ends) - 1, max(a + 1, int(np.searchsorted(ends, ends[a] + segment_ids - held))))
                    docs_in.append(doc_ids[at + a : at + z])
                    lengths_in.append(np.diff(ends[a : z + 1]))
                    ids_in.append(ids[ends[a] : ends[z]])
                    held += int(ends[z] - ends[a])
                    a = z
                    if held >= segment_ids:
                        yield segment()
                        docs_in, lengths_in, ids_in, seq, before, held = [], [], [], seq + 1, before + held, 0
        if docs_in:
            yield segment()

    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the file alone.

    The ids before a segment: those of earlier parts (one sum a part goes through the driver) and those of earlier
    segments of its own part, which its row names.  Segments are read where they are.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases = spark.sparkContext.broadcast(dict(zip([p for p, _ in totals], np.cumsum([0, *[n for _, n in totals]]).tolist(), strict=False)))  # a number a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                raw = memoryview(Codes.of(row["chunks"], row["bitmaps"], []).all().astype("<u4")).cast("B")
                starts = np.frombuffer(row["doc_starts"], "<u8").astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
                columns = [np.frombuffer(row["doc_ids"], "<i8"), starts[:-1] + (bases.value[row["part"]] + row["before"]), np.diff(starts), np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    out = segments.select("part", "before", "doc_ids", "doc_starts", "chunks", "bitmaps").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the ids of all documents into the shared folder and gives the digest of what it reads back."""
    path = new_table(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer, **options)
    return read_ids(docs.sparkSession, path)
