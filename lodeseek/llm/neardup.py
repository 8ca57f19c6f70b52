"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its sequence of words (runs of letters and digits, in lower case); its k-mers are the overlapping runs of
``k`` words, each labelled with the number of its occurrences so far.  A sketch is the ``l`` labelled k-mers of
smallest hash *in the order of the text*, so that texts collide if they share rare k-mers in the same order; ``rows``
sketches make one bucket key, ``tables`` keys a text.

Similarity is edit similarity over the labelled k-mers, 2 L / (n + m), where L is the length of the longest common
chain of both texts' order: an alignment of insertions and deletions.  At a similarity of at least s, positions differ
by at most (n + m)(1 - s), which is the alignment's band, and the texts share at least s / (2 - s) of all their k-mers.
With 5 words, similarity 0.8, l = 4, rows = 1 and 30 tables, a pair meets with probability 1 - (1 - (2/3)^4)^30, over
0.998.

Exact copies (equal word sequences) are one class and stand in for each other.  In every bucket each member is
compared with the bucket's leader, a different one in each table.  What those links leave apart is compared in
full: within a bucket, every member outside the largest component with every member of another component, unless the
lengths, the distances to the leader (the Jaccard distance is a metric) or the number of k-mers that stand in no other
text left exclude a link.  Buckets are cut by length and into tiles before that; none is capped.

Defined cases: every row is a document of its own, known by its id and its text; texts without words (null, empty,
symbols) and rows without an id are left alone, each kept; a text of fewer than k words is one k-mer; an empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_table, release_shuffles, released
from .graph import components
from .pieces import PieceTable

WORD = regex.compile(r"[\p{L}\p{N}]+")
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """64-bit hashes of words; keeps the first ones that a worker meets."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 100_000:
            self[word] = h
        return h


_HASHES = _WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def piece_hashes(piece: str) -> list[int]:
    return [_HASHES[w] for w in WORD.findall(piece.lower())]


_TABLE: list[PieceTable] = []


def text_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """word_hashes of each text; a worker keeps those of the pieces it met first."""
    if not _TABLE:
        _TABLE.append(PieceTable(piece_hashes, np.uint64))
    return _TABLE[0].texts(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers, each labelled with its occurrence, so that all differ."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        h = h * STEP + words[i : i + n]
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return h
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    label = np.empty(n, np.uint64)
    label[order] = np.arange(n) - first
    return mixed(h + label * STEP)


def order_minhash(h: np.ndarray, tables: int, rows: int, l: int) -> np.ndarray:  # noqa: E741
    """A bucket key for each table: ``rows`` sketches of the ``l`` smallest k-mers in text order."""
    keys = np.zeros(tables, np.uint64)
    block = max(1, min(tables * rows, 2_000_000 // max(1, len(h))))
    sketches = np.empty(tables * rows, np.uint64)
    for at in range(0, tables * rows, block):
        seeds = np.arange(at + 1, min(at + block, tables * rows) + 1, dtype=np.uint64)[:, None] * STEP
        x = (h[None, :] ^ mixed(seeds)) * MIX
        x ^= x >> np.uint64(32)
        least = np.tile(np.arange(len(h)), (len(seeds), 1)) if len(h) <= l else np.empty((len(seeds), l), np.int64)
        for i in range(l if len(h) > l else 0):
            least[:, i] = x.argmin(1)
            x[np.arange(len(seeds)), least[:, i]] = np.uint64(2**64 - 1)
        least.sort(axis=1)
        s = np.zeros(len(seeds), np.uint64)
        for column in least.T:
            s = s * STEP + h[column]
        sketches[at : at + len(seeds)] = mixed(s)
    for r in range(rows):
        keys = mixed(keys * STEP + sketches[r::rows])
    return keys


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> tuple[float, float]:
    """(similarity, Jaccard) of two sequences of labelled k-mers; below ``least`` the similarity may be too small."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    jaccard = len(i) / (n + m - len(i))
    if 2 * len(i) < least * (n + m):
        return 0.0, jaccard
    band = (n + m) * (1 - least) + 1
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= band]
    if (np.diff(j) > 0).all():
        chain = len(j)
    else:  # longest increasing chain
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        chain = len(tails)
    return 2 * chain / (n + m), jaccard


def named_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): rows with an id, and a hash of the text that tells rows of equal id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def sketched(rows_: DataFrame, k: int, tables: int, rows: int, l: int) -> DataFrame:  # noqa: E741
    """(doc_id, th, h1, h2, n, keys) of every row: 128 bits of the word sequence, the number of k-mers, the bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in released(batches):
            digests, sizes, keys = [], [], []
            for words in text_hashes(batch["text"]):
                digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                h = kmers(words, k)
                sizes.append(len(h))
                keys.append(order_minhash(h, tables, rows, l).view(np.int64) if len(h) else np.zeros(0, np.int64))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            columns = [batch["doc_id"], batch["th"], pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes, pa.int32()), listed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "h1", "h2", "n", "keys"])

    bounded_batches(rows_.sparkSession)
    return rows_.mapInArrow(run, "doc_id long, th long, h1 long, h2 long, n int, keys array<long>")


def with_kmers(texts: DataFrame, k: int) -> DataFrame:
    """(rep, kmers): the labelled k-mers of texts (rep, text) in their order, eight bytes each."""

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in released(batches):
            yield pa.array([kmers(words, k).tobytes() for words in text_hashes(some)], pa.binary())

    return texts.select("rep", packed("text").alias("kmers"))


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) with their similarity and Jaccard, from texts (rep, kmers)."""

    @F.arrow_udf("sim double, jaccard double")
    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in released(batches):
            out = [aligned(unpacked(x.as_py()), unpacked(y.as_py()), least) for x, y in zip(a, b, strict=True)]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in out], pa.float64()) for i in (0, 1)], ["sim", "jaccard"])

    one = texts.select(F.col("rep").alias("a"), F.col("kmers").alias("ka"))
    two = texts.select(F.col("rep").alias("b"), F.col("kmers").alias("kb"))
    both = pairs.join(two, "b").join(one, "a")
    return both.withColumn("c", compare("ka", "kb")).select("a", "b", "c.sim", "c.jaccard")


BINS = 128


def common_kmers(texts: DataFrame) -> DataFrame:
    """(rep, vec): how many of a text's k-mers stand in others of ``texts`` (rep, kmers) as well, by bins of their
    hashes."""

    @F.arrow_udf("array<long>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in released(batches):
            yield pa.array([unpacked(t.as_py()).view(np.int64) for t in some], pa.list_(pa.int64()))

    @F.arrow_udf("array<int>")
    def counted(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for some, at, ns in released(batches):
            out = []
            for t, bins, less in zip(some, at, ns, strict=True):
                n = np.bincount((unpacked(t.as_py()) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
                if bins.is_valid:
                    n[bins.values.to_numpy()] -= less.values.to_numpy()
                out.append(n.astype(np.int32))
            yield pa.array(out, pa.list_(pa.int32()))

    found = texts.select("rep", F.explode(listed("kmers")).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    in_bin = F.pmod("kmer", F.lit(BINS)).cast("int").alias("bin")  # bins divide 2 ** 64, so signs do not matter
    private = found.where("n = 1").groupBy("rep", in_bin).agg(F.count("*").cast("int").alias("n"))  # k-mers of one text
    private = private.groupBy("rep").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("ns"))  # at most BINS
    return texts.join(private, "rep", "left").select("rep", counted("kmers", "bins", "ns").alias("vec"))


#: Members of a bucket in a tile.
TILE = 512


def candidates(members: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of members (t, key, rep, n, component, core, total, j, vec) of one bucket and different components,
    one of them outside the largest component ``core``, that nothing known of them keeps apart.

    Lengths of a link lie within s / (2 - s) of each other, so a band of lengths meets itself and its neighbours only;
    one side of a bucket is cut into tiles, the other meets all of them."""
    share = least / (2 - least)
    band = F.floor(F.log(F.col("n")) / F.lit(-np.log(share))).cast("int")
    tiles = F.ceil(F.col("total") / TILE).cast("int")
    outside = members.where(F.col("component") != F.col("core")).select("t", "key", F.col("rep").alias("v"), F.col("n").alias("vn"), F.col("component").alias("vc"), F.col("j").alias("vj"), F.col("vec").alias("vs"), F.explode(F.sequence(band - 1, band + 1)).alias("band"), tiles.alias("tiles"))
    outside = outside.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    others = members.select("t", "key", F.col("rep").alias("u"), F.col("n").alias("un"), F.col("component").alias("uc"), F.col("j").alias("uj"), F.col("vec").alias("us"), band.alias("band"), F.pmod(F.xxhash64("rep"), tiles).cast("int").alias("tile"))
    close = F.coalesce(F.abs(F.col("vj") - F.col("uj")) <= 1 - share + 1e-9, F.lit(True))
    common = F.aggregate(F.zip_with("vs", "us", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)  # at most so many k-mers stand in both
    possible = (F.col("vc") != F.col("uc")) & (2 * F.least("vn", "un") >= least * (F.col("vn") + F.col("un"))) & close & (2 * common >= least * (F.col("vn") + F.col("un")))
    met = outside.join(others, ["t", "key", "band", "tile"]).where(possible)
    return met.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def row_groups(docs: DataFrame, k: int = 5, least: float = 0.8, tables: int = 30, rows: int = 1, l: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: E741
    """(doc_id, th, class_id, group_id, kept) of every row with an id: the smallest id of its exact copies, the smallest
    id of its group (what chains of links reach), and whether it is the group's first row by (id, text hash)."""
    spark = docs.sparkSession
    named = named_rows(docs, id_col, text_col)
    sketches = cut(sketched(named, k, tables, rows, l), "omh")
    classes = sketches.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th")).alias("who"), F.first(F.struct("n", "keys")).alias("s"))
    classes = cut(classes.select("h1", "h2", "who", "s.n", "s.keys", F.monotonically_increasing_id().alias("rep")), "omh-classes")  # written, so that the numbers stay

    members = classes.select("rep", "n", F.posexplode("keys").alias("t", "key"))
    draw = F.struct(F.xxhash64("t", "rep"), F.struct("rep", "n"))
    leaders = members.groupBy("t", "key").agg(F.min(draw).alias("m"), F.count("*").alias("size")).where("size > 1")
    leaders = leaders.select("t", "key", F.col("m.col2.rep").alias("leader"), F.col("m.col2.n").alias("leader_n"))
    met = cut(members.join(leaders, ["t", "key"]), "omh-buckets")

    star = met.where(F.col("rep") != F.col("leader")).where(2 * F.least("n", "leader_n") >= least * (F.col("n") + F.col("leader_n")))  # lengths exclude other links
    star = star.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    wanted = classes.join(met.select("rep").distinct(), "rep", "left_semi").select("rep", "who.doc_id", "who.th")
    texts = named.join(wanted, ["doc_id", "th"]).select("rep", "text")
    texts = cut(with_kmers(texts, k).dropDuplicates(["rep"]), "omh-texts")  # equal rows have equal texts
    compared = cut(verified(star, texts, least), "omh-compared")
    release_shuffles(spark)
    links = compared.where(F.col("sim") >= least).select("a", "b")
    first = components(links)

    # what the stars leave apart
    labelled = met.join(first, met["rep"] == first["node"], "left").select("t", "key", "rep", "n", "leader", F.coalesce("component", "rep").alias("component"))
    sizes = labelled.groupBy("t", "key", "component").agg(F.count("*").alias("size"))
    core = sizes.groupBy("t", "key").agg(F.max(F.struct("size", "component")).alias("m"), F.sum("size").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    core = core.select("t", "key", F.col("m.component").alias("core"), "total")
    near = compared.select("a", "b", "jaccard")
    to_leader = labelled.join(core, ["t", "key"]).withColumns({"a": F.least("rep", "leader"), "b": F.greatest("rep", "leader")}).join(near, ["a", "b"], "left")
    to_leader = cut(to_leader.select("t", "key", "rep", "n", "component", "core", "total", F.when(F.col("rep") == F.col("leader"), 1.0).otherwise(F.col("jaccard")).alias("j")), "omh-apart")
    vecs = cut(common_kmers(texts.join(to_leader.select("rep").distinct(), "rep", "left_semi")), "omh-vecs")
    rest = candidates(to_leader.join(vecs, "rep"), least).join(compared.select("a", "b"), ["a", "b"], "left_anti")
    more = cut(verified(rest, texts, least).where(F.col("sim") >= least).select("a", "b"), "omh-more")
    groups = components(first.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))

    named_classes = classes.select("h1", "h2", "rep", "who").join(groups, F.col("rep") == F.col("node"), "left").select("h1", "h2", "who", F.coalesce("component", "rep").alias("component"))
    heads = named_classes.groupBy("component").agg(F.min("who").alias("head"))
    named_classes = named_classes.join(heads, "component").select("h1", "h2", F.col("who.doc_id").alias("class_id"), "head")
    out = sketches.select("doc_id", "th", "h1", "h2", "n").join(named_classes, ["h1", "h2"], "left")
    alone = F.col("n") == 0
    for t in (met, compared, texts, to_leader, vecs, more):
        drop_table(t, spark)
    return out.select(
        "doc_id",
        "th",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"),
        (alone | (F.struct("doc_id", "th") == F.col("head"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, group_id, kept) for every row, as row_groups; rows without an id are each kept."""
    id_col = options.get("id_col", "doc_id")
    nulls = docs.where(F.col(id_col).isNull()).select(*[F.lit(None).cast("long").alias(c) for c in ("doc_id", "class_id", "group_id")], F.lit(True).alias("kept"))
    return row_groups(docs, **options).drop("th").unionByName(nulls)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group, the first by (id, text hash); of equal rows one stays, and different texts of
    one id are judged each on its own."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    gone = row_groups(docs, **options).where("not kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    known = docs.where(F.col(id_col).isNotNull())
    known = known.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"))
    kept = known.join(gone, ["_id", "_th"], "left_anti").dropDuplicates(["_id", "_th"]).select("row.*")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
