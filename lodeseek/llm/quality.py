"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

Two zstandard dictionaries are trained, one on good texts and one on bad ones.  Chunks of a text are compressed with
either, and the difference of the sizes summed over the whole text, divided by their sum and a constant that keeps very
short texts from extremes, is the raw score; a logistic curve turns it into the probability of label 1.  The curve is
fitted on labelled rows whose scores come from dictionaries trained without them.  Chunks are short, so that it is the
dictionary that helps and not what the text said before.

Defined cases: a null text counts as empty; an empty text has raw score 0; where a label has too few texts to train a
dictionary on, the texts themselves are it; without labelled rows of both kinds every score is the share of label 1 (0.5
without labels); rows may repeat; other columns pass through, except that columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released, trim
from .pieces import blocks


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    level: float
    chunk: int = 200
    effort: int = 1
    smoothing: int = 100

    def compressors(self):
        import zstandard

        out = []
        for raw in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=self.effort)
            out.append(zstandard.ZstdCompressor(level=self.effort, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def raw(self, texts, compressors=None) -> np.ndarray:
        """The normalised difference of the compressed sizes; over 0: the good dictionary helps more."""
        good, bad = compressors or self.compressors()
        out = []
        for _, data, ends in blocks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())):
            held = memoryview(np.ascontiguousarray(data))
            for at, end in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                a = b = 0
                for i in range(at, end, self.chunk):
                    part = held[i : min(i + self.chunk, end)]
                    a += len(good.compress(part))
                    b += len(bad.compress(part))
                out.append((b - a) / (a + b + self.smoothing))
        return np.array(out, float)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.level, -30, 30)))


def dictionary(texts: list[str], size: int, piece: int = 2000) -> bytes:
    """A dictionary of at most ``size`` bytes trained on pieces of the texts; the texts themselves, if they are too few."""
    import zstandard

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    samples = [r[i : i + piece] for r in raw for i in range(0, len(r), piece)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:size]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level by Newton's method with a light ridge."""
    a, scale = np.array([0.0, 0.0]), 100.0
    z = np.stack([x * scale, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        g = z.T @ (weight * (y - p)) - 1e-3 * a
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a += step / max(1, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(a[0] * scale), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, excerpt: int = 8000, size: int = 60_000, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fits on at most ``fit_rows`` labelled rows, half of each label, chosen by a hash of their ids; of each, at most
    ``excerpt`` characters (the driver holds no more than their product).  The dictionaries are trained on all of them;
    the curve is fitted on scores by dictionaries of the other ``folds``, weighted to the shares of the labels among all
    labelled rows."""
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)")
    share = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    if len(share) < 2:
        p = share.get(1, 0) / total if total else 0.5
        return QualityModel(b"", b"", 0.0, float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))
    halves = [labelled.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(fit_rows // 2) for y in (0, 1)]
    ids = halves[0].union(halves[1]).dropDuplicates(["id"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.pmod(F.xxhash64(F.col(id_col)), F.greatest(F.lit(1), F.length(text) - excerpt + 1)) + 1
    found = docs.select(F.col(id_col).alias("id"), text.substr(at.cast("int"), F.lit(excerpt)).alias("text")).join(F.broadcast(ids), "id")  # at most fit_rows ids
    rows = sorted({(r["id"], r["text"], r["y"]) for r in found.collect()})
    trained = lambda some: QualityModel(*(dictionary([r[1] for r in some if r[2] == y], size) for y in (1, 0)), 0.0, 0.0)
    model, x = trained(rows), np.zeros(len(rows))
    for fold in range(folds):
        mine = np.arange(len(rows)) % folds == fold
        rest = trained([r for r, m in zip(rows, mine, strict=True) if not m])
        x[mine] = rest.raw([r[1] for r, m in zip(rows, mine, strict=True) if m])
    y = np.array([r[2] for r in rows], float)
    if len(x):
        n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
        weight = np.where(y == 1, share[1] / total / n1, share[0] / total / n0) * len(y)
        model.slope, model.level = logistic(x, y, weight)
    trim()
    return model


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 where the score is at least ``threshold``)."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = model.compressors()
        for texts in released(batches):
            yield pa.array(model.probability(model.raw(texts, compressors)))

    bounded_batches(docs.sparkSession)
    out = docs.withColumn("score", scored(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
