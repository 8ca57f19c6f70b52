"""Language ID of code-switched text by a linear-chain conditional random field over words.

A word is a run of letters; a run of more than WIDTH letters (scripts without blanks, compounds) counts as overlapping
words of WIDTH letters, so that all of it is read.  A word's scores are sums of learned weights of its features: itself
(the lexicon), its affixes and the n-grams within it, all hashed; learned transitions join the words.  Forward-backward
gives each word's distribution over languages, and a document's language is the one with the largest expected number
of words.

Word scores depend on the word alone, so a worker computes them for new words only; forward-backward runs over many
texts at once.  Emissions are learned on bounded excerpts of labelled rows, strung together at random so that
sequences switch languages, and the transitions see switches.

Defined cases: null texts and texts without a letter get ``und`` and score 0; a model fitted on no rows gives ``und``
to all; equal expected counts go to the language first in order; rows may repeat; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, released, trim
from .pieces import BLANK, NARROW, blocks, gathered, pieces

WORD = regex.compile(r"\p{L}+")
WIDTH, STEP = 20, 16  # letters of a word, and from one word of a longer run to the next
BITS = 16


def words_of(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    if max(map(len, words), default=0) <= WIDTH:
        return words
    return [w[i : i + WIDTH] for w in words for i in range(0, max(1, len(w) - (WIDTH - STEP)), STEP)]


def word_features(words: list[str]) -> np.ndarray:
    """Hashed features of each word, shape (words, features): word, affixes of 1 to 4, 2- and 3-grams; -1 for none."""
    code = np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH).astype(np.uint64)
    n = (code > 0).sum(1)
    code = np.concatenate([np.where(code > 0, code, 0), np.zeros((len(words), 4), np.uint64)], 1)
    mix = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
    step, columns = np.uint64(0x9E3779B97F4A7C15), []

    def add(h, kind: int, ok) -> None:
        columns.append(np.where(ok, mix(h * step + np.uint64(kind)).astype(np.int64), -1))

    with np.errstate(over="ignore"):
        whole = np.zeros(len(words), np.uint64)
        for k in range(WIDTH):
            whole = np.where(k < n, whole * step + code[:, k], whole)
            if k < 4:
                add(whole, 1 + k, k < n)
        add(whole, 9, n > 0)
        row, tail = np.arange(len(words)), np.zeros(len(words), np.uint64)
        for k in range(4):
            tail = tail * step + code[row, np.maximum(n - 1 - k, 0)]
            add(tail, 11 + k, k < n)
        for k in range(WIDTH - 1):
            two = code[:, k] * step + code[:, k + 1]
            if (k + 1 < n).any():
                add(two, 21, k + 1 < n)
            if (k + 2 < n).any():
                add(two * step + code[:, k + 2], 22, k + 2 < n)
    return np.stack(columns, 1)


def forward_backward(emission: list[np.ndarray], transition: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Marginals of each sequence and the expected counts of transitions over all of them.

    All sequences advance together, longest first, with scaling at each step.
    """
    order = sorted(range(len(emission)), key=lambda i: -len(emission[i]))
    length = np.array([len(emission[i]) for i in order], np.int64)
    k = len(start)
    T, s0 = np.exp(transition), np.exp(start)
    if not len(length) or not length[0]:
        return [np.zeros((0, k)) for _ in emission], np.zeros((k, k))
    live = np.searchsorted(-length, -np.arange(length[0]), side="left")  # sequences longer than t
    first = np.concatenate([[0], np.cumsum(live)])  # packed by time: rows first[t]:first[t + 1] are time t
    flat = np.empty((first[-1], k))
    for j, i in enumerate(order):
        if length[j]:
            flat[first[: length[j]] + j] = emission[i]
    e = np.exp(flat - flat.max(1, keepdims=True))
    alpha = np.empty_like(e)
    a = s0 * e[: live[0]]
    alpha[: live[0]] = a / a.sum(1, keepdims=True)
    for t in range(1, len(live)):
        a = (alpha[first[t - 1] : first[t - 1] + live[t]] @ T) * e[first[t] : first[t + 1]]
        alpha[first[t] : first[t + 1]] = a / a.sum(1, keepdims=True)
    beta, pairs = np.ones_like(e), np.zeros((k, k))
    for t in range(len(live) - 1, 0, -1):
        n = live[t]
        right = e[first[t] : first[t + 1]] * beta[first[t] : first[t + 1]]
        b = right @ T.T
        left = alpha[first[t - 1] : first[t - 1] + n]
        pairs += T * (left.T @ (right / np.maximum((left * b).sum(1, keepdims=True), 1e-300)))
        beta[first[t - 1] : first[t - 1] + n] = b / b.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    out: list[np.ndarray] = [np.zeros((0, k))] * len(emission)
    for j, i in enumerate(order):
        out[i] = gamma[first[: length[j]] + j]
    return out, pairs


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (2 ** BITS + 1, languages); the last row is 0, for no feature
    transition: np.ndarray
    start: np.ndarray
    limit: int = 400_000
    known: pa.Array = field(default_factory=lambda: pa.array([], pa.large_string()), repr=False)  # pieces of texts
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64), repr=False)  # the places of their words
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64), repr=False)
    words: pa.Array = field(default_factory=lambda: pa.array([], pa.large_string()), repr=False)  # those of the table's rows
    table: np.ndarray | None = field(default=None, repr=False)

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), 20_000):
            features = word_features(words[at : at + 20_000])
            for column in features.T:
                out[at : at + 20_000] += self.weights[column]
        return out

    def _block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of scores, the place of each of a block's words in it, and where each text's words end, led by 0."""
        if self.table is None:
            self.table = np.zeros((0, len(self.languages)), np.float32)
        separator = NARROW[data]
        upto, code, distinct = pieces(np.where(separator, np.uint8(BLANK), data), ends, separator, np.zeros(len(ends) - 1, bool))
        at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, starts, table = self.flat, self.starts, self.table
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh = distinct.take(pa.array(missing))
            words = [words_of(p) for p in fresh.to_pylist()]
            length = np.fromiter(map(len, words), np.int64, len(words))
            row = pa.array([w for ws in words for w in ws], pa.large_string()).dictionary_encode()
            place = pc.index_in(row.dictionary, self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            new = row.dictionary.filter(pa.array(place < 0))
            place[place < 0] = len(table) + np.arange(len(new))
            found = place[row.indices.to_numpy(zero_copy_only=False)]
            table = np.concatenate([table, self.word_scores(new.to_pylist())])
            at[missing] = len(starts) - 1 + np.arange(len(missing))
            flat, starts = np.concatenate([flat, found]), np.concatenate([starts, starts[-1] + np.cumsum(length)])
            if len(self.known) < self.limit:
                short = pc.less_equal(pc.binary_length(fresh), 48).to_numpy(zero_copy_only=False)
                self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(short))])
                self.flat = np.concatenate([self.flat, found[np.repeat(short, length)]])
                self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(length[short])])
                self.words, self.table = pa.concat_arrays([self.words, new]), table
        begin, length = starts[at], starts[at + 1] - starts[at]
        row, word_ends = gathered(flat, begin[code], length[code])
        return table, row, np.concatenate([[0], word_ends])[upto]

    def _groups(self, texts: pa.Array, most: int = 1_000_000) -> Iterator[list[np.ndarray]]:
        """The scores of each text's words, by groups of texts with about ``most`` scores together."""
        for _, data, ends in blocks(texts):
            table, row, word_ends = self._block(data, ends)
            at, words = 0, max(1, most // max(1, len(self.languages)))
            while at < len(word_ends) - 1:
                to = max(at + 1, int(np.searchsorted(word_ends, word_ends[at] + words, side="right")) - 1)
                scores = table[row[word_ends[at] : word_ends[to]]].astype(np.float64)
                yield np.split(scores, word_ends[at + 1 : to] - word_ends[at])
                at = to

    def emissions(self, texts: list[str]) -> list[np.ndarray]:
        return [e for group in self._groups(pa.array(texts, pa.large_string())) for e in group]

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """The language and the expected share of words in it, of each text of a list or an Arrow array."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        names, scores = [], [np.zeros(0)]
        for group in self._groups(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())):
            marginals, _ = forward_backward(group, self.transition, self.start)
            mass = np.array([m.sum(0) for m in marginals]).reshape(len(group), len(self.languages))
            total, best = mass.sum(1), mass.argmax(1)
            share = np.where(total > 0, mass[np.arange(len(best)), best] / np.maximum(total, 1e-12), 0.0)
            names += [self.languages[b] if n > 0 else "und" for b, n in zip(best, total, strict=True)]
            scores.append(np.clip(share, 0, 1))
        return names, np.concatenate(scores)


def train(sample: list[tuple[str, str]], words_each: int = 60, rounds: int = 40, rate: float = 0.5, ridge: float = 1e-5) -> LanguageModel:
    """Adagrad on the conditional log-likelihood of sequences of 1 to 4 labelled excerpts."""
    languages = sorted({lang for _, lang in sample})
    k, rng = len(languages), np.random.default_rng(0)
    if not k:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    spans = []
    for text, lang in sample:
        words = words_of(text)
        spans += [(words[i : i + words_each], languages.index(lang)) for i in range(0, len(words), words_each)]
    rng.shuffle(spans)
    sequences, at = [], 0
    while at < len(spans):
        n = int(rng.integers(1, 5))
        sequences.append(spans[at : at + n])
        at += n
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for ws, _ in s for w in ws], np.int64) for s in sequences]
    gold = [np.concatenate([np.full(len(ws), y) for ws, y in s]) if s else np.zeros(0, np.int64) for s in sequences]
    model = LanguageModel(languages, np.zeros((2**BITS + 1, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if not vocabulary:
        return model
    by_word, by_feature = Sums.of(list(vocabulary))
    flat_ids, flat_gold = np.concatenate(ids), np.concatenate(gold)
    truth = np.zeros((len(vocabulary), k))
    np.add.at(truth, (flat_ids, flat_gold), 1)
    true_pairs, true_start = np.zeros((k, k)), np.zeros(k)
    for g in gold:
        if len(g):
            np.add.at(true_pairs, (g[:-1], g[1:]), 1)
            true_start[g[0]] += 1
    weights = np.zeros((len(by_feature.names), k))  # of the features that occur
    sums = [np.full_like(x, 1e-6) for x in (weights, model.transition, model.start)]
    n = len(flat_ids)
    for _ in range(rounds):
        scores = by_word.of_rows(weights)
        marginals, pairs = forward_backward([scores[i] for i in ids], model.transition, model.start)
        expected = np.concatenate(marginals)
        seen = np.stack([np.bincount(flat_ids, expected[:, j], len(vocabulary)) for j in range(k)], 1)
        grad = by_feature.of_rows(truth - seen)
        begun = sum(m[0] for m in marginals if len(m))
        for x, g, s in ((weights, grad / n - ridge * weights, sums[0]), (model.transition, (true_pairs - pairs) / n - ridge * model.transition, sums[1]), (model.start, (true_start - begun) / n - ridge * model.start, sums[2])):
            s += g * g
            x += rate * g / np.sqrt(s)
    model.weights[by_feature.names] = weights
    return model


@dataclass
class Sums:
    """A sparse matrix of ones, by rows: a product with it sums some rows of another matrix."""

    names: np.ndarray
    columns: np.ndarray  # all rows' columns in a row
    starts: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> tuple[Sums, Sums]:
        """(words by features, features by words)."""
        rows, lists = [], []
        for at in range(0, len(words), 10_000):
            features = word_features(words[at : at + 10_000])
            word, column = np.nonzero(features >= 0)
            rows.append((word + at).astype(np.int32))
            lists.append(features[word, column].astype(np.int32))
        word, feature = np.concatenate(rows), np.concatenate(lists)
        names = np.flatnonzero(np.bincount(feature, minlength=2**BITS))
        place = np.zeros(2**BITS, np.int32)
        place[names] = np.arange(len(names))
        feature = place[feature]
        order = np.argsort(feature, kind="stable").astype(np.int32)
        by_word = cls(np.arange(len(words)), feature, np.searchsorted(word, np.arange(len(words))))
        return by_word, cls(names, word[order], np.searchsorted(feature[order], np.arange(len(names))))

    def of_rows(self, x: np.ndarray, most: int = 200_000) -> np.ndarray:
        """Each row has a column at least; about ``most`` of them are taken at once."""
        out = np.empty((len(self.starts), x.shape[1]))
        cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.columns), most)), len(self.starts)))
        ends = np.append(self.starts, len(self.columns))
        for i, j in zip(cuts, cuts[1:], strict=False):
            out[i:j] = np.add.reduceat(x[self.columns[ends[i] : ends[j]]], self.starts[i:j] - ends[i], axis=0)
        return out


def fit(docs: DataFrame, fit_rows: int = 600, excerpt: int = 2000, most_rows: int = 60_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on at most ``fit_rows`` rows of each language, and about ``most_rows`` of all, chosen by a hash of their
    ids, and on an excerpt of at most ``excerpt`` characters of each; every language is learned.  The caller leaves
    held-out rows out of ``docs``.  The counts that pass the driver are one a language."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias(lang_col), id_col, text_col)
    counts = rows.groupBy(lang_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang_col).collect()
    fit_rows = max(1, min(fit_rows, most_rows // max(1, len(counts))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.pmod(F.xxhash64(F.col(id_col)), F.greatest(F.lit(1), F.length(text) - excerpt + 1)) + 1
    if not counts:
        return train([])
    # about twice fit_rows rows of each language by a cut of the hash (all, where there are few), then the first fit_rows of them, in one pass
    part = F.pmod(F.xxhash64(id_col), F.lit(1_000_003))
    spark = docs.sparkSession
    cuts = spark.createDataFrame([(r[0], int((2 * fit_rows + 20) * 1_000_003 / r["n"])) for r in counts], "_lang string, _cut long")  # one row a language
    drawn = rows.join(F.broadcast(cuts), rows[lang_col] == F.col("_lang")).where(part <= F.col("_cut"))
    some = drawn.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), text.substr(at.cast("int"), F.lit(excerpt)).alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    first = some.withColumn("nth", order).where(F.col("nth") <= fit_rows).collect()
    place = {r[0]: i for i, r in enumerate(counts)}
    sample = [(r["text"], r["lang"]) for r in sorted(first, key=lambda r: (place[r["lang"]], r["nth"]))]
    model = train(sample)
    trim()
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``, the expected share of words in that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2 ** BITS weights a language

    @F.arrow_udf("lang_pred string, score double")
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            names, scores = shared.value.predict(texts)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    found = docs.withColumn("_found", labelled(F.col(text_col)))
    return found.withColumn("lang_pred", F.col("_found.lang_pred")).withColumn("score", F.col("_found.score")).drop("_found")
