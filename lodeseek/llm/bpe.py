"""BPE encoding by dynamic programming over prefixes, and decoding, for word-level BPE with end-of-word marks.

The last token of the encoding of a prefix is unique: among the vocabulary's tokens that end there, it is the one that
is compatible with the last token of the prefix before it, and two tokens are compatible if merging their joint text
gives just these two.  A suffix automaton over the vocabulary follows the longest stretch that ends at each position and
stands within some token; the tokens that end there are whole tokens among its suffixes.  A memo answers the pair
tests, and the back-pointers from the end give the ids.

A text is normalised (NFC, white space, lower case), cut at white space and by the word pattern, and each distinct
word is encoded once a worker, as far as its bounded caches reach.

Defined cases: a null text counts as empty: no ids, decoded to the empty text; special tokens within a text stand for
themselves; rows may repeat; other columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released
from .pieces import BLANK, NARROW, blocks, gathered, pieces, with_wide_spaces

#: The word pattern, white space, the bytes that stand for themselves and the mark of a word's end.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"[\t\n\v\f\r \x85\xa0  -     　]+")
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
END = "</w>"
PAIR = 1 << 32
_LOADED: dict[str, PrefixEncoder] = {}


class SuffixAutomaton:
    """The least automaton of all stretches of the given words (text to number).

    A state stands for stretches that end at the same places in the words: the longest one, of ``length``, and its
    suffixes down to one more than the length of ``link``'s state.  ``found`` lists the whole words among the suffixes
    of a state's longest stretch, longest first, as (length, number); a walk that matched fewer characters than that
    takes those that are no longer.
    """

    def __init__(self, words: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for word in words:
            state = 0
            for c in word:
                state = self._extended(state, c)
        for word, number in words.items():
            state = 0
            for c in word:
                state = self.next[state][c]
            ends.append((state, len(word), number))
        whole: dict[int, list[tuple[int, int]]] = {}
        for state, n, number in ends:
            whole.setdefault(state, []).append((n, number))
        self.found: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            shorter = self.found[self.link[state]]
            self.found[state] = (*sorted(whole[state], reverse=True), *shorter) if state in whole else shorter

    def _new(self, length: int, link: int, step: dict[str, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, c: str, to: int) -> int:
        """The state for the stretches of ``to`` that are no longer than those of ``state`` with ``c``."""
        if self.length[to] == self.length[state] + 1:
            return to
        short = self._new(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = short
        while state >= 0 and self.next[state].get(c) == to:
            self.next[state][c] = short
            state = self.link[state]
        return short

    def _extended(self, state: int, c: str) -> int:
        """The state of a stretch with one more character; it may be known from another word."""
        if (to := self.next[state].get(c)) is not None:
            return self._split(state, c, to)
        new = self._new(self.length[state] + 1, 0, {})
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, c, self.next[state][c])
        return new

    @property
    def parts(self) -> tuple:
        """What a walk over a text needs: steps, links, lengths, whole words."""
        return self.next, self.link, self.length, self.found


class PrefixEncoder:
    #: Bytes of a piece that is cached.
    SHORT = 48

    def __init__(self, path: str, limit: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (mark := spec["model"].get("end_of_word_suffix")) != END:
            raise ValueError(f"the vocabulary's end-of-word mark is {mark!r}; {END!r} is needed")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.led = {i: " " + t for i, t in self.text.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        others = [b for b in range(256) if b not in PLAIN]
        self.byte = {b: chr(b) for b in PLAIN} | {b: chr(256 + i) for i, b in enumerate(others)}
        plain = {(t[: -len(END)] + "\0" if t.endswith(END) else t): i for t, i in vocab.items() if i not in self.special.values()}
        self.tokens = SuffixAutomaton(plain)
        self.width = {i: len(t) for t, i in plain.items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.limit = limit
        self.pairs: dict[int, bool] = {}  # left * PAIR + right
        self.words: dict[str, tuple[int, ...]] = {}
        self.known, self.shown = pa.array([], pa.large_string()), pa.array([], pa.large_string())
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging: again and again the leftmost pair of the lowest rank."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else list(token)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens side by side; with -1 on the left, whether the right one is whole."""
        token = self.text[right]
        if left < 0:
            known = self.merged(self.symbols(token)) == [token]
        else:
            known = self.merged(self.symbols(self.text[left]) + self.symbols(token)) == [self.text[left], token]
        if len(self.pairs) < self.limit:
            self.pairs[left * PAIR + right] = known
        return known

    def word_ids(self, word: str) -> tuple[int, ...]:
        """The ids of one word of the pattern: last tokens of all prefixes, then the back-pointers from the end."""
        if (ids := self.words.get(word)) is not None:
            return ids
        line = (word if word.isascii() and word.isalnum() else "".join(map(self.byte.__getitem__, word.encode("utf-8", "surrogatepass")))) + "\0"
        last: list[int | None] = [-1] + [None] * len(line)
        pairs, (steps, link, length, found), state, matched = self.pairs, self.tokens.parts, 0, 0
        for end, c in enumerate(line, 1):
            while (to := steps[state].get(c)) is None and state:
                state = link[state]
                matched = length[state]
            if to is not None:
                state = to
                matched += 1
            for n, token in found[state]:
                if n <= matched and (before := last[end - n]) is not None:
                    if (known := pairs.get(before * PAIR + token)) is None:
                        known = self.compatible(before, token)
                    if known:
                        last[end] = token
                        break
        at, out = len(line), []
        while at:
            out.append(last[at])
            at -= self.width[last[at]]
        ids = tuple(reversed(out))
        if len(self.words) < self.limit // 4:
            self.words[word] = ids
        return ids

    def normalised(self, run: str) -> str:
        """One run without white space, in NFC and lower case, character by character (a final sigma stays plain)."""
        return run.lower() if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()

    def _run(self, run: str) -> tuple[int, ...] | list[int]:
        run = self.normalised(run)
        return self.word_ids(run) if run.isalpha() and run.isascii() else [i for word in WORD.findall(run) for i in self.word_ids(word)]

    def whole(self, text: str) -> list[int]:
        """Of any text."""
        out: list[int] = []
        for k, part in enumerate(self.special_pattern.split(text) if self.special_pattern else [text]):
            if k % 2:
                out.append(self.special[part])
            else:
                out += [i for run in SPACE.split(part) if run for i in self._run(run)]
        return out

    def _pieces(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The ids of the pieces in a row, where each ends, and the tokens of each, with a blank before each token."""
        texts = fresh.to_pylist()
        special = {p for p in texts if any(map(p.__contains__, self.special))} if any(map("\n".join(texts).__contains__, self.special)) else ()
        ids = [self.whole(p) if p in special or len(p) > self.SHORT else self._run(run) if (run := p.removeprefix(" ")) else () for p in texts]
        shown = pa.array(["".join(map(self.led.__getitem__, row)) for row in ids], pa.large_string())
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.fromiter((i for row in ids for i in row), np.uint32, int(ends[-1])), ends, shown

    def _block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        separator = NARROW[data]
        odd = with_wide_spaces(data, ends)
        data = np.where(separator, np.uint8(BLANK), data)
        upto, code, distinct = pieces(data, ends, separator, odd)
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64), np.zeros(0, np.uint8), np.zeros(len(ends), np.int64)
        at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, starts, shown = self.flat, self.starts, self.shown
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh = distinct.take(pa.array(missing))
            new, new_ends, new_shown = self._pieces(fresh)
            at[missing] = len(starts) - 1 + np.arange(len(missing))
            flat, starts, shown = np.concatenate([flat, new]), np.concatenate([starts, starts[-1] + new_ends]), pa.concat_arrays([shown, new_shown])
            if len(self.known) < self.limit:
                self._keep(fresh, new, new_ends, new_shown)
        begin, length = starts[at], starts[at + 1] - starts[at]
        row, token_ends = gathered(flat, begin[code], length[code])
        said = shown.take(pa.array(at[code]))
        said_ends = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + len(said) + 1]
        said_bytes = np.frombuffer(said.buffers()[2], np.uint8) if said_ends[-1] else np.zeros(0, np.uint8)
        return row, np.concatenate([[0], token_ends])[upto], said_bytes, said_ends[upto]

    def _keep(self, fresh: pa.Array, new: np.ndarray, ends: np.ndarray, shown: pa.Array) -> None:
        length = np.diff(ends, prepend=0)
        short = pc.less_equal(pc.binary_length(fresh), self.SHORT).to_numpy(zero_copy_only=False)
        self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(short))])
        self.shown = pa.concat_arrays([self.shown, shown.filter(pa.array(short))])
        self.flat = np.concatenate([self.flat, new[np.repeat(short, length)]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(length[short])])

    def coded(self, texts: pa.Array) -> Iterator[tuple[memoryview, memoryview]]:
        """The ids of each text as little-endian unsigned 32-bit integers, and its decoded text in UTF-8.

        Without a decoder in the vocabulary's file, decoding joins the tokens with blanks."""
        for _, data, ends in blocks(texts):
            row, token_ends, said, said_ends = self._block(data, ends)
            ids, said = memoryview(row.astype("<u4")).cast("B"), memoryview(np.ascontiguousarray(said))
            for a, z, b, y in zip(token_ends.tolist(), token_ends[1:].tolist(), said_ends.tolist(), said_ends[1:].tolist(), strict=False):
                yield ids[4 * a : 4 * z], said[b + 1 : y] if y > b else said[:0]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """ids and decoded text of each text."""
        both = [(np.frombuffer(ids, "<u4"), str(shown, "utf-8")) for ids, shown in self.coded(pa.array(texts, pa.large_string()))]
        return [ids for ids, _ in both], [shown for _, shown in both]


def prefix_encoder(path: str) -> PrefixEncoder:
    if path not in _LOADED:
        _LOADED[path] = PrefixEncoder(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """docs with ``n_tokens``, ``ids_sha256`` (little-endian unsigned 32-bit ids) and ``decoded_sha256``."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = prefix_encoder(tokenizer)
        for texts in released(batches):
            out = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown).hexdigest()) for ids, shown in encoder.coded(texts)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    found = docs.withColumn("_digests", digests(F.col(text_col)))
    for name in ("n_tokens", "ids_sha256", "decoded_sha256"):
        found = found.withColumn(name, F.col(f"_digests.{name}"))
    return found.drop("_digests")
