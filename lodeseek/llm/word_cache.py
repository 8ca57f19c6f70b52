"""Encoding by a byte-level BPE of the tokenizers library, through a bounded cache of pieces.

Such a BPE never joins a space to what stands before it unless white space stands there too, and a lone line feed
between two other characters is a piece of its own.  So a text without runs of white space can be cut before each
space and before each line feed: the ids of the text are the ids of its pieces in a row.  Any other text goes to the
tokenizers library as a whole, as do pieces beyond Latin letters or with what may be a special token; tiktoken's
engine, given the vocabulary of the tokenizers file, merges the other new pieces, as it needs less time for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pieces import BLANK, CONTROLS, LINE_FEED, blocks, gathered, of_texts, pieces, with_runs, with_wide_spaces

_LOADED: dict[tuple, CachedEncoder] = {}


class CachedEncoder:
    """ids of texts, exactly as ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    The cache keeps about the first ``limit`` short pieces that a worker meets (frequent ones come early); the ids of
    other pieces live for one block.  A null text counts as empty and has no ids.
    """

    #: The pre-tokenizer pattern of byte-level BPE; bytes that stand for themselves in its alphabet.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
    #: Bytes of a piece that is cached.
    SHORT = 48
    #: A word of Latin letters or signs, with a blank before it or not.
    LATIN = re.compile(r" ?[!-~\xa1-\u024f]{1,48}")

    def __init__(self, path: str, limit: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        others = [b for b in range(256) if b not in self.PLAIN]
        byte = {chr(b): b for b in self.PLAIN} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        added = self.tok.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added.values()):
            raise ValueError("special tokens that reach over white space are not supported")
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if i not in added}
        self.special = [t.content for t in added.values()]
        self.merge = tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_feed = ranks[b"\n"]
        self.limit = limit
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, fresh: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The pieces' places in another order, the ids of all pieces in that order and where each ends.

        A line feed before a word is an id of its own."""
        bare = [p[1:] if p[0] == "\n" and len(p) > 1 else p for p in fresh]
        plain = list(map(self.LATIN.fullmatch, bare))
        if any(map("\n".join(bare).__contains__, self.special)):
            plain = [m and not any(map(m[0].__contains__, self.special)) for m in plain]
        kinds = [[i for i, m in enumerate(plain) if m], [i for i, m in enumerate(plain) if not m]]
        joined = self.merge.encode_to_numpy("\n".join(bare[i] for i in kinds[0])) if kinds[0] else np.zeros(0, np.uint32)
        seams = joined == self.line_feed
        length = np.diff(np.concatenate([[-1], np.flatnonzero(seams), [len(joined)]])) - 1 if kinds[0] else np.zeros(0, np.int64)
        more = [self.ids(fresh[i]) for i in kinds[1]]
        order = kinds[0] + kinds[1]
        led = np.array([fresh[i][0] == "\n" and len(fresh[i]) > 1 for i in kinds[0]], bool)
        words = joined[~seams]
        if led.any():
            words = np.insert(words, (np.cumsum(length) - length)[led], self.line_feed)
            length = length + led
        ends = np.cumsum(np.concatenate([length, [len(m) for m in more]]))
        return order, np.concatenate([words, *more]).astype(np.uint32), ends.astype(np.int64)

    def _block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        separator = (data == BLANK) | (data == LINE_FEED)
        odd = with_wide_spaces(data, ends) | with_runs(separator, ends) | of_texts(np.flatnonzero(CONTROLS[data]), ends)
        upto, code, distinct = pieces(data, ends, separator, odd)
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, starts = self.flat, self.starts
        missing = np.flatnonzero(at < 0)
        if len(missing):
            order, new, new_ends = self._pieces(distinct.take(pa.array(missing)).to_pylist())
            fresh = missing[order]
            at[fresh] = len(starts) - 1 + np.arange(len(fresh))
            flat, starts = np.concatenate([flat, new]), np.concatenate([starts, starts[-1] + new_ends])
            if len(self.known) < self.limit:
                self._keep(distinct.take(pa.array(fresh)), new, new_ends)
        begin, length = starts[at], starts[at + 1] - starts[at]
        row, token_ends = gathered(flat, begin[code], length[code])
        return row, np.concatenate([[0], token_ends])[upto]

    def _keep(self, fresh: pa.Array, new: np.ndarray, ends: np.ndarray) -> None:
        length = np.diff(ends, prepend=0)
        short = pc.less_equal(pc.binary_length(fresh), self.SHORT).to_numpy(zero_copy_only=False)
        self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(short))])
        self.flat = np.concatenate([self.flat, new[np.repeat(short, length)]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(length[short])])

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, ids, where each text's ids end, bytes, where each text's bytes end) of blocks of texts, both
        ends led by 0."""
        for at, data, ends in blocks(texts):
            ids, token_ends = self._block(data, ends)
            yield at, ids, token_ends, data, ends

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for _, ids, ends, _, _ in self.blocks(pa.array(texts, pa.large_string())):
            out += np.split(ids, ends[1:-1])
        return out


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block with ``end_id`` after each text, and where each text's ids end, led by 0."""
    return np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4"), ends + np.arange(len(ends))


def cached_encoder(path: str, limit: int = 400_000) -> CachedEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    if (path, limit) not in _LOADED:
        _LOADED[path, limit] = CachedEncoder(path, limit)
    return _LOADED[path, limit]
