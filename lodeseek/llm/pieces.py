"""Texts cut into pieces at blanks and line feeds, in bulk on Arrow's buffers.

A piece begins with its separator, if it has one, so that the pieces of a text in a row are the text.  Distinct pieces
are found by Arrow's own hashing; what is done a piece is done once a
block, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK, LINE_FEED = 32, 10
CONTROLS = np.array([b < 32 and b != LINE_FEED or b == 127 for b in range(256)])
#: White space of one byte.
NARROW = np.array([9 <= b <= 13 or b == BLANK for b in range(256)])
#: Lead bytes of white space beyond ASCII.
LEADS = np.array([b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])


def blocks(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of blocks of whole texts of about ``most`` bytes; a null text counts as empty.

    ``ends`` has one entry more than the block has texts, and begins with 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def of_texts(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts of a block hold the bytes at these places."""
    found = np.zeros(len(ends) - 1, bool)
    found[np.searchsorted(ends, at, side="right") - 1] = True
    return found


def with_wide_spaces(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts of a block hold white space beyond ASCII."""
    at = np.flatnonzero(LEADS[data])
    lead, padded = data[at], np.concatenate([data, np.zeros(2, np.uint8)])
    two, three = padded[at + 1], padded[at + 2]
    space = (lead == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (lead == 0xE1) & (two == 0x9A) & (three == 0x80) | (lead == 0xE3) & (two == 0x80) & (three == 0x80)
    general = (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F)
    return of_texts(at[space | (lead == 0xE2) & general], ends)


def with_runs(separator: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts of a block hold two separators in a row."""
    at = np.flatnonzero(separator)
    double = at[1:][at[1:] == at[:-1] + 1]
    return of_texts(double[~np.isin(double, ends)], ends)  # the first of a text follows none


def pieces(data: np.ndarray, ends: np.ndarray, separator: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(upto, code, distinct): the number of pieces before the end of each text, each piece's place among the distinct
    ones, and those.  An odd text is one piece."""
    separator = separator.copy()
    for i in np.flatnonzero(odd).tolist():
        separator[ends[i] : ends[i + 1]] = False
    separator[ends[:-1][ends[1:] > ends[:-1]]] = True
    at = np.flatnonzero(separator)
    offsets = np.append(at, len(data)).astype(np.int64)
    upto = np.searchsorted(at, ends)
    if not len(at):
        return upto, np.zeros(0, np.int64), pa.array([], pa.large_string())
    each = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    coded = each.dictionary_encode()
    return upto, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def gathered(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` in a row, and where each of them ends."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return flat[:0], ends
    at = np.repeat(begin - (ends - length), length)
    at += np.arange(len(at))
    return flat[at], ends


class PieceTable:
    """A row of values for each piece of text between white space, made once for the first ``limit`` short pieces that
    a worker meets; those of other pieces live for one block."""

    SHORT = 48

    def __init__(self, make, dtype, limit: int = 400_000):
        self.make, self.limit = make, limit
        self.known = pa.array([], pa.large_string())
        self.flat, self.starts = np.zeros(0, dtype), np.zeros(1, np.int64)

    def block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all texts of a block in a row, and where each text's values end, led by 0."""
        separator = NARROW[data]
        upto, code, distinct = pieces(np.where(separator, np.uint8(BLANK), data), ends, separator, np.zeros(len(ends) - 1, bool))
        at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, starts = self.flat, self.starts
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh = distinct.take(pa.array(missing))
            rows = [self.make(p) for p in fresh.to_pylist()]
            length = np.fromiter(map(len, rows), np.int64, len(rows))
            new = np.fromiter((x for row in rows for x in row), flat.dtype, int(length.sum()))
            at[missing] = len(starts) - 1 + np.arange(len(missing))
            flat, starts = np.concatenate([flat, new]), np.concatenate([starts, starts[-1] + np.cumsum(length)])
            if len(self.known) < self.limit:
                short = pc.less_equal(pc.binary_length(fresh), self.SHORT).to_numpy(zero_copy_only=False)
                self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(short))])
                self.flat = np.concatenate([self.flat, new[np.repeat(short, length)]])
                self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(length[short])])
        begin, length = starts[at], starts[at + 1] - starts[at]
        row, value_ends = gathered(flat, begin[code], length[code])
        return row, np.concatenate([[0], value_ends])[upto]

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The values of each text."""
        for _, data, ends in blocks(texts):
            row, value_ends = self.block(data, ends)
            yield from np.split(row, value_ends[1:-1])
