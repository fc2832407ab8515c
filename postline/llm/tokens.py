"""Words of many texts at once, as numpy arrays: used inside Arrow batches by the operators that aren't native.

``slices`` cuts an Arrow column of texts into pieces of bounded bytes; ``Words`` finds the words of a piece. Hashes are
64-bit: a polynomial over the word's bytes with an odd multiplier, as differences of one running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A dozen arrays of 8 bytes a byte are held for a piece; this size also stays in a core's cache.
PIECE_BYTES = 1 << 17
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
FIVE = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_powers: dict[str, np.ndarray] = {}


def blank_table() -> np.ndarray:
    """True for bytes of a word that is anything but white space: ``[^\\x20\\x09-\\x0D]``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def letter_table() -> np.ndarray:
    """True for bytes of a word of letters, by ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased: digits, letters and all above ASCII."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER ** i and its inverse for i < n at least. Only tables for usual pieces are kept."""
    if "up" in _powers and len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    made = []
    for base in (MULTIPLIER, INVERSE):
        a = np.full(max(n, 1), base, np.uint64)
        a[0] = 1
        made.append(np.multiply.accumulate(a))
    if n <= PIECE_BYTES + 1:
        _powers["up"], _powers["down"] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(column: pa.Array | pa.ChunkedArray, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of rows of about piece_bytes: row first + i is bytes[bounds[i]:bounds[i + 1]]. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    n = len(text)
    if not n:
        return
    bounds = np.frombuffer(text.buffers()[1], np.int64, n + 1, 8 * text.offset)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + piece_bytes, "right")) - 1)
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


class Words:
    """The words of the texts data[bounds[i]:bounds[i + 1]]: start and end (bytes), and doc, the text's number."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = table[data]
        turn = inside[1:] != inside[:-1]
        edges = np.flatnonzero(turn)
        # a word that runs over the end of a text is two
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        split = np.unique(inner[inside[inner] & inside[inner + 1]]) if len(inner) else inner
        if len(split):
            edges = np.sort(np.concatenate([edges, split, split]))
        self.data, self.bounds = data, bounds
        self.start, self.end = edges[0::2], edges[1::2]
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self, lower: bool = True) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        b = (lower_table()[self.data] if lower else self.data).astype(np.uint64)
        b += np.uint64(1)
        b *= up[: len(b)]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b, out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive words; one that starts near the end of a text is the caller's to drop."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(width):
        # another odd factor for each place
        factor = (factor * FIVE[j % 5] | 1) % (1 << 64)
        out += hashes[j : j + n] * np.uint64(factor)
    return mix(out)
