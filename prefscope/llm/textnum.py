"""Words, lines and windows of many texts at once, as numpy arrays over the
UTF-8 bytes of an Arrow string column.

A word is a maximal run of characters other than space, tab, \\n, \\x0b, \\f and
\\r. All of these are single bytes in UTF-8, so words are found on bytes.
Substrings get polynomial hashes modulo 2**64 from prefix sums, followed by a
finaliser; a second base gives an independent 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the two hash families.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: Texts are handled in slices of about this many bytes.
SLICE_BYTES = 2_000_000

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n."""
    got = _POWERS.get(family)
    if got is None or len(got[0]) < n:
        base, both = BASES[family], []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(n, b, U)
            a[:1] = 1
            both.append(np.cumprod(a, dtype=U))
        got = tuple(both)
        if n <= 2 * SLICE_BYTES:
            _POWERS[family] = got
    return got[0][:n], got[1][:n]


def prefix(values: np.ndarray, family: int = 0) -> np.ndarray:
    """Prefix sums from which ``span`` gives the hash of any run."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * powers(len(values), family)[0], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of the runs [start, end)."""
    inverse = powers(len(sums), family)[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text has one of its own."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, lo = np.cumsum(sizes, dtype=np.int64), 0
    while lo < len(texts):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, "right")))
        yield lo, hi
        lo = hi


class Texts:
    """Bytes and words of some texts; null counts as empty.

    ``data``: all bytes; ``offset``: where each text begins, and the end.
    ``start``, ``end``: byte range of each word; ``words``: number of the first
    word of each text, and the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, separator: np.ndarray = _SEPARATOR):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n, at = len(texts), texts.offset
        _, offsets, data = texts.buffers()
        offset = np.frombuffer(offsets, np.int64, n + 1 + at)[at:].copy() if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        raw = raw[offset[0]:offset[-1]]
        self.data = _LOWER[raw] if lower else raw
        self.offset = offset - offset[0]
        self.n, size = n, len(raw)
        self.inside = ~separator[raw]
        edge = np.zeros(size + 1, bool)
        edge[self.offset] = True
        left = self.inside.copy()
        left[1:] &= ~self.inside[:-1] | edge[1:-1]
        right = self.inside.copy()
        right[:-1] &= ~self.inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(left)
        self.end = np.flatnonzero(right) + 1
        self.words = np.searchsorted(self.start, self.offset)
        self._sums: dict[int, np.ndarray] = {}

    def n_words(self) -> np.ndarray:
        return np.diff(self.words)

    def sums(self, family: int = 0) -> np.ndarray:
        if family not in self._sums:
            self._sums[family] = prefix(self.data.astype(U) + U(1), family)
        return self._sums[family]

    def hashes(self, family: int = 0) -> np.ndarray:
        """One hash per word."""
        return span(self.sums(family), self.start, self.end, family)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a mask over bytes, for each text."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.offset[1:]] - total[self.offset[:-1]]

    def per_word_text(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a mask over words, for each text."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.words[1:]] - total[self.words[:-1]]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words())

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``length`` words, and their texts."""
        text = self.text_of_word()
        first = np.arange(len(text))
        fits = first + length <= self.words[1:][text]
        return first[fits], text[fits]


def window_hashes(words: np.ndarray, first: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    return span(prefix(words, family), first, first + length, family)


def covered(n: int, first: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``first``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + length, -1)
    return np.cumsum(steps[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
