"""Vectorised kernels over the bytes of one Arrow batch.

Everything here works on one bounded slice of a batch (``slices``), so memory follows the slice and the
longest single document, never the partition. Hashes are polynomial in 64-bit wrap-around arithmetic
over random per-symbol weights, finished by a mixing step; equal content gives equal hashes in any task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BASE2 = np.uint64(0xD1342543DE82EF95)
_INVERSE2 = np.uint64(pow(int(_BASE2), -1, 1 << 64))
_WEIGHTS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, bases: tuple[np.uint64, np.uint64] = (_BASE, _INVERSE)) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, kept and grown."""
    for b in bases:
        if int(b) not in _powers or len(_powers[int(b)]) < n:
            p = np.full(max(n, 1 << 21), b, dtype=np.uint64)
            p[0] = 1
            _powers[int(b)] = np.multiply.accumulate(p)
    return _powers[int(bases[0])][:n], _powers[int(bases[1])][:n]


class Hashes:
    """Content hashes of any span of a symbol sequence in constant time each."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.other = symbols, None
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, n: int) -> np.ndarray:
        """Hash of every span of n symbols, by start."""
        if len(self.sums) <= n:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def seconds(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Another hash of spans: of other weights, to another base."""
        if self.other is None:
            up, down = powers(len(self.symbols) + 1, (_BASE2, _INVERSE2))
            sums = np.zeros(len(self.symbols) + 1, dtype=np.uint64)
            np.cumsum(mix(self.symbols ^ np.uint64(0x632BE59BD9B4E019)) * up[:-1], out=sums[1:])
            self.other = sums, down
        sums, down = self.other
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of about SLICE_BYTES of text; a null text is empty.

    offsets has one more entry than rows; bytes[offsets[i]:offsets[i+1]] is the text of row i in UTF-8."""
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if len(text) and text.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        last = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, row + 1), len(text))
        own = offsets[row : last + 1]
        yield batch.slice(row, last - row), data[own[0] : own[-1]], own - own[0]
        row = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of the words ``[^\\x20\\x09-\\x0D]+`` (or runs of bytes not ``between``) and, for each
    row, its first word's number (one more entry than rows). Words never cross rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    in_word = ~between[data]
    starts = in_word.copy()
    starts[1:] &= ~in_word[:-1]
    ends = in_word.copy()
    ends[:-1] &= ~in_word[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    starts[edge] |= in_word[edge]
    ends[edge - 1] |= in_word[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _WEIGHTS[data]


def word_symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit symbol for each word, from its bytes."""
    return Hashes(byte_symbols(data)).spans(start, end)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row number of every symbol, from the rows' first symbol numbers."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    if len(x) < n:
        return x[:0]
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return x if span == n else np.minimum(x[: len(x) - (n - span)], x[n - span :])


def anchors(symbols: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """Winnowed anchors of all windows that lie in one row.

    Every window of ``window`` symbols owns the smallest-hashed gram in it (leftmost on ties), so equal
    windows own equal grams at equal places, wherever they stand. Returns (row, at, hash, runs, hashes):
    the anchor grams' rows, positions and content hashes, and for each the first and last window start
    that it owns (an anchor's windows are consecutive)."""
    none = np.zeros(0, dtype=np.int64)
    hashes = Hashes(symbols)
    grams = hashes.windows(gram)
    wide = window - gram + 1
    if len(symbols) < window:
        return none, none, none.astype(np.uint64), np.zeros((0, 2), np.int64), hashes
    bits = np.uint64(32)  # the same everywhere, so that equal windows pick alike in any slice
    keys = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    least = window_minimum(keys, wide)
    # windows that cross a row's end are left out
    lengths = np.diff(first)
    inside = np.zeros(len(least) + 1, dtype=np.int32)
    ok = lengths >= window
    np.add.at(inside, first[:-1][ok], 1)
    np.add.at(inside, first[1:][ok] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[:-1])
    if not len(starts):
        return none, none, none.astype(np.uint64), np.zeros((0, 2), np.int64), hashes
    at = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    begin = np.flatnonzero(new)
    runs = np.stack([starts[begin], starts[np.append(begin[1:], len(at)) - 1]], axis=1)
    at = at[begin]
    row = np.searchsorted(first, at, side="right") - 1
    return row, at, grams[at], runs, hashes


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of n symbols under spans of ``length`` from each start."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
