"""Texts as arrays of 64-bit codes.

Everything here works on many texts at once: the bytes of an Arrow column are
one array, words and windows are positions in it, and no loop runs over rows,
words or windows. Memory follows the size of a piece (about a megabyte of text,
or one text if that is longer).
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
ANCHOR_BITS = np.uint64(28)  # a piece holds fewer than 2**28 positions
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of other characters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand.

    They are kept by the process, in a module of their own: tasks bring a copy of
    this package each, and would otherwise leave tables behind.
    """

    def __init__(self, base: int):
        self.base = base

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        kept = sys.modules.setdefault("_kept_powers", types.ModuleType("_kept_powers")).__dict__
        if len(kept.get(self.base, ((),))[0]) < n:
            def powers(base: int) -> np.ndarray:
                steps = np.full(n + n // 4, base % 2**64, np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)
            kept[self.base] = powers(self.base), powers(pow(self.base, -1, 2**64))
        return kept[self.base]


GRAMS, CONTENT = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)


class Sums:
    """Hashes of any stretches of a sequence of codes, in constant time each."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        up, self.down = powers.to(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:len(codes)], out=self.total[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of codes[first:last] for each pair; equal stretches give equal hashes."""
        length = (last - first).astype(np.uint64)
        return mix((self.total[last] - self.total[first]) * self.down[first]
                   + length * np.uint64(0x8EBC6AF09C88C6E3))


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type)
                                  or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    size = 8 if wide else 4
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1,
                            column.offset * size).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield (first, last, data[offsets[first]:offsets[last]],
               offsets[first:last + 1] - offsets[first])
        first = last


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the texts of a piece, or other runs of bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False,
                 separators: np.ndarray = _SPACE):
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.data, self.lower = data, lower
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of text i are those from bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)

    def codes(self) -> np.ndarray:
        """One 64-bit code per word; equal words have equal codes."""
        data = _LOWER[self.data] if self.lower else self.data
        return Sums(byte_codes(data), GRAMS).of(self.starts, self.ends)

    def rows(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def text_units(unit: str, data: np.ndarray, offsets: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all "bytes" or "words" of a piece, and the bounds of each text in them."""
    if unit == "bytes":
        return byte_codes(data), offsets
    words = Words(data, offsets)
    return words.codes(), words.bounds


def starts_within(bounds: np.ndarray, length: int) -> np.ndarray:
    """Positions whose window of ``length`` units stays inside its text."""
    ok = np.zeros(bounds[-1] + 1, np.int32)
    room = np.maximum(np.diff(bounds) - length + 1, 0)
    np.add.at(ok, bounds[:-1], 1)
    np.add.at(ok, bounds[:-1] + room, -1)
    return np.flatnonzero(np.cumsum(ok)[:-1] > 0)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


class Runs:
    """Windows of ``length`` units, dealt to anchors by winnowing.

    The anchor of a window is the gram of ``gram`` units inside it with the
    smallest hash, the leftmost of equal ones. It depends on nothing but what
    stands in the window, so equal windows have equal anchors at equal offsets.
    A run is a maximal row of neighbouring windows with one anchor.
    """

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, length: int, gram: int):
        self.length, width = length, length - gram + 1
        none = np.zeros(0, np.int64)
        self.first = self.count = self.anchor = none
        self.seed = none.astype(np.uint64)
        self.sums = None
        windows = starts_within(bounds, length)
        if not len(windows):
            return
        if len(codes) >= 1 << int(ANCHOR_BITS):
            raise ValueError(f"a text of {len(codes)} units is too long for anchors of "
                             f"{ANCHOR_BITS} bits")
        places = np.arange(len(codes) - gram + 1)
        grams = Sums(codes, GRAMS).of(places, places + gram)
        key = (grams >> ANCHOR_BITS << ANCHOR_BITS) | places.astype(np.uint64)
        low = sliding_min(key, width)[windows]
        anchor = (low & np.uint64((1 << int(ANCHOR_BITS)) - 1)).astype(np.int64)
        new = np.ones(len(windows), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
        at = np.flatnonzero(new)
        self.first, self.anchor = windows[at], anchor[at]
        self.count = np.diff(np.append(at, len(windows)))
        self.seed = grams[self.anchor]
        self.sums = Sums(codes, CONTENT)

    def content(self) -> np.ndarray:
        """Hash of all that the windows of a run cover, and of the anchor's place in it."""
        whole = self.sums.of(self.first, self.first + self.count + self.length - 1)
        return mix(whole + (self.anchor - self.first).astype(np.uint64))


class CodeSet:
    """A sorted set of codes that is quick to say no."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes.astype(np.uint64))
        bits = min(26, max(12, int(len(self.codes)).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.codes >> self.shift] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of codes that are in the set, and their index in it."""
        maybe = np.flatnonzero(self.seen[codes >> self.shift])
        if not len(maybe):
            return maybe, maybe
        at = np.searchsorted(self.codes, codes[maybe])
        at[at == len(self.codes)] = 0
        hit = self.codes[at] == codes[maybe]
        return maybe[hit], at[hit]
