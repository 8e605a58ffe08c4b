"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z
lower-cased. All of these bytes are ASCII, so whole UTF-8 texts can be handled as
bytes. Hashes are 64 bits: a table of random numbers per byte, combined by a
polynomial through prefix sums and mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Texts are handled in slices of about this many bytes, so that the 64-bit work arrays stay small.
SLICE_BYTES = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, x in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, SLICE_BYTES), x, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Lookup:
    """Values of distinct 64-bit hashes, found for many at once."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, bits: int = 18) -> None:
        order = np.argsort(hashes)
        self.hashes, self.values, self.shift = hashes[order], values[order], np.uint64(64 - bits)
        self.start = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.start).max(initial=0))

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are held, and their values."""
        slot = (hashes >> self.shift).astype(np.int64)
        at = self.start[slot]
        end = self.start[slot + 1]
        some = np.flatnonzero(end > at)
        at, end, wanted = at[some].astype(np.int64), end[some], hashes[some]
        found = np.full(len(some), -1, np.int64)
        for _ in range(self.most):
            same = (at < end) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == wanted)
            found[same] = at[same]
            at = at + 1
        held = found >= 0
        return some[held], self.values[found[held]]


@dataclass
class Words:
    """The words of some texts: hashes, byte ranges in ``data``, and per text the first word (``first``, one longer)."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def text(self, k: np.ndarray) -> np.ndarray:
        """The number of the text that holds each of the words ``k``."""
        return np.searchsorted(self.first, k, side="right") - 1

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The words longer than ``length`` bytes, and the hashes of their first ``length`` bytes."""
        which = np.flatnonzero(self.ends - self.starts > length)
        s = self.starts[which]
        _, down = powers(len(self.data))
        return which, mix((self.sums[s + length] - self.sums[s]) * down[s] + np.uint64(length))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES; a longer text has a slice of its own."""
    if not len(column):
        return
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


#: Everything in ASCII but letters and digits parts words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def split(column: pa.Array, parts: np.ndarray = _SPACE) -> Words:
    """Split and hash all texts of a (slice of a) string column. ``parts``: whether a byte parts words."""
    data, offsets = buffers(column)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    empty = np.zeros(0, np.int64)
    if not n:
        return Words(data, np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64), np.zeros(1, np.uint64))
    word = ~parts[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | cut[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:-1]
    return hashed(data, np.flatnonzero(starts), np.flatnonzero(ends) + 1, offsets)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> Words:
    """Stretches of some texts' bytes as words."""
    n = len(data)
    up, down = powers(n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(data, hashes, starts, ends, np.searchsorted(starts, offsets), sums)


_GRAM = [int(x) | 1 for x in _RNG.integers(1, 2**63, size=64, dtype=np.uint64)]


def shingles(words: Words, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word ``width``-grams; with fewer words, the whole sequence as one."""
    h, first = words.hashes, words.first
    n = max(0, len(h) - width + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        grams += mix(h[k : k + n] + np.uint64(k)) * np.uint64(_GRAM[k])
    grams = mix(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            total = np.uint64(0)
            with np.errstate(over="ignore"):
                for k, x in enumerate(h[a:b]):
                    total += mix(np.array([x + np.uint64(k)], np.uint64))[0] * np.uint64(_GRAM[k])
                yield mix(np.array([total + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def sequences(words: Words) -> np.ndarray:
    """For each text a hash of its words in their order."""
    up, down = powers(len(words.hashes) + 1)
    sums = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(mix(words.hashes) * up[:-1], out=sums[1:])
    a, b = words.first[:-1], words.first[1:]
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def lines(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of all texts of a string column in a row, and the numbers of their texts; a null has none."""
    parts = pc.split_pattern(column.cast(pa.large_string()), "\n")
    return parts.flatten(), np.asarray(pc.list_parent_indices(parts), np.int64)
