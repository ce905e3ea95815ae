"""Vectorised reading of texts: words, lines and word windows of whole Arrow batches.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. All separators are ASCII, so
the UTF-8 bytes of a batch are scanned directly and no Python string is made.
Words are compared by 64-bit hashes of their bytes, eight at a time; long words,
lines and other ranges by a polynomial over their bytes (from one running sum for
the batch), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes from which on a word is hashed as a range. Low bits of 0 to 8 bytes.
_LONG = 64
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: Powers that a worker keeps; those of a longer text are made for it alone.
_KEPT_POWERS = SLICE_BYTES + 4096
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    if n <= _KEPT_POWERS and kind in _powers:
        return _powers[kind][:n]
    steps = np.full(max(n, _KEPT_POWERS), _BASE if kind == "up" else _INVERSE, np.uint64)
    steps[0] = 1
    found = np.multiply.accumulate(steps)
    if n <= _KEPT_POWERS:
        _powers[kind] = found
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = end


def _running(data: np.ndarray) -> np.ndarray:
    """Running sums of the terms of the polynomial."""
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = sums[1:]
    np.add(data, 1, out=terms, dtype=np.uint64, casting="unsafe")
    terms *= _power("up", len(data))
    np.cumsum(terms, out=terms)
    return sums


def _between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    value, length = sums[ends], (ends - starts).astype(np.uint64)
    value -= sums[starts]
    value *= _power("down", len(sums))[starts]
    length *= np.uint64(0xD6E8FEB86659FD93)
    value += length
    return mix(value)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes, or of other numbers from 0."""
    return _between(_running(data), starts, ends)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranges) -> np.ndarray:
    """64-bit hashes of words: up to eight bytes and the length make one, further eights are mixed in. ranges: hashes of byte ranges, for long words."""
    n = len(data) // 8 + 2
    padded = np.zeros(8 * n, np.uint8)
    padded[: len(data)] = data
    eights = padded.view("<u8")

    def at(place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, those after its length as 0."""
        low, shift = place >> 3, (place & 7).astype(np.uint64) << np.uint64(3)
        found = eights[low] >> shift
        found |= eights[low + 1] << np.uint64(1) << (np.uint64(63) - shift)
        found &= _LOW[np.minimum(length, 8)]
        return found

    length = ends - starts
    value = at(starts, length)
    more, step = np.flatnonzero((length > 8) & (length <= _LONG)), 8
    while len(more):
        value[more] = mix(value[more]) ^ at(starts[more] + step, length[more] - step)
        step += 8
        more = more[length[more] > step]
    value += length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    value = mix(value)
    if len(large := np.flatnonzero(length > _LONG)):
        value[large] = ranges(starts[large], ends[large])
    return value


class Scan:
    """Words of the units (texts, or lines of texts) that ``offsets`` cuts from ``data``.

    starts, ends: bytes of each word; first: index of each unit's first word,
    with one more entry at the end; hashes: one 64-bit hash per word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = (data != 0x20) & (data - np.uint8(0x09) > 4)  # not SPACE
        n = len(data)
        head, tail = solid.copy(), solid.copy()
        head[1:] &= ~solid[:-1]
        tail[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        head[inner] = solid[inner]
        tail[inner - 1] = solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.solid = solid
        self.hashes = _hashes(data, self.starts, self.ends, self.ranges)

    @cached_property
    def _sums(self) -> np.ndarray:
        return _running(self.data)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return _between(self._sums, starts, ends)

    def unit_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(unit, hash) of each run of ``width`` words, in order; a unit with 1 to width - 1 words has one shorter run."""
        counts = np.diff(self.first)
        full = np.maximum(counts - width + 1, 0)
        n = len(self.hashes)
        # All runs of the whole sequence, of which those inside a unit are taken.
        value = np.zeros(max(n - width + 1, 0), np.uint64)
        for j in range(width):
            value ^= self.hashes[j : j + len(value)]
            value *= np.uint64(_BASE)
            value ^= value >> np.uint64(29)
        units = np.arange(len(counts))
        unit = np.repeat(units, full)
        ends = np.cumsum(full)
        at = np.arange(len(unit)) + np.repeat(self.first[:-1] - (ends - full), full)
        value = value[at]
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(width):
                here = np.minimum(self.first[short] + j, n - 1)
                own = (own ^ np.where(j < counts[short], self.hashes[here], np.uint64(0x2545F4914F6CDD1D))) * np.uint64(_BASE)
                own ^= own >> np.uint64(29)
            place = ends[short] - full[short]
            unit, value = np.insert(unit, place, short), np.insert(value, place, own)
        return unit, mix(value)


def grouped(unit: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each distinct (unit, value), in order of place, and how often each stands there). Values are 64-bit hashes; so is a pair's."""
    key = value + unit.astype(np.uint64) * np.uint64(_BASE)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return at, at
    first = np.minimum.reduceat(order, at)
    back = np.argsort(first)
    return first[back], np.diff(at, append=len(key))[back]


def distinct(unit: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (unit, value) of hashes, in order of place."""
    at, _ = grouped(unit, value)
    return unit[at], value[at]


def counted(unit: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (unit, value) of hashes in order of place, and how often each stands there."""
    at, count = grouped(unit, value)
    return unit[at], value[at], count


def cells(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One value for each unit of weight: the value itself, and others for its second, third, .. time.

    The similarity of two sets of these is the weighted Jaccard similarity (sum of
    the lesser counts by sum of the greater).
    """
    if (count == 1).all():
        return value
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    every = np.repeat(value, count)
    again = number > 0
    every[again] = mix(every[again] + number[again].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return every


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts at ``\\n``: (offsets of lines, text of each line, number of each line in its text from 0).

    Each line keeps its ``\\n`` at the end, which is no part of a word. A text
    of n line feeds has n + 1 lines.
    """
    feeds = np.flatnonzero(data == 0x0A)
    text_of_feed = np.searchsorted(offsets, feeds, "right") - 1
    per_text = np.bincount(text_of_feed, minlength=len(offsets) - 1) + 1
    text = np.repeat(np.arange(len(offsets) - 1), per_text)
    before = np.concatenate([[0], np.cumsum(per_text)])[:-1]
    number = np.arange(len(text)) - before[text] if len(text) else np.zeros(0, np.int64)
    starts = np.empty(len(text), np.int64)
    starts[before] = offsets[:-1]
    rest = np.ones(len(text), bool)
    rest[before] = False
    starts[rest] = feeds + 1
    return np.concatenate([starts, offsets[-1:]]).astype(np.int64), text, number
