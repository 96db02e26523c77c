"""Texts as units of white space and the word after it, met once per distinct unit.

A batch of texts is cut on its UTF-8 bytes with NumPy; only the distinct units become Python objects, and a
cache keeps what was computed for them. The words of a text then cost a few array operations each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a unit's objects, its dictionary entry and its two numbers, besides its own.
UNIT_BYTES = 200
#: Bytes that are hashed at once; about 32 bytes of scratch space for each.
_HASHED = 1 << 19


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets of each text in them."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _multipliers(n: int) -> np.ndarray:
    """A fixed random odd 64-bit number for each place."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each unit."""
    out = np.empty(len(starts), dtype=np.uint64)
    ends = starts + lengths
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _HASHED, side="right")))
        begin = starts[first:last]
        size = lengths[first:last]
        where = ragged(begin, size)
        place = where - np.repeat(begin, size)
        with np.errstate(over="ignore"):
            value = (data[where].astype(np.uint64) + np.uint64(1)) * _multipliers(int(size.max()))[place]
            sums_ = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value, dtype=np.uint64)])
            ends_ = np.cumsum(size)
            total = sums_[ends_] - sums_[ends_ - size]
            total ^= total >> np.uint64(32)
            total *= np.uint64(0xD6E8FEB86659FD93)
            out[first:last] = total ^ (total >> np.uint64(29)) ^ size.astype(np.uint64)
        first = last
    return out


def _unlike(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The units that aren't the same bytes as unit ``like`` of each."""
    unlike = lengths != lengths[like]
    rows = np.flatnonzero(~unlike & (like != np.arange(len(like))))
    ends = np.cumsum(lengths[rows])
    first = 0
    while first < len(rows):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _HASHED, side="right")))
        part = rows[first:last]
        size = lengths[part]
        same = data[ragged(starts[part], size)] == data[ragged(starts[like[part]], size)]
        wrong = np.unique(np.searchsorted(ends[first:last] - done, np.flatnonzero(~same), side="right"))
        unlike[part[wrong]] = True
        first = last
    return np.flatnonzero(unlike)


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One unit of each content, and for each unit which of them it equals. Hashes only propose, bytes decide."""
    _, first, inverse = np.unique(_hashes(data, starts, lengths), return_index=True, return_inverse=True)
    others: dict[bytes, int] = {}
    more = []
    for at in _unlike(data, starts, lengths, first[inverse]).tolist():
        unit = data[starts[at] : starts[at] + lengths[at]].tobytes()
        if unit not in others:
            others[unit] = len(first) + len(more)
            more.append(at)
        inverse[at] = others[unit]
    return (np.concatenate([first, more]).astype(np.int64) if more else first), inverse


def cut_words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch of other bytes than ``gaps``, white space by default, as one unit."""
    space = gaps[data]
    begins = ~space
    begins[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = ~space[heads]
    ends = ~space
    ends[:-1] &= space[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = ~space[tails]
    starts = np.flatnonzero(begins)
    return data, starts, np.flatnonzero(ends) + 1 - starts


def cut_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of units that begin at a text and at white space after other characters."""
    space = _SPACE[data]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    return data, starts, np.diff(np.append(starts, len(data)))


def whole_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text that isn't empty as one unit."""
    filled = offsets[:-1] < offsets[1:]
    return data, offsets[:-1][filled], np.diff(offsets)[filled]


# Kinds of bytes: white space, letter (beyond ASCII: part of one), digit, other, apostrophe.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[39] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class LatinCut:
    """Cut texts of Latin-1 letters finer: at every change of the kind of character, white space aside.

    ``lower``: in lower case. ``spaces``: white space begins the unit after it; else it is left out. ``digits``:
    every digit is a unit. ``letters``: only units that begin with a letter
    or an apostrophe. An apostrophe holds its neighbours.
    """

    def __init__(self, lower: bool = False, spaces: bool = False, digits: bool = False, letters: bool = False):
        self.lower, self.spaces, self.digits, self.letters = lower, spaces, digits, letters

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.lower:
            low = _LOWER[data]
            upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
            low[upper] += 32
            data = low
        kind = _KIND[data]
        begins = np.ones(len(data), dtype=bool)
        now, last = kind[1:], kind[:-1]
        change = now != last
        if self.digits:
            change |= now == 2
        glued = ((now == 4) & (last != 0)) | ((last == 4) & (now != 0))
        begins[1:] = change & ~glued
        if self.spaces:
            begins[1:] &= last != 0
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(data)))
        if not self.spaces:
            wanted = np.isin(kind[starts], (1, 4)) if self.letters else kind[starts] != 0
            starts, lengths = starts[wanted], lengths[wanted]
        return data, starts, lengths


def wide_rows(texts: pa.Array, special: bytes = b"") -> np.ndarray:
    """True for texts with characters other than ASCII and the letters of Latin-1, or with ``special``."""
    data, offsets = text_bytes(texts)
    wide = (data >= 0xC4) | (data == 0xC2)
    wide[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    at = np.flatnonzero(wide)
    if special:
        at = np.append(at, [m.start() for m in re.finditer(re.escape(special), data.tobytes())]).astype(np.int64)
    out = np.zeros(len(texts), dtype=bool)
    out[np.searchsorted(offsets, at, side="right") - 1] = True
    return out


class UnitCache:
    """Sequences of whole texts, put together from what ``encode`` gives for each distinct unit.

    ``encode`` takes a list of units (bytes) and returns the values of all of them, one after the other, and the
    number of values of each. The cache is emptied when it holds ``max_units`` units or ``max_bytes`` bytes, the
    dictionary's own counted.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], cutter=cut_space, dtype=np.int32, max_units: int = 300_000, max_bytes: int = 48 << 20):
        self.encode, self.cutter, self.dtype = encode, cutter, dtype
        self.max_units, self.max_bytes = max_units, max_bytes
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bytes = self.used = self.count = 0
        self.pool = np.empty(1 << 16, dtype=self.dtype)
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.lengths = np.empty(1 << 14, dtype=np.int64)

    def _grown(self, array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        out = np.empty(max(n, 2 * len(array)), dtype=array.dtype)
        out[: len(array)] = array
        return out

    def rows(self, units: list[bytes]) -> np.ndarray:
        """The place of each of these distinct units in the cache."""
        get = self.index.get
        found = np.array([get(u, -1) for u in units], dtype=np.int64)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [units[i] for i in missing.tolist()]
            values, lengths = self.encode(new)
            places = np.arange(self.count, self.count + len(new))
            self.index.update(zip(new, places.tolist()))
            found[missing] = places
            self.pool = self._grown(self.pool, self.used + len(values))
            self.pool[self.used : self.used + len(values)] = values
            self.starts = self._grown(self.starts, self.count + len(new))
            self.lengths = self._grown(self.lengths, self.count + len(new))
            lengths = np.asarray(lengths, dtype=np.int64)
            self.starts[places] = self.used + np.cumsum(lengths) - lengths
            self.lengths[places] = lengths
            self.used += len(values)
            self.count += len(new)
            self.bytes += sum(map(len, new)) + UNIT_BYTES * len(new) + values.dtype.itemsize * len(values)
        return found

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place in the cache of each unit of the texts, and the offsets of the texts in them."""
        if self.count >= self.max_units or self.bytes >= self.max_bytes:
            self.clear()
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
        data, starts, lengths = self.cutter(data, offsets)
        bounds = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.int64), bounds
        first, inverse = distinct(data, starts, lengths)
        raw = data.tobytes()
        begin = starts[first].tolist()
        end = (starts[first] + lengths[first]).tolist()
        found = self.rows([raw[a:b] for a, b in zip(begin, end)])
        return found[inverse], bounds

    def sequences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The values of all texts, one after the other, and the offsets of the texts in them."""
        rows, bounds = self.units(texts)
        lengths = self.lengths[rows]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.pool[ragged(self.starts[rows], lengths)], ends[bounds]


class MixedTexts:
    """Sequences of texts by ``plain``, or by ``wide`` where ``wide_rows`` holds."""

    def __init__(self, plain: UnitCache, wide: UnitCache, special: bytes = b""):
        self.plain, self.wide, self.special = plain, wide, special

    def sequences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        wide = wide_rows(texts, self.special)
        if not wide.any():
            return self.plain.sequences(texts)
        values, starts, lengths = [], np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        used = 0
        for rows, cache in ((~wide, self.plain), (wide, self.wide)):
            some, ends = cache.sequences(texts.filter(pa.array(rows)))
            starts[rows], lengths[rows] = used + ends[:-1], np.diff(ends)
            used += len(some)
            values.append(some)
        return np.concatenate(values)[ragged(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; an empty run gives zero."""
    total = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=values.dtype)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if len(filled):
        total[filled] = np.add.reduceat(values, offsets[filled], axis=0)
    return total
