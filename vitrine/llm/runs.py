"""Stretches of words that repeat with a period, found by minimizers on several scales.

A run of period ``q`` holds every window of up to ``q`` words a second time, ``q`` words later. On the scale of
periods from ``P`` to ``2 P`` a window has ``P`` words; its smallest hash of ``P / 2`` neighbouring words (the rightmost of
equal ones) depends on the window alone, so both windows choose the same place in them. Pairs of chosen places with
equal hashes and a distance of that scale are seeds; they are extended both ways to the whole stretch in which words
one distance apart are equal. Periods below ``LEAST_SCALE`` are found by comparing all words with those a lag later.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm.columns import append_columns
from vitrine.llm.units import cut_words, distinct, ragged, text_bytes

#: Words that a run has at least; it also has two periods.
LEAST_LENGTH = 12
#: Periods below this are looked for one by one.
LEAST_SCALE = 16
#: Pairs of minimizers that are worked on at once.
PAIRS_AT_ONCE = 1 << 20
#: Bytes of text whose words are worked on at once.
TEXT_BYTES = 2 << 20
#: Primes below 2 ** 31 and bases of the hashes that measure common stretches.
_PRIMES = ((2147483647, 1103515245), (2147483629, 362437069))
_FAR = np.int64(1) << 62


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, each scattered over the whole range."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring stretches of one length."""
    with np.errstate(over="ignore"):
        return _mixed(left * np.uint64(0xD1B54A32D192ED03) + (right ^ (right >> np.uint64(32))))


class Prefixes:
    """Whether stretches of a sequence are equal, by sums over its beginnings under two primes."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.sums, self.powers = [], []
        spread = _mixed(words)
        for prime, base in _PRIMES:
            power = np.ones(self.n + 1, dtype=np.int64)
            known, step = 1, base
            while known <= self.n:
                more = min(known, self.n + 1 - known)
                power[known : known + more] = power[:more] * step % prime
                known, step = known + more, step * step % prime
            value = (spread % np.uint64(prime)).astype(np.int64)
            spread = spread >> np.uint64(16)
            self.powers.append(power)
            self.sums.append(np.concatenate([[0], np.cumsum(value * power[:-1] % prime)]) % prime)

    def equal(self, x: np.ndarray, y: np.ndarray, length) -> np.ndarray:
        """True where the stretches of ``length`` words at ``x`` and at ``y`` >= ``x`` have one hash."""
        out = np.ones(len(x), dtype=bool)
        for (prime, _), total, power in zip(_PRIMES, self.sums, self.powers):
            left = (total[x + length] - total[x]) % prime * power[y - x] % prime
            out &= left == (total[y + length] - total[y]) % prime
        return out

    def common(self, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``x`` on and from ``y`` >= ``x`` on are equal, or before them."""
        room = x if back else self.n - y
        length = np.zeros(len(x), dtype=np.int64)
        step = 1 << int(room.max(initial=1)).bit_length()
        while step:
            rows = np.flatnonzero(length + step <= room)
            if len(rows):
                at = -(length[rows] + step) if back else length[rows]
                hit = rows[self.equal(x[rows] + at, y[rows] + at, step)]
                length[hit] += step
            step >>= 1
        return length


def _stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of consecutive numbers."""
    if not len(places):
        return places, places
    begin = np.flatnonzero(np.diff(places, prepend=places[0] - 2) != 1)
    return places[begin], np.diff(np.append(begin, len(places)))


def _short(words: np.ndarray, least: int, below: int) -> list[np.ndarray]:
    """(start, length, period) of the runs whose period is below ``below``, and of multiples of their periods."""
    out = []
    for lag in range(1, min(below, len(words))):
        start, equal = _stretches(np.flatnonzero(words[:-lag] == words[lag:]))
        long = equal >= max(least - lag, lag)
        out.append(np.stack([start[long], equal[long] + lag, np.full(int(long.sum()), lag)], axis=1))
    return out


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest of each ``window`` neighbouring hashes, the rightmost of equal ones."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, dtype=np.int64)
    mask = np.uint64((1 << int(n).bit_length()) - 1)
    least = (hashes & ~mask) | (mask - np.arange(n, dtype=np.uint64))
    covered = 1
    while covered < window:
        step = min(covered, window - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    places = (mask - (least & mask)).astype(np.int64)
    return places[np.diff(places, prepend=-1) != 0]


def seed_pairs(places: np.ndarray, hashes: np.ndarray, scale: int):
    """Pairs of ``places`` with equal ``hashes`` of ``scale // 2`` words and a distance from ``scale`` to below twice that, in parts.

    Inside a stretch of shorter period a hash recurs at one gap. If both places of a pair are followed by their
    hash at this gap, no longer than what is hashed, the pair one gap later lies in the same stretch of equal
    words; only the last of such pairs are given, so a stretch has few pairs however short its period is.
    """
    order = np.lexsort((places, hashes))
    place, value = places[order], hashes[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    group = np.cumsum(new) - 1
    gap = np.full(len(place), _FAR)
    gap[:-1][~new[1:]] = np.diff(place)[~new[1:]]
    usual = np.minimum.reduceat(gap, np.flatnonzero(new)) if len(place) else gap
    regular = (gap == usual[group]) & (gap <= scale // 2)
    span = np.int64(places.max(initial=0)) + 4 * scale
    key = group * span + place
    special = np.flatnonzero(~regular)
    # Those after a special place, then regular ones before it.
    for low, high, after in ((scale, 2 * scale, True), (1 - 2 * scale, 1 - scale, False)):
        base = key[special]
        bottom = np.maximum(base + low, group[special] * span)
        first = np.searchsorted(key, bottom)
        count = np.maximum(np.searchsorted(key, base + high) - first, 0)
        ends = np.cumsum(count)
        at = 0
        while at < len(special):
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
            other = ragged(first[at:stop], count[at:stop])
            mine = np.repeat(special[at:stop], count[at:stop])
            if after:
                yield place[mine], place[other]
            else:
                wanted = regular[other]
                yield place[other[wanted]], place[mine[wanted]]
            at = stop


def _same(words: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """True where all words of a run equal those a period later."""
    size = length - period
    out = np.zeros(len(start), dtype=bool)
    ends = np.cumsum(size)
    at = 0
    while at < len(start):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        where = ragged(start[at:stop], size[at:stop])
        alike = words[where] == words[where + np.repeat(period[at:stop], size[at:stop])]
        out[at:stop] = np.minimum.reduceat(alike, ends[at:stop] - size[at:stop] - done)
        at = stop
    return out


def _smallest(found: np.ndarray) -> np.ndarray:
    """One row for each stretch, the one with the smallest period, by start and period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)
    found = found[fresh]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def find_runs(words: np.ndarray, offsets: np.ndarray, least: int = LEAST_LENGTH, least_scale: int = LEAST_SCALE) -> np.ndarray:
    """(start, length, period) of all runs in texts of word numbers, by start and period.

    ``words`` holds numbers from 0 of all texts one after the other, ``offsets`` where they begin; starts count from
    the first word of all. A run is a stretch with smallest period ``period`` and at least ``least`` and two periods
    of words that can't be extended. A number of its own stands between texts, so no run crosses texts.
    """
    sizes = np.diff(offsets)
    gaps = np.arange(1, len(offsets))
    held = np.empty(len(words) + len(sizes), dtype=np.int64)
    held[np.arange(len(words)) + np.repeat(gaps, sizes)] = words
    first = offsets[:-1] + gaps  # of each text in held, after the number of its own
    held[first - 1] = -gaps
    found = np.concatenate([np.zeros((0, 3), dtype=np.int64), *_short(held, least, least_scale)])
    found = _smallest(found)
    scale = least_scale
    part, hashes, origin = held, _mixed(held), np.arange(len(held))
    gram = 1
    keep = np.arange(len(sizes))
    while True:
        keep = keep[sizes[keep] >= 2 * scale]
        if not len(keep):
            break
        # Only texts long enough for two periods go on; their own number stays before them.
        at = np.searchsorted(origin, first[keep] - 1)
        chosen = ragged(at, sizes[keep] + 1)
        part, hashes, origin = part[chosen], hashes[chosen], origin[chosen]
        while gram < scale // 2:
            longer = hashes.copy()
            longer[: len(hashes) - gram] = _joined(hashes[: len(hashes) - gram], hashes[gram:])
            hashes, gram = longer, 2 * gram
        whole = len(part) - gram + 1
        places = minimizers(hashes[:whole], scale - gram + 1)
        prefixes = None
        rows = [found]
        for x, y in seed_pairs(places, hashes[places], scale):
            if not len(x):
                continue
            prefixes = prefixes or Prefixes(part)
            lag = y - x
            before = prefixes.common(x, y, True)
            length = before + prefixes.common(x, y, False) + lag
            good = length >= np.maximum(2 * lag, least)
            rows.append(np.unique(np.stack([origin[x[good] - before[good]], length[good], lag[good]], axis=1), axis=0))
        if len(rows) > 1:
            known = len(found)
            merged = _smallest(np.concatenate(rows))
            new = merged[merged[:, 2] >= scale]
            right = _same(held, *new.T) if len(new) else np.ones(0, dtype=bool)
            if not right.all():  # two stretches with one hash: look at that lag word by word
                fixed = [row for lag in np.unique(new[~right, 2]).tolist() for row in _lag(held, lag, least)]
                merged = np.concatenate([merged[merged[:, 2] < scale], new[right], *[r[None] for r in fixed]])
                merged = _smallest(merged)
            found = merged
            assert len(found) >= known
        scale *= 2
    owner = np.searchsorted(first, found[:, 0], side="right")
    found[:, 0] -= owner
    return found


def _lag(words: np.ndarray, lag: int, least: int) -> list[np.ndarray]:
    start, equal = _stretches(np.flatnonzero(words[:-lag] == words[lag:]))
    return [np.array([s, e + lag, lag]) for s, e in zip(start.tolist(), equal.tolist()) if e >= max(least - lag, lag)]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """False for words that a run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _texts(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Units joined by one space, text by text."""
    ends = np.cumsum(lengths + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
    out[ragged(ends - lengths - 1, lengths)] = data[ragged(starts, lengths)]
    offsets = np.concatenate([[0], ends])[bounds]
    # The space after the last unit of each text goes.
    last = ends[bounds[1:][bounds[1:] > bounds[:-1]] - 1] - 1
    filled = np.concatenate([[0], np.cumsum(bounds[1:] > bounds[:-1])])
    offsets = (offsets - filled).astype(np.int64)
    values = np.delete(out, last)
    kind = pa.large_string()
    made = pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return made.cast(pa.string())


RUN = T.StructType([T.StructField(name, T.LongType(), True) for name in ("start", "length", "period")])


def with_runs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: int = LEAST_LENGTH) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``runs`` and ``collapsed`` of each text.

    Words are what stands between white space of ASCII. ``runs`` lists (start, length, period) in words of every
    stretch that repeats with this smallest period, has at least ``least`` words and two periods, and can't be
    extended, by start and period. ``collapsed`` has the words that no run holds after its first period, joined by one
    space.

    Nothing is shuffled; each text is judged by itself and whole, a very long one alone. A null or empty text has no
    runs and collapses to the empty text; repeated rows get equal results; an empty table gives no rows; columns
    named as a result are replaced.
    """

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            data, offsets = text_bytes(texts)
            if len(data):
                data, starts, lengths = cut_words(data, offsets)
            else:
                starts = lengths = np.zeros(0, dtype=np.int64)
            bounds = np.searchsorted(starts, offsets)
            found = np.zeros((0, 3), dtype=np.int64)
            if len(starts):
                _, words = distinct(data, starts, lengths)
                found = find_runs(words.astype(np.int64), bounds, least)
            kept = kept_words(len(starts), found)
            left = np.concatenate([[0], np.cumsum(kept)])[bounds]
            owner = np.searchsorted(bounds[1:], found[:, 0], side="right")
            begin = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            columns = [found[:, 0] - bounds[:-1][owner], found[:, 1], found[:, 2]]
            items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=RUN.names)
            return [pa.ListArray.from_arrays(pa.array(begin), items), _texts(data, starts[kept], lengths[kept], left)]

        return work

    fields = [T.StructField("runs", T.ArrayType(RUN), True), T.StructField("collapsed", T.StringType(), True)]
    return append_columns(df, text_col, make, fields, keep, TEXT_BYTES)
