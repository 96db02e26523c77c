"""Collocations: phrases whose words stand together more often than apart, mined with weighted acyclic automata.

A shard of the table counts its n-grams of one to three words in a transducer: words label the transitions, the
weight of a transition is the number of times its path occurs, and states with the same transitions are one. It is built
from the shard's sorted n-grams, states bottom up, and cut by ranges of the hash of an n-gram's prefix (its first two
words). The transducers of a range are united and their weights summed in one task. The counts of a phrase's parts are
looked up by composing the parts that a range asks for with the transducer of the range that holds them; every part
is asked for once per range, so a word that most phrases hold costs no more than another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.llm.columns import quoted, release, slices
from vitrine.llm.units import _LOWER, _hashes, cut_words, distinct, ragged, text_bytes
from vitrine.session import ship_package, stage

UNKNOWN = "und"
#: Bytes of text whose n-grams make one range, and words that a shard counts before it hands on its transducer.
RANGE_BYTES = 8 << 20
SHARD_WORDS = 600_000
_SLICE = 1 << 20
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True

#: A shard's transducer within a range: the words' bytes and lengths; the words that begin a path (as steps from one to the
#: next) and their weights; for each pair its first word (in steps), second word, weight and state reached (from 1; 0:
#: none); for each state the number of its transitions; their labels and weights.
SHARD = (
    "range long, units binary, unit_size binary, one binary, one_n binary, two_a binary, two_b binary, two_n binary, "
    "two_state binary, state_size binary, state_label binary, state_n binary"
)
#: Kinds of rows about frequent n-grams: those of a range, what it asks of another, the answer, words per language.
TABLE, ASK, ANSWER, TOTAL = range(4)
PATHS = "range long, kind int, source long, units array<binary>, a array<int>, b array<int>, c array<int>, n array<bigint>, longer array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_range(first: np.ndarray, second: np.ndarray | None, ranges: int) -> np.ndarray:
    """The range of n-grams with this first word, or these first two, by the hashes of the words."""
    with np.errstate(over="ignore"):
        h = first if second is None else first * np.uint64(0x9E3779B97F4A7C15) + second
    return ((_mix(h) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def unit_hashes(units: list[bytes] | pa.Array) -> np.ndarray:
    data, offsets = text_bytes(pa.array(units, pa.binary()) if isinstance(units, list) else units)
    return _hashes(data, offsets[:-1], np.diff(offsets))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(n[order], begin)


def count_grams(ids: np.ndarray, joined: np.ndarray):
    """Counts of all words, pairs and triples of words in a row; ``joined``: in one piece with the word before.

    Gives (word, n), (first << 32 | second, n) and (pair's place << 32 | third, n), each in order.
    """
    words, word_n = np.unique(ids, return_counts=True)
    at = np.flatnonzero(joined[1:]) + 1
    pairs, which, pair_n = np.unique(ids[at - 1] << 32 | ids[at], return_inverse=True, return_counts=True)
    place = np.full(len(ids), -1, dtype=np.int64)
    place[at] = which
    third = at[place[at - 1] >= 0]
    triples, triple_n = np.unique(place[third - 1] << 32 | ids[third], return_counts=True)
    return (words, word_n), (pairs, pair_n), (triples, triple_n)


def register(sizes: np.ndarray, labels: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the states (lists of ``sizes`` transitions with ``labels`` and weights ``n``) are the same.

    Gives the number of each one's representative and the places of those. A hash proposes equal states, their
    transitions decide.
    """
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        value = _mix(labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mix(n.astype(np.uint64)))
        signature = np.add.reduceat(value, starts) if len(starts) else value
    _, first, which = np.unique(signature, return_index=True, return_inverse=True)
    like = first[which]
    same = sizes == sizes[like]
    rows = np.flatnonzero(same)
    mine, other = ragged(starts[rows], sizes[rows]), ragged(starts[like[rows]], sizes[rows])
    bad = (labels[mine] != labels[other]) | (n[mine] != n[other])
    same[np.repeat(rows, sizes[rows])[bad]] = False
    like = np.where(same, like, np.arange(len(like)))
    kept = np.flatnonzero(like == np.arange(len(like)))
    return np.searchsorted(kept, like), kept


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(held) -> np.ndarray:
    held = memoryview(held)
    return np.frombuffer(held, dtype=f"<u{held[0]}", offset=1).astype(np.int64)


def transducers(units: list[bytes], ids: np.ndarray, joined: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """The count transducer of a shard, one row for each range of prefixes that it has."""
    (words, word_n), (pairs, pair_n), (triples, triple_n) = count_grams(ids, joined)
    hashes = unit_hashes(units)
    word_range = prefix_range(hashes[words], None, ranges)
    pair_range = prefix_range(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF], ranges)
    del hashes
    # Triples stand in the order of their pairs.
    first = np.searchsorted(triples, np.arange(len(pairs) + 1) << 32)
    one, two = np.argsort(word_range, kind="stable"), np.argsort(pair_range, kind="stable")
    found = np.unique(np.concatenate([word_range, pair_range]))
    one_at, two_at = (np.searchsorted(r, np.append(found, ranges)) for r in (word_range[one], pair_range[two]))
    sizes = [len(u) for u in units]
    rows = []
    for at, number in enumerate(found.tolist()):
        mine, p = words[one[one_at[at] : one_at[at + 1]]], two[two_at[at] : two_at[at + 1]]
        a, b, kids = pairs[p] >> 32, pairs[p] & 0xFFFFFFFF, first[p + 1] - first[p]
        going = np.flatnonzero(kids)
        moves = ragged(first[p[going]], kids[going])
        labels, weights = triples[moves] & 0xFFFFFFFF, triple_n[moves]
        state, kept = register(kids[going], labels, weights)
        reached = np.zeros(len(p), dtype=np.int64)
        reached[going] = state + 1
        moves = ragged((np.cumsum(kids[going]) - kids[going])[kept], kids[going][kept])
        used, local = np.unique(np.concatenate([mine, a, b, labels[moves]]), return_inverse=True)
        mine, a, b, labels = np.split(local, np.cumsum([len(mine), len(a), len(b)]))
        used = used.tolist()
        numbers = (
            np.array([sizes[u] for u in used]), np.diff(mine, prepend=0), word_n[one[one_at[at] : one_at[at + 1]]],
            np.diff(a, prepend=0), b, pair_n[p], reached, kids[going][kept], labels, weights[moves],
        )
        rows.append((number, b"".join([units[u] for u in used]), *map(pack, numbers)))
        if len(rows) == 64:
            yield _shard_rows(rows)
            rows = []
    if rows:
        yield _shard_rows(rows)


def _shard_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]]
    return pa.RecordBatch.from_arrays(arrays, names=[part.split()[0] for part in SHARD.split(", ")])


class Shard:
    """The words of some texts, until their transducer is handed on."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.langs: dict[bytes, int] = {}
        self.pairs: list[np.ndarray] = []
        self.joined: list[np.ndarray] = []
        self.size = 0

    def add(self, langs: list[str], texts: pa.Array) -> None:
        data, offsets = text_bytes(texts)
        if not len(data):
            return
        data, starts, lengths = cut_words(_LOWER[data], offsets, _GAP)
        if not len(starts):
            return
        first, inverse = distinct(data, starts, lengths)
        raw = data.tobytes()
        words = [raw[s : s + n] for s, n in zip(starts[first].tolist(), lengths[first].tolist())]
        number = np.array([self.words.setdefault(w, len(self.words)) for w in words], dtype=np.int64)
        lang = np.array([self.langs.setdefault(x.encode("utf-8"), len(self.langs)) for x in langs], dtype=np.int64)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
        joined = np.zeros(len(starts), dtype=bool)
        joined[1:] = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
        self.pairs.append(lang[owner] << 32 | number[inverse])
        self.joined.append(joined)
        self.size += len(starts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            pairs, ids = np.unique(np.concatenate(self.pairs), return_inverse=True)
            joined = np.concatenate(self.joined)
            langs, words = list(self.langs), list(self.words)
            self.clear()
            units = [langs[p >> 32] + b"\t" + words[p & 0xFFFFFFFF] for p in pairs.tolist()]
            del pairs, words
            yield from transducers(units, ids, joined, self.ranges)


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the offsets of the rows in them."""
    chunks = [c for c in table.column(name).chunks if len(c)]
    sizes = np.concatenate([[0], *[pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in chunks]]).astype(np.int64)
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate(values) if values else np.zeros(0, dtype=np.int64), np.cumsum(sizes)


def _units(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units of all rows, the number of each unit of each row, and the offsets of the rows in these."""
    chunks = [c for c in table.column("units").chunks if len(c)]
    sizes = np.concatenate([[0], *[pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in chunks]]).astype(np.int64)
    coded = pa.chunked_array([c.flatten() for c in chunks], pa.binary()).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes)


def unite(table: pa.Table):
    """Sum the transducers of a range: its units, (word, n), (first << 32 | second, n), (pair's place << 32 | third, n).

    Numbers are unpacked row by row, as they take several times the room of what holds them.
    """
    columns = {name: [c.as_buffer() for c in table.column(name)] for name in table.column_names[1:]}
    rows = range(table.num_rows)
    part = lambda name, row: unpack(columns[name][row])
    names = []
    for row in rows:
        bounds = np.concatenate([[0], np.cumsum(part("unit_size", row))]).astype(np.int32)
        names.append(pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), columns["units"][row]]))
    at = np.cumsum([0, *map(len, names)])
    coded = pa.chunked_array(names, pa.binary()).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    units, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    del names, coded
    own = [number[at[row] : at[row + 1]] for row in rows]
    words = summed(np.concatenate([own[r][np.cumsum(part("one", r))] for r in rows]).astype(np.int64), np.concatenate([part("one_n", r) for r in rows]))
    keys = [own[r][np.cumsum(part("two_a", r))].astype(np.int64) << 32 | own[r][part("two_b", r)] for r in rows]
    pairs = summed(np.concatenate(keys), np.concatenate([part("two_n", r) for r in rows]))
    triples, weights = [], []
    for row in rows:
        state, size, label = part("two_state", row), part("state_size", row), part("state_label", row)
        going = np.flatnonzero(state)
        state = state[going] - 1
        moves = ragged((np.cumsum(size) - size)[state], size[state])
        triples.append(np.repeat(np.searchsorted(pairs[0], keys[row][going]), size[state]) << 32 | own[row][label[moves]])
        weights.append(part("state_n", row)[moves])
        keys[row] = None
    return units, words, pairs, summed(np.concatenate(triples), np.concatenate(weights))


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows (range, kind, source, units, a, b, c, n, longer) as a table."""
    names = [part.split()[0] for part in PATHS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), *[pa.list_(pa.int32())] * 3, *[pa.list_(pa.int64())] * 2]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    arrays = [pa.array(list(c), k) for c, k in zip(columns[:3], kinds[:3])]
    for column, kind in zip(columns[3:], kinds[3:]):
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in column])]).astype(np.int32)
        values = [pa.array(c, kind.value_type) for c in column]
        arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.concat_arrays(values) if values else pa.array([], kind.value_type)))
    return pa.Table.from_arrays(arrays, names=names)


def _row(target: int, kind: int, source: int, units: pa.Array, a, b, c, n, longer) -> tuple:
    """A row with the units that its paths hold, numbered anew."""
    used, local = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    skip = int(len(used) > 0 and used[0] < 0)
    a, b, c = np.split(local.astype(np.int32) - skip, [len(a), len(a) + len(b)])
    return target, kind, source, units.take(pa.array(used[skip:])), a, b, c, n, longer


def frequent(key, table: pa.Table, least: int, ranges: int) -> pa.Table:
    """The n-grams of a range that occur ``least`` times, what it asks other ranges for, and words per language."""
    (own,) = (k.as_py() for k in key)
    units, (words, word_n), (pairs, pair_n), (triples, triple_n) = unite(table)
    rows = []
    langs: dict[bytes, int] = {}
    for unit, n in zip(units.take(pa.array(words)).to_pylist(), word_n.tolist()):
        lang = unit.rpartition(b"\t")[0]
        langs[lang] = langs.get(lang, 0) + n
    nothing = np.full(len(langs), -1, dtype=np.int64)
    if langs:
        rows.append((own, TOTAL, own, pa.array(list(langs), pa.binary()), np.arange(len(langs), dtype=np.int32), nothing, nothing, np.array(list(langs.values())), nothing))
    keep = word_n >= least
    words, word_n = words[keep], word_n[keep]
    often = np.flatnonzero(pair_n >= least)
    a, b, pair_n = pairs[often] >> 32, pairs[often] & 0xFFFFFFFF, pair_n[often]
    keep = triple_n >= least
    triples, triple_n = triples[keep], triple_n[keep]
    # A frequent triple's pair is frequent.
    owner, third = np.searchsorted(often, triples >> 32), triples & 0xFFFFFFFF
    longer = np.zeros(len(often), dtype=np.int64)
    np.maximum.at(longer, owner, triple_n)
    ones, twos, threes = len(words), len(often), len(owner)
    if not ones + twos:
        return _rows(rows)
    none = lambda n: np.full(n, -1, dtype=np.int64)
    rows.append(
        _row(
            own, TABLE, own, units,
            np.concatenate([words, a, a[owner]]), np.concatenate([none(ones), b, b[owner]]), np.concatenate([none(ones + twos), third]),
            np.concatenate([word_n, pair_n, triple_n]), np.concatenate([none(ones), longer, none(threes)]),
        )
    )
    single = np.unique(np.concatenate([a, b, third]))
    ends, place = np.unique(b[owner] << 32 | third, return_inverse=True)
    most = np.zeros(len(ends), dtype=np.int64)
    np.maximum.at(most, place, triple_n)
    first = np.concatenate([single, ends >> 32])
    second = np.concatenate([none(len(single)), ends & 0xFFFFFFFF])
    most = np.concatenate([none(len(single)), most])
    if len(first):
        hashes = unit_hashes(units)
        target = np.where(second < 0, prefix_range(hashes[first], None, ranges), prefix_range(hashes[first], hashes[np.maximum(second, 0)], ranges))
        order = np.argsort(target, kind="stable")
        begin = np.flatnonzero(np.diff(target[order], prepend=-1))
        for part in np.split(order, begin[1:]):
            rows.append(_row(int(target[part[0]]), ASK, own, units, first[part], second[part], none(len(part)), none(len(part)), most[part]))
    return _rows(rows)


class Automaton:
    """Frequent n-grams of several rows over common units; ``n`` of paths of one and two words."""

    def __init__(self, table: pa.Table):
        self.units, number, unit_at = _units(table)
        paths, self.at = _flat(table, "n")
        self.n = paths.astype(np.int64)
        self.longer = _flat(table, "longer")[0].astype(np.int64)
        self.row = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self.a, self.b, self.c = (self._path(_flat(table, name)[0].astype(np.int64), number, unit_at) for name in "abc")
        self.kind = table.column("kind").to_numpy()
        self.source = table.column("source").to_numpy()

    def _path(self, values: np.ndarray, number: np.ndarray, unit_at: np.ndarray) -> np.ndarray:
        out = np.full(len(values), -1, dtype=np.int64)
        some = values >= 0
        out[some] = number[values[some] + unit_at[self.row[some]]]
        return out

    def compose(self, holding: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow paths of one (``second`` -1) or two words through the paths ``holding``: weight and place of each, -1 if none."""
        weight, place = np.full(len(first), -1, dtype=np.int64), np.full(len(first), -1, dtype=np.int64)
        one = holding[(self.b[holding] < 0)]
        at = np.full(len(self.units) + 1, -1, dtype=np.int64)
        at[self.a[one]] = one
        short = second < 0
        place[short] = at[first[short]]
        two = holding[(self.b[holding] >= 0) & (self.c[holding] < 0)]
        keys = self.a[two] << 32 | self.b[two]
        order = np.argsort(keys)
        wanted = first[~short] << 32 | second[~short]
        if len(keys) and len(wanted):
            found = order[np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)]
            place[~short] = np.where(keys[found] == wanted, two[found], -1)
        hit = place >= 0
        weight[hit] = self.n[place[hit]]
        return weight, place


def answer(key, table: pa.Table) -> pa.Table:
    """What other ranges asked a range for, and its own table, which then knows the most frequent longer phrase of each pair."""
    (own,) = (k.as_py() for k in key)
    held = Automaton(table)
    mine = np.flatnonzero(held.kind[held.row] == TABLE)
    asked = np.flatnonzero(held.kind[held.row] == ASK)
    weight, place = held.compose(mine, held.a[asked], held.b[asked])
    if (weight < 0).any():
        raise RuntimeError("a part of a frequent phrase is not in its range")
    np.maximum.at(held.longer, place, held.longer[asked])
    rows = [_row(own, TABLE, own, held.units, held.a[mine], held.b[mine], held.c[mine], held.n[mine], held.longer[mine])]
    begin = np.flatnonzero(np.diff(held.row[asked], prepend=-1))
    for part in np.split(np.arange(len(asked)), begin[1:]) if len(asked) else []:
        at = asked[part]
        rows.append(_row(int(held.source[held.row[at[0]]]), ANSWER, own, held.units, held.a[at], held.b[at], held.c[at], weight[part], held.longer[at]))
    return _rows(rows)


def scores(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """floor(1,000,000 a^2 / (left right)), exactly."""
    if not len(a):
        return a
    if 10**6 * int(a.max()) ** 2 < 1 << 62 and int(left.max()) * int(right.max()) < 1 << 62:
        return 10**6 * a * a // (left * right)
    return np.array([10**6 * x * x // (y * z) for x, y, z in zip(a.tolist(), left.tolist(), right.tolist())], dtype=np.int64)


PHRASES = "range long, lang string, phrase string, a long, l long, r long, score long"


def candidates(key, table: pa.Table, share: int, top: int) -> pa.Table:
    """The phrases of a range with their parts' counts and scores, at most ``top`` of each language.

    Phrases inside a longer one that occurs ``share`` hundredths as often are left out.
    """
    (own,) = (k.as_py() for k in key)
    held = Automaton(table)
    every = np.arange(len(held.a))
    known = every[held.kind[held.row] == ANSWER]
    mine = every[held.kind[held.row] == TABLE]
    pair = mine[(held.b[mine] >= 0) & (held.c[mine] < 0)]
    triple = mine[held.c[mine] >= 0]
    nothing = lambda x: np.full(len(x), -1, dtype=np.int64)
    pair = pair[100 * held.longer[pair] < share * held.n[pair]]
    left, right = held.compose(known, held.a[pair], nothing(pair))[0], held.compose(known, held.b[pair], nothing(pair))[0]
    first = (held.compose(known, held.a[triple], nothing(triple))[0], held.compose(known, held.b[triple], held.c[triple])[0])
    second = (held.compose(mine, held.a[triple], held.b[triple])[0], held.compose(known, held.c[triple], nothing(triple))[0])
    n = held.n[triple]
    one, two = scores(n, *first), scores(n, *second)
    other = two < one
    at = np.concatenate([pair, triple])
    a = held.n[at]
    l_, r_ = (np.concatenate([x, np.where(other, z, y)]) for x, y, z in zip((left, right), first, second))
    value = np.concatenate([scores(held.n[pair], left, right), np.where(other, two, one)])
    names = [u.rpartition(b"\t") for u in held.units.to_pylist()]
    rows = []
    for i, x, y, z in zip(range(len(at)), held.a[at].tolist(), held.b[at].tolist(), held.c[at].tolist()):
        words = [names[w][2] for w in (x, y, z) if w >= 0]
        rows.append((names[x][0], -int(value[i]), -int(a[i]), b" ".join(words), i))
    rows.sort()
    kept, count = [], {}
    for row in rows:
        count[row[0]] = count.get(row[0], 0) + 1
        if count[row[0]] <= top:
            kept.append(row)
    order = np.array([row[4] for row in kept], dtype=np.int64)
    return pa.Table.from_arrays(
        [
            pa.array(np.full(len(kept), own), pa.int64()), pa.array([row[0].decode("utf-8") for row in kept], pa.string()),
            pa.array([row[3].decode("utf-8") for row in kept], pa.string()), *[pa.array(x[order], pa.int64()) for x in (a, l_, r_, value)],
        ],
        names=[part.split()[0] for part in PHRASES.split(", ")],
    )


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, share: int = 50, top: int = 2000, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ``top`` collocations of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts in lower case (A-Z) are cut at ``.,;:!?`` and line ends into pieces, and these at blanks and tabs into words.
    Phrases are two or three neighbouring words of a piece that occur ``a`` >= ``least`` times; ``l`` and ``r`` are the
    counts of the parts before and after the cut with the lowest score floor(1,000,000 a^2 / (l r)), the first one of equal
    ones; ``n`` is the number of words of the language. A phrase inside a longer one that occurs at least ``share``
    hundredths as often is left out. Rows are ranked by score, then ``a``, then the phrase's bytes.

    A null language is ``und``; a null or empty text has no words; repeated rows count each; an empty table gives no
    rows; other columns are left out. All n-grams of all texts are counted. The number of ranges follows the bytes
    of text, so a task unites about the n-grams of ``range_bytes`` whatever the table's size.
    """
    ship_package(df.sparkSession)
    source = df.select(
        F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")
    )
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(size / range_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(ranges)
        for batch in batches:
            for start, stop in slices(batch.column(1), _SLICE):
                part = batch.slice(start, stop - start)
                shard.add(part.column(0).to_pylist(), part.column(1))
                if shard.size >= SHARD_WORDS:
                    yield from shard.flush()
        yield from shard.flush()
        release()

    shards = source.mapInArrow(run, SHARD)
    often = stage(shards.groupBy("range").applyInArrow(lambda key, table: frequent(key, table, least, ranges), PATHS))
    answered = often.where(F.col("kind") != TOTAL).groupBy("range").applyInArrow(lambda key, table: answer(key, table), PATHS)
    found = answered.groupBy("range").applyInArrow(lambda key, table: candidates(key, table, share, top), PHRASES)
    # The best of all ranges in two rounds: no task sees more than some square root of the ranges' rows.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.col("range"), F.lit(math.isqrt(ranges - 1) + 1))
    best = found.withColumn("__rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).where(F.col("__rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = often.where(F.col("kind") == TOTAL).select(F.explode(F.arrays_zip("units", "n")).alias("t"))
    totals = totals.groupBy(F.decode(F.col("t.units"), "UTF-8").alias("lang")).agg(F.sum("t.n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
