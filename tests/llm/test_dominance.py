"""Packing by dominance reduction against exhaustive search and best fit piece by piece."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vitrine.llm import dominance, registered

WORDS = public_tokenizers.path("word_bpe_49k.json")


def fewest(pieces, capacity):
    """The least number of sequences, by trying everything."""

    @lru_cache(maxsize=None)
    def search(left):
        if not left:
            return 0
        longest, rest = left[-1], left[:-1]
        best = 1 + search(rest)
        stack = [(capacity - longest, 0, ())]
        while stack:
            room, at, chosen = stack.pop()
            last = None
            for i in range(at, len(rest)):
                if rest[i] <= room and rest[i] != last:
                    last = rest[i]
                    taken = (*chosen, i)
                    best = min(best, 1 + search(tuple(x for k, x in enumerate(rest) if k not in taken)))
                    stack.append((room - rest[i], i + 1, taken))
        return best

    return search(tuple(sorted(pieces)))


def plain_best_fit(pieces, capacity):
    rooms = []
    for size in sorted(pieces, reverse=True):
        fitting = [r for r in rooms if r >= size]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - size)
        else:
            rooms.append(capacity - size)
    return rooms


@settings(max_examples=250, deadline=None)
@given(st.integers(6, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_reduction_keeps_a_best_packing(case):
    capacity, pieces = case
    fixed, left = dominance.reduce(Counter(pieces), capacity)
    taken = Counter(size for chosen, n in fixed for size in chosen * n)
    assert taken + Counter(left) == Counter(pieces)
    assert all(sum(chosen) <= capacity for chosen, _ in fixed)
    assert fewest(pieces, capacity) == sum(n for _, n in fixed) + fewest(list(Counter(left).elements()), capacity)


def test_three_piece_sets_are_fixed_in_rows():
    """Pieces of a third of the room: sets of three are proven, alone and many at once."""
    rng = random.Random(2)
    triples = 0
    for _ in range(400):
        capacity = rng.randint(30, 60)
        pieces = [rng.randint(capacity // 4 + 1, capacity // 2) for _ in range(rng.randint(3, 9))]
        fixed, left = dominance.reduce(Counter(pieces), capacity)
        triples += sum(len(chosen) == 3 for chosen, _ in fixed)
        assert fewest(pieces, capacity) == sum(n for _, n in fixed) + fewest(list(Counter(left).elements()), capacity)
    assert triples > 50


@settings(max_examples=150, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_best_fit_equals_piece_by_piece(case):
    capacity, pieces = case
    packed = dominance.best_fit(Counter(pieces), capacity)
    rooms = [capacity - sum(s * k for s, k in content) for content, n in packed for _ in range(n)]
    assert sorted(rooms) == sorted(plain_best_fit(pieces, capacity))
    assert Counter(s for content, n in packed for s, k in content for _ in range(k * n)) == Counter(pieces)


@settings(max_examples=100, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=200))))
def test_plan_places_every_piece_once(case):
    capacity, pieces = case
    counts = Counter(pieces)
    plan = dominance.make_plan(counts, capacity)
    filled = defaultdict(list)
    for size, first, last, sequence, copies, offset in plan.rows:
        for n in range(first, last):
            filled[sequence + (n - first) // copies].append((offset + (n - first) % copies * size, size))
    assert Counter(size for row in filled.values() for _, size in row) == counts
    assert sorted(filled) == list(range(plan.sequences))
    for row in filled.values():
        row.sort()
        assert [at for at, _ in row] == np.cumsum([0, *[s for _, s in row[:-1]]]).tolist()
        assert sum(s for _, s in row) <= capacity
    assert plan.sequences <= len(plain_best_fit(pieces, capacity))


def test_large_counts_cost_no_more():
    counts = {size: 10**9 + size for size in range(1, 2049)}
    plan = dominance.make_plan(counts, 2048)
    total = sum(size * n for size, n in counts.items())
    assert plan.sequences <= -(-total // 2048) * 1.0001
    assert len(plan.rows) < 20 * 2048


def check(rows, texts, max_tokens):
    """Pieces are the documents' ids in order, sequences have no gaps; gives the sequences."""
    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length
        pieces[r.doc_id].append((r.start, r.piece, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc_id] += [(at, at // max_tokens, ids[at : at + max_tokens]) for at in range(0, len(ids), max_tokens)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for held in sequences.values():
        held.sort()
        assert [at for at, _ in held] == np.cumsum([0, *[n for _, n in held[:-1]]]).tolist()
        assert sum(n for _, n in held) <= max_tokens
    lengths = [len(ids) for held in want.values() for _, _, ids in held]
    assert len(sequences) <= len(plain_best_fit(lengths, max_tokens))
    return sequences


@pytest.mark.parametrize("max_tokens", [1, 7, 64, 2048])
def test_packing_of_odd_rows(spark, max_tokens):
    df = with_clashes(documents(spark), "piece", "Offset", "__lane", "__rank", "__first")
    rows = dominance.pack_whole(df, WORDS, max_tokens=max_tokens).collect()
    check(rows, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], max_tokens)


def test_other_id_columns_and_empty_table(spark):
    df = documents(spark)
    named = dominance.pack_whole(df.select(df.source.alias("a b"), df.text.alias("t.x")), WORDS, "a b", "t.x")
    assert named.columns[0] == "a b" and named.count() >= df.count()
    assert dominance.pack_whole(df.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError, match="named"):
        dominance.pack_whole(df.withColumnRenamed("doc_id", "Offset"), WORDS, "Offset")


def test_query_of_the_table(spark, sf_dir):
    got = registered.op12_best_fit_packing(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = dominance.pack_whole(df, WORDS).collect()
    sequences = check(rows, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 2048)
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) * 1.02 + 1
    crc = {(r.doc_id, r.piece): (zlib.crc32(r.ids), r.sequence_id) for r in rows}
    assert {(r.doc_id, r.piece): (r.ids_crc32, crc[r.doc_id, r.piece][1]) for r in got.collect()} == crc
