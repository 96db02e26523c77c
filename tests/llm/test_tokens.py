"""Operators on token sequences against the tokenizer library and greedy matching."""

import gc
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import ODD, documents, make_texts, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vitrine.llm import bpe, packing, wordpiece
from vitrine.llm.word_tokens import WordTokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BYTE_LIBRARY, WORD_LIBRARY = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
MODEL = bpe.BpeModel(open(BYTES, encoding="utf-8").read())
ENCODE, DECODE = bpe.Encoder(MODEL), bpe.Decoder(MODEL)
WORD_TOKENS = WordTokens(open(WORDS, encoding="utf-8").read())
TEXT = st.text(alphabet=st.sampled_from(list("abcdeTHE '\n\t.,!?12²éßñ×  日<|>")) | st.characters(codec="utf-8"), max_size=60)


def _split(values, offsets):
    return [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_byte_ids_equal_the_library(texts):
    ids, offsets = ENCODE(pa.array(texts))
    want = [e.ids for e in BYTE_LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert _split(ids, offsets) == want
    assert DECODE(ids, offsets) == [BYTE_LIBRARY.decode(i, skip_special_tokens=False) for i in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_word_ids_equal_the_library(texts):
    ids, offsets = WORD_TOKENS(pa.array(texts))
    assert _split(ids, offsets) == [e.ids for e in WORD_LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_pair_index_handles_overlaps_and_long_pieces():
    rng = random.Random(1)
    pieces = [b"aaaaaaa", b"", b" the", bytes(rng.choice(b"aeth ") for _ in range(3000))]
    for piece, ids in zip(pieces, bpe.apply_merges(MODEL, pieces)):
        assert b"".join(MODEL.pieces[i] for i in ids) == piece
    texts = ["a" * n for n in range(1, 40)]
    assert bpe.apply_merges(MODEL, [t.encode() for t in texts]) == [e.ids for e in BYTE_LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_encode_decode_of_odd_rows(spark):
    df = with_clashes(documents(spark), "ids", "Decoded")
    out = bpe.encode_decode(df, BYTES).collect()
    assert len(out) == df.count()
    for row in out:
        text = row.text or ""
        ids = BYTE_LIBRARY.encode(text, add_special_tokens=False).ids
        assert row.ids == ids and row.decoded == BYTE_LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(df.limit(0), BYTES).count() == 0


def _greedy(word, pieces):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return wordpiece.UNKNOWN
        n, i = n + 1, j
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=15), st.binary(max_size=20))
def test_automaton_counts_as_greedy_matching(pieces, raw):
    word = bytes(97 + x % 3 for x in raw)
    assert wordpiece.Automaton(pieces).count(word) == _greedy(word, set(pieces))


def test_piece_counts_of_odd_rows(spark):
    df = with_clashes(documents(spark), "n_words", "n_tokens")
    pieces = [p for p in MODEL.pieces if b"\xe6" not in p]  # leaves some words without pieces
    out = wordpiece.count_pieces(df, pieces).collect()
    held = set(pieces)
    assert len(out) == df.count()
    for row in out:
        counts = [_greedy(b" " + w, held) for w in (row.text or "").encode().split()] if len(row.text or "") < 4000 else None
        if counts is not None:
            assert (row.n_words, row.n_tokens, row.n_unknown) == (len(counts), sum(max(c, 1) for c in counts), counts.count(-1))
    assert any(r.n_unknown for r in out)
    assert wordpiece.count_pieces(df.limit(0), pieces).count() == 0


def _check_packing(rows, want, tokens=2048, segments=64, loss=None):
    """want: multiset of id lists by document id."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 > 0
    for some in sequences.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == [sum(x.length for x in some[:i]) for i in range(len(some))]
        total = sum(r.length for r in some)
        assert total <= tokens and len(some) <= segments and all(r.padded_length == total for r in some)
        assert total == tokens or total & (total - 1) == 0
        assert loss is None or sum(r.loss_tokens for r in some) <= loss
    for doc, lists in want.items():
        got = sorted((r.start, r.length, zlib.crc32(bytes(r.ids)), r.doc_tokens) for r in pieces.pop(doc))
        if len(lists) > 1:  # repeated rows may be cut in different places
            assert sum(x[1] for x in got) == sum(map(len, lists))
            continue
        ids = np.array(lists[0], dtype="<u4")
        at = 0
        for start, length, crc, size in got:
            assert start == at and size == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert not pieces


def _word_ids(rows):
    want = {}
    for r in rows:
        want.setdefault(r.doc_id, []).append(WORD_LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [1])
    return want


def test_packing_holds_every_id_once(spark):
    df = with_clashes(documents(spark), "start", "ids")
    _check_packing(packing.pack_documents(df, WORDS).collect(), _word_ids(df.collect()))
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, WORDS, id_col="start")


def test_packing_under_all_limits(spark):
    df = documents(spark)
    rows = packing.pack_documents(df, WORDS, max_tokens=64, max_segments=3, max_loss=40).collect()
    _check_packing(rows, _word_ids(df.collect()), 64, 3, 40)


def test_prompts_bear_no_loss(spark):
    texts = make_texts(40)
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(zip(texts, reversed(texts)))], "doc_id long, prompt string, text string")
    rows = packing.pack_documents(df, WORDS, prompt_col="prompt", max_tokens=128, max_segments=4, max_loss=50).collect()
    prompts = [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    answers = [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in reversed(texts)]
    _check_packing(rows, {i: [p + a + [1]] for i, (p, a) in enumerate(zip(prompts, answers))}, 128, 4, 50)
    assert sum(r.loss_tokens for r in rows) == sum(len(a) + 1 for a in answers)


def test_packing_pads_nothing_and_fills_most_sequences(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(make_texts(400))], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(df, WORDS).collect()
    full = {r.sequence_id for r in rows if r.padded_length == 2048}
    assert sum(r.length for r in rows if r.sequence_id in full) > 0.95 * sum(r.length for r in rows)


def test_coding_a_batch_takes_little_memory():
    """Scratch space follows the bytes that are coded at once, not the batch."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(2400)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tokens = WordTokens(open(WORDS, encoding="utf-8").read())
    gc.collect()
    tracemalloc.start()
    try:
        found = sum(len(ids) for _, coded in packing.coded_parts(batch, tokens) for ids, _ in coded)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found > 400 * len(texts)
    assert peak < 64 << 20


def test_odd_texts_by_word_ids():
    texts = [t or "" for t in ODD]
    ids, offsets = WORD_TOKENS(pa.array(texts))
    assert _split(ids, offsets) == [e.ids for e in WORD_LIBRARY.encode_batch(texts, add_special_tokens=False)]
