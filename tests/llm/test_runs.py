"""Periodic runs against comparing all words at all lags."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.llm import registered, runs, units


def brute(words, least=12):
    """Every run by trying all periods, the smallest of each stretch."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def by_start_and_period(rows):
    return sorted(rows, key=lambda r: (r[0], r[2]))


def check(texts):
    words = np.concatenate([np.array(t, dtype=np.int64) for t in texts]) if texts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = runs.find_runs(words, offsets)
    want = []
    for t, at in zip(texts, offsets.tolist()):
        want += by_start_and_period((s + at, length, q) for s, length, q in brute(t))
    assert [tuple(r) for r in got.tolist()] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=4))
def test_small_alphabets(texts):
    check(texts)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_planted_periods(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(3):
        text = []
        while len(text) < 300:
            kind = rng.randrange(4)
            size = rng.choice([1, 2, 3, 5, 16, 17, 31, 40, 64])
            part = [rng.randrange(rng.choice([1, 2, 50])) for _ in range(size)]
            if kind == 0:
                text += part
            elif kind == 1:
                text += part * rng.randint(1, 6)
            elif kind == 2:  # runs inside runs
                inner = part[:5] * rng.randint(1, 5) + [99]
                text += inner * rng.randint(1, 4)
            else:
                text += text[-rng.randint(1, 130) :]
        texts.append(text[:400])
    check(texts)


def test_known_words():
    fib = [0]
    other = [0, 1]
    while len(other) < 600:
        fib, other = other, other + fib
    thue = [bin(i).count("1") % 2 for i in range(700)]
    check([fib, other, thue, [0] * 500, [0, 1] * 300, ([0] * 60 + [1]) * 9, ([0] * 40 + [1] + [0] * 41 + [2]) * 5, [], [5]])


def test_pairs_stay_few_in_short_periods():
    for text in ([0] * 20000, ([0] * 700 + [1]) * 28, [0, 1, 2] * 6000):
        words = np.array(text)
        hashes = runs._mixed(words)
        gram = 1
        while gram < 512:
            hashes[: len(hashes) - gram], gram = runs._joined(hashes[: len(hashes) - gram], hashes[gram:]), 2 * gram
        places = runs.minimizers(hashes[: len(words) - 511], 513)
        total = sum(len(x) for x, _ in runs.seed_pairs(places, hashes[places], 1024))
        assert total <= 16 * len(words)


def test_equal_hashes_are_checked_by_words(monkeypatch):
    rng = random.Random(4)
    text = [rng.randrange(9) for _ in range(40)] * 3 + [rng.randrange(9) for _ in range(90)]
    monkeypatch.setattr(runs, "_PRIMES", ((3, 2), (5, 2)))
    words = np.array(text)
    got = runs.find_runs(words, np.array([0, len(text)]))
    assert [tuple(r) for r in got.tolist()] == by_start_and_period(brute(text))


def test_units_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(units, "_hashes", lambda data, starts, lengths: np.zeros(len(starts), dtype=np.uint64))
    data, offsets = units.text_bytes(pa.array(["aa b aa", "b cc", "", " ab "]))
    data, starts, lengths = units.cut_words(data, offsets)
    words = [data[s : s + n].tobytes() for s, n in zip(starts, lengths)]
    first, inverse = units.distinct(data, starts, lengths)
    assert words == [b"aa", b"b", b"aa", b"b", b"cc", b"ab"]
    assert [words[first[i]] for i in inverse] == words and len(first) == 4


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def digest_row(doc_id, words):
    found = by_start_and_period(brute(words))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(listed), sha(kept))


def edited(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


@pytest.mark.parametrize("kind", ["odd", "table"])
def test_query_equals_brute_force(spark, sf_dir, tmp_path, kind):
    if kind == "odd":
        df = documents(spark)
        texts = [("unary " * 900, 7000), ("\n".join(["one line of the page"] * 80), 7001)]
        df = df.unionByName(spark.createDataFrame([(i, t, None, None, None) for t, i in texts], df.schema))
        df.write.parquet(str(tmp_path / "documents.parquet"))
        folder = str(tmp_path)
    else:
        folder = sf_dir
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [r for r in df.select("doc_id", "text").collect() if len(split(r.text or "")) < 1000]
    want = sorted(
        (digest_row(r.doc_id, split(r.text or "") if r.doc_id is None else edited(r.doc_id, split(r.text or ""))) for r in rows), key=repr
    )
    ids = {r.doc_id for r in rows}
    got = registered.op11_periodic_runs(spark, folder)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == columns
    assert sorted((tuple(r) for r in got.collect() if r.doc_id in ids), key=repr) == want
    assert got.count() == df.count()


def test_clashing_columns_and_empty_table(spark):
    df = with_clashes(documents(spark), "runs", "Collapsed", "__llm_text")
    out = runs.with_runs(df)
    assert out.count() == df.count() and "__llm_text" in out.columns
    assert runs.with_runs(df.limit(0)).count() == 0
