"""Collocations against counting every phrase in a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, with_clashes

from vitrine.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, share=50, top=2000):
    """rows: (lang, text)."""
    lower = {c: c + 32 for c in range(65, 91)}
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        chosen = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        kept = []
        for p, a in chosen.items():
            inside = [n for q, n in chosen.items() if len(q) > len(p) and (q[:2] == p or q[1:] == p)]
            if any(100 * n >= share * a for n in inside):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        kept.sort()
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(kept[:top])]
    return sorted(out)


def found(df, **options):
    out = phrases.collocations(df, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def noisy(n, seed):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(30)] + ["the", "of", "Æon", "日本", "x\x1cy", "it's"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for i in range(n):
        text = "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "\x85"]) for _ in range(rng.randint(0, 60)))
        out.append((i, text + "new york city " * rng.randint(0, 3), rng.choice(["en", "en", "fr", None, "und", "l\tx"]), "s", 0))
    return out


@pytest.mark.parametrize("range_bytes", [1 << 23, 700])
@pytest.mark.parametrize("options", [{"least": 2}, {"least": 3, "share": 80, "top": 7}, {}])
def test_equals_counting(spark, options, range_bytes):
    rows = noisy(150, 5)
    rows += rows[:3] + [(999, None, None, None, None), (None, "", "en", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute([(r[2], r[1]) for r in rows], options.get("least", 10), options.get("share", 50), options.get("top", 2000))
    assert found(df, range_bytes=range_bytes, **options) == want


def test_odd_rows_in_small_shards(spark, monkeypatch):
    """Each text its own shard, so that all counts are sums over shards."""
    df = with_clashes(documents(spark), "range", "kind", "n", "units", "rank")
    monkeypatch.setattr(phrases, "SHARD_WORDS", 1)
    monkeypatch.setattr(phrases, "_SLICE", 1)
    rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
    assert found(df, least=4, range_bytes=3000) == brute(rows, 4)


def test_one_word_and_one_phrase_everywhere(spark):
    """A word and a pair that stand in every text, many times in one."""
    rows = [(i, f"hot spot a{i % 7} hot spot b{i % 5} " * (400 if i == 3 else 2), "en", "s", 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(df, range_bytes=500) == brute([(r[2], r[1]) for r in rows], 10)


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([("go go go go", 1)] * 9 + [(None, 2)], "`a.b` string, l int")
    assert found(df, text_col="a.b", lang_col="l", least=9) == brute([(str(r.l), r["a.b"]) for r in df.collect()], 9)
    assert found(df.limit(0), text_col="a.b", lang_col="l") == []
    assert found(df.where("l = 2"), text_col="a.b", lang_col="l") == []


def test_scores_are_exact():
    big = np.array([3 * 10**11 + 7, 5], dtype=np.int64)
    left, right = big * 7 + 1, big * 11 + 3
    want = [10**6 * a * a // (x * y) for a, x, y in zip(big.tolist(), left.tolist(), right.tolist())]
    assert phrases.scores(big, left, right).tolist() == want
    assert phrases.scores(big[1:], left[1:], right[1:]).tolist() == want[1:]


def _paths(batches):
    """All paths of a shard's transducers with their weights."""
    out = Counter()
    for row in (r for b in batches for r in b.to_pylist()):
        held = {k: phrases.unpack(v).tolist() for k, v in row.items() if k not in ("range", "units")}
        at = np.concatenate([[0], np.cumsum(held["unit_size"])]).tolist()
        unit = [row["units"][x:y] for x, y in zip(at, at[1:])]
        starts = np.concatenate([[0], np.cumsum(held["state_size"])]).astype(int)
        for a, n in zip(np.cumsum(held["one"]), held["one_n"]):
            out[(unit[a],)] += n
        for a, b, n, state in zip(np.cumsum(held["two_a"]).astype(int), held["two_b"], held["two_n"], held["two_state"]):
            out[unit[a], unit[b]] += n
            for at in range(starts[state - 1], starts[state]) if state else ():
                out[unit[a], unit[b], unit[held["state_label"][at]]] += held["state_n"][at]
    return out


@pytest.mark.parametrize("ranges", [1, 5, 1000])
def test_transducers_hold_all_counts_in_few_states(ranges):
    rng = random.Random(ranges)
    ids = np.array([rng.choice([0, 0, 1, 2, 3, 4, rng.randrange(12)]) for _ in range(3000)])
    joined = np.array([i > 0 and rng.random() < 0.9 for i in range(3000)])
    units = [f"en\tw{i}".encode() for i in range(12)]
    batches = list(phrases.transducers(units, ids, joined, ranges))
    want = Counter()
    for i in range(3000):
        for size in (1, 2, 3):
            if i + size <= 3000 and all(joined[i + 1 : i + size]):
                want[tuple(units[x] for x in ids[i : i + size])] += 1
    assert _paths(batches) == want
    row = batches[0].slice(0, 1)
    united = phrases.unite(pa.Table.from_batches([row, row]))
    first = _paths([row])
    names = united[0].to_pylist()
    pairs = united[2][0]
    got = Counter({(names[w],): n for w, n in zip(*map(np.ndarray.tolist, united[1]))})
    got += Counter({(names[p >> 32], names[p & 0xFFFFFFFF]): n for p, n in zip(*map(np.ndarray.tolist, united[2]))})
    got += Counter({(names[pairs[t >> 32] >> 32], names[pairs[t >> 32] & 0xFFFFFFFF], names[t & 0xFFFFFFFF]): n for t, n in zip(*map(np.ndarray.tolist, united[3]))})
    assert got == Counter({k: 2 * n for k, n in first.items()})


def test_equal_states_are_one(monkeypatch):
    sizes = np.array([1, 2, 1, 2, 1])
    labels, n = np.array([4, 1, 2, 4, 1, 2, 4]), np.array([1, 1, 3, 1, 1, 3, 2])
    state, kept = phrases.register(sizes, labels, n)
    assert state[0] == state[2] and state[1] == state[3] and len(kept) == 3
    monkeypatch.setattr(phrases, "_mix", lambda x: np.zeros_like(x))
    state, kept = phrases.register(sizes, labels, n)
    assert len({tuple(state.tolist())[i] for i in (0, 1, 4)}) == 3
