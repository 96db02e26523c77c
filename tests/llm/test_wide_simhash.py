"""Near-duplicates of a similarity against comparing all pairs, and recall by band."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, make_texts, with_clashes
from pyspark.sql import functions as F

from vitrine.llm import wide_simhash as S


def jaccard(a, b):
    left, right = S.shingles(a, 5), S.shingles(b, 5)
    both = len(left & right)
    return 1.0 if not left and not right else both / max(1, len(left | right))


def reach(texts):
    """Smallest id that links of 0.8 reach, by comparing all pairs."""
    least = {i: i for i in texts}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if jaccard(texts[i] or "", texts[j] or "") >= 0.8:
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"ins{rng.randrange(10**6)}")
        elif len(words) > 6:
            del words[at]
    return words


def test_recall_by_similarity_band(spark):
    """Texts of 12 to 1500 words with an edited copy each: nine of ten pairs of every band from 0.8 up are found."""
    rng = random.Random(12)
    pairs, texts = defaultdict(list), {}
    while min(len(pairs[b]) for b in range(80, 100, 5)) < 60:
        n = int(12 * 125 ** rng.random())
        words = [f"w{rng.randrange(4000)}" for _ in range(n)]
        other = edited(rng, words, max(1, int(n * rng.choice([0.002, 0.006, 0.012, 0.018, 0.024]))))
        a, b = " ".join(words), " ".join(other)
        s = jaccard(a, b)
        band = min(95, int(s * 20) * 5)
        if s < 0.8 or s == 1 or len(pairs[band]) >= 120:
            continue
        i = len(texts)
        texts[i], texts[i + 1] = a, b
        pairs[band].append(i)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in S.similar_groups(df).collect()}
    recall = {band: round(sum(got[i] == got[i + 1] for i in ids) / len(ids), 3) for band, ids in sorted(pairs.items())}
    print(recall)
    assert all(r >= 0.9 for r in recall.values())
    assert all(got[i] in (i, i - i % 2) for i in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_all_pairs(spark, seed):
    """Groups of copies, near copies and chains of them; the search is not exact, these texts share enough parts."""
    rng = random.Random(seed)
    texts = {}
    for _ in range(12):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 8)):
            texts[len(texts)] = " ".join(words)
            if rng.random() < 0.7:
                words = edited(rng, words, 1)
    for t in make_texts(20, seed):
        texts[len(texts)] = t
    for t in (None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d E", "x " * 900, "x " * 901):
        texts[len(texts)] = t
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in S.similar_groups(df).collect()} == reach(texts)


def test_one_shared_part_links_nothing(spark):
    """Many texts that share a passage but are not similar stay apart, and pairs among them are found."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in S.similar_groups(df).collect()}
    assert all(got[i] == i and got[1000 + i] in (i, 1000 + i) for i in range(150))
    assert sum(got[1000 + i] == i for i in range(150)) >= 140


def test_a_text_compared_with_many_has_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_OF_COPY", 4)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[: i % 100], f"x{i}", *words[i % 100 :]])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in S.similar_groups(df).collect()} == {0}


def test_representatives_of_odd_rows(spark):
    df = with_clashes(documents(spark), "same", "parts", "node", "a", "b", "level", "component_id_")
    left = S.representatives(df)
    assert left.columns == df.columns
    rows, kept = df.collect(), left.collect()
    want = reach({r.doc_id: r.text for r in rows if r.doc_id is not None})
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({i for i, c in want.items() if i == c})
    assert sum(r.doc_id is None for r in kept) == 1
    assert S.representatives(df.limit(0)).count() == 0


def test_shingles_of_short_and_repeating_texts():
    texts = pa.array(["a b c", "", "a b c d e f", "x x x x x x x x", "A  B\tC"])
    owner, value = S.shingle_hashes(texts, 5)
    assert np.bincount(owner, minlength=5).tolist() == [1, 0, 2, 1, 1]
    assert value[owner == 0] == value[owner == 4]


def test_covering_masks_of_whole_texts_take_part(spark, monkeypatch):
    """Near copies within the radius are found by the SimHash of the whole text, also without any part in common."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(200))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(60)]
    prints = {i: S.simhash.fingerprint(t.encode(), 5) for i, t in rows}
    near = [i for i in range(60) if ((prints[i] ^ prints[100 + i]) & (2**64 - 1)).bit_count() <= S.simhash.LARGEST_RADIUS]
    assert len(near) >= 30
    sketches = S.sketches
    monkeypatch.setattr(S, "sketches", lambda *args: sketches(*args).withColumn("parts", F.slice("parts", 1, 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in S.similar_groups(df).collect()}
    assert all(got[100 + i] == i for i in near)
    assert all(got[i] == i and got[100 + i] in (i, 100 + i) for i in range(60))


@pytest.mark.parametrize("piece", [512, 7])
def test_others_of_a_crowded_bucket_are_compared(spark, monkeypatch, piece):
    """All texts share their only part, and no two SimHashes meet: links between others than the smallest one stay."""
    rng = random.Random(8)
    monkeypatch.setattr(S, "PIECE", piece)
    texts = {}
    for i in range(30):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(40, 120))]
        texts[i] = " ".join(words)
        texts[100 + i] = " ".join(words[len(words) // 8 :])
        # Like the second one, but not like the first.
        texts[200 + i] = " ".join([texts[100 + i], *(f"v{rng.randrange(9000)}" for _ in range(len(words) // 8))])
    assert any(jaccard(texts[i], texts[200 + i]) < 0.8 <= jaccard(texts[100 + i], texts[200 + i]) for i in range(30))
    texts |= {300 + i: " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for i in range(20)}
    sketches = S.sketches
    one = F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("part"), F.lit(7).cast("long").alias("print")))
    monkeypatch.setattr(S, "sketches", lambda *args: sketches(*args).withColumn("parts", one).withColumn("whole", F.xxhash64("node")))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in S.similar_groups(df).collect()} == reach(texts)
