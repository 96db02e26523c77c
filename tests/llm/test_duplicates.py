"""Duplicate and fingerprint operators against brute force."""

import hashlib
import random
from pathlib import Path
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, documents, make_texts, rows, with_clashes, xx

from vitrine.llm import line_chunks, simhash, stream_dedup, winnow
from vitrine.llm.components import components


def _near_groups(prints, radius):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def _simhash(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = Counter(b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))
    n = sum(parts.values())
    hashes = {p: xx(p.decode()) % (1 << 64) for p in parts}
    return sum(1 << b for b in range(64) if 2 * sum(c for p, c in parts.items() if hashes[p] >> b & 1) > n)


def test_masks_cover_the_radius():
    rng = random.Random(1)
    for radius in (1, 2, 3):
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not flips & m for m in simhash.masks(radius))


def test_simhash_groups(spark, monkeypatch):
    df = with_clashes(documents(spark), "fingerprint", "component_id")
    texts = {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}
    prints = {i: _simhash(t, 3) for i, t in texts.items()}
    for radius, bucket in ((2, 1024), (3, 1024)):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        want = _near_groups(prints, radius)
        out = simhash.near_duplicates(df, radius=radius).collect()
        assert len(out) == df.count()
        assert {r.doc_id: r.fingerprint % (1 << 64) for r in out if r.doc_id is not None} == prints
        assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_link_the_same(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {i: centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for i in range(150)}
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    df = spark.createDataFrame(signed, "doc_id long, fingerprint long")
    want = _near_groups(prints, 2)
    for bucket in (1024, 3):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        groups = df.join(simhash.near_groups(df, "doc_id", 2), "fingerprint")
        assert {r.doc_id: r.component_id for r in groups.collect()} == want


def test_representatives(spark):
    df = documents(spark)
    out = simhash.representatives(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sorted(i for i in ids if i is not None) == sorted({c for c in groups.values() if c is not None})
    assert ids.count(None) == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(2).shuffle(links)
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bucket_links_keep_connectivity():
    values = np.array([0, 3, 15, 31 << 40, 63, (31 << 40) | 1], dtype=np.int64)
    assert simhash.bucket_links(values, 2).tolist() == [0, 0, 0, 3, 0, 3]


def _marks(text):
    words = []
    for run in (text or "").split():  # these texts have no other white space than the pattern's
        part = ""
        for c in run:
            if "⺀" <= c <= "퟿" or "豈" <= c <= "﫿":
                words += [part] if part else []
                words.append(c)
                part = ""
            else:
                part += c
                if len(part) == 32:
                    words.append(part)
                    part = ""
        words += [part] if part else []
    digits = [xx(w) % winnow.PRIME for w in words]
    grams = []
    for i in range(max(1, len(digits) - winnow.GRAM + 1) if digits else 0):
        h = 0
        for d in digits[i : i + winnow.GRAM]:
            h = (h * winnow.BASE + d) % winnow.PRIME
        grams.append(h)
    kept = set()
    for i in range(max(1, len(grams) - winnow.WINDOW + 1) if grams else 0):
        window = range(i, min(i + winnow.WINDOW, len(grams)))
        best = min(window, key=lambda j: (grams[j], -j))
        kept.add((grams[best], best))
    return kept


def _spans(marks):
    return {(m >> 32, (1 << 32) - 1 - (m & ((1 << 32) - 1))) for m in marks}


def _like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_winnowing(spark):
    texts = [t.replace("　", " ") for t in make_texts(40)] + ["", "a", "a b", "a b c", "a b c d e f", "日本語のテキスト。", "x" * 100, "same " * 500]
    table = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "none here"), (500, None)]
    df = with_clashes(spark.createDataFrame(table, "doc_id long, text string").repartition(4), "marks", "edited")
    out = {r.doc_id: r for r in winnow.compare_edited(df).collect()}
    held = sorted((i, t or "") for i, t in table if i is not None)
    following = {i: held[(k + 1) % len(held)][1] for k, (i, _) in enumerate(held)} | {None: ""}
    assert len(out) == len(table)
    for i, text in table:
        text, row = text or "", out[i]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[i][:cut]
        assert row.n_chars == len(text) and row.edited == edited
        assert _spans(row.marks) == _marks(text) and _spans(row.edited_marks) == _marks(edited)
        assert abs(row.near_edited - _like(_marks(text), _marks(edited))) < 1e-12
        assert abs(row.near_next - _like(_marks(text), _marks(following[i]))) < 1e-12
    assert winnow.compare_edited(df.limit(0)).count() == 0


def test_shared_words_share_a_mark():
    rng = random.Random(4)
    for _ in range(50):
        shared = " ".join(str(rng.randrange(1000)) for _ in range(winnow.GRAM + winnow.WINDOW - 1))
        a, b = (" ".join(str(rng.randrange(1000)) for _ in range(9)) for _ in range(2))
        assert {h for h, _ in _marks(f"{a} {shared} {b}")} & {h for h, _ in _marks(f"{b} {shared}")}


def test_repeated_ids_and_one_row(spark):
    df = spark.createDataFrame([(1, "b b b"), (1, "a a a a"), (1, "b b b"), (2, "c c")], "doc_id long, text string")
    out = sorted((r.doc_id, r.edited) for r in winnow.compare_edited(df).collect())
    assert out == [(1, "a a a c"[:6] + "c"), (1, "b b b"[:4] + "c"), (1, "b b b"[:4] + "c"), (2, "c c")]
    alone = winnow.compare_edited(df.where("doc_id = 2")).first()
    assert alone.near_next == 1.0


def _chunks(text):
    lines = text.split("\n")
    hashes = [xx(line) % line_chunks._PRIME for line in lines]
    out, start = [], 0
    for i in range(len(lines)):
        h = sum(hashes[i - s] * line_chunks._BASE**s for s in range(line_chunks.WINDOW) if i >= s) % line_chunks._PRIME
        if h % line_chunks.DIVISOR == 0 or i == len(lines) - 1:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def test_line_chunks(spark):
    rng = random.Random(8)
    passages = ["\n".join(f"shared {k} {rng.random()}" for _ in range(12)) for k in range(4)]
    texts = make_texts(30) + ["\n".join(rng.sample([*passages, "own line", f"own {i}"], 4)) for i in range(12)] + [passages[0]] * 5 + ["", None, "\n\n\n\n\n\n", "one"]
    table = rows(texts)
    df = with_clashes(spark.createDataFrame(table, SCHEMA).repartition(3), "Removed_lines", "chunk", "hash")
    seen, want = set(), {}
    for i, text, *_ in table:
        kept, gone = [], 0
        for chunk in _chunks(text or ""):
            if len(chunk) >= line_chunks.LEAST_LINES and tuple(chunk) in seen:
                gone += len(chunk)
            else:
                kept.append("\n".join(chunk))
                seen.add(tuple(chunk))
        want[i] = (text if not gone else "\n".join(kept), gone)
    out = line_chunks.remove_repeated(df)
    assert out.columns == [c for c in df.columns if c != "Removed_lines"] + ["removed_lines"]
    assert {r.doc_id: (r.text, r.removed_lines) for r in out.collect()} == want
    assert sum(g for _, g in want.values()) > 50
    assert line_chunks.remove_repeated(df.limit(0)).count() == 0


def test_line_chunks_with_odd_rows(spark):
    df = documents(spark)
    out = line_chunks.remove_repeated(df)
    assert out.count() == df.count() and out.where("text is null").count() == 1


def _without_passages(table, least_words):
    """Chunks where a rolling hash is no larger than a neighbour, long lines, and what is beside a chunk, place by place."""
    prime, base = line_chunks._PRIME, line_chunks._BASE
    seen, want = set(), {}
    for i, text in table:
        lines = (text or "").split("\n")
        h = [xx(line) % prime for line in lines]
        rolling = [(x * base + y) % prime for x, y in zip(h, h[1:])]
        words = [len(line.split()) for line in lines]
        chunks, weak, gone = set(), set(), set()
        for k in range(len(lines)):
            if words[k] >= least_words:
                gone |= {k} if lines[k] in seen else set()
                seen.add(lines[k])
            if k < len(rolling):
                near = rolling[max(0, k - 1) : k] + rolling[k + 1 : k + 2]
                pair = (lines[k], lines[k + 1])
                if pair in seen:
                    seed = not near or rolling[k] <= max(near) or words[k] + words[k + 1] >= least_words
                    (chunks if seed else weak).add(k)
                seen.add(pair)
        for k in chunks | {k for k in weak if k - 1 in chunks or k + 1 in chunks}:
            gone |= {k, k + 1}
        want[i] = ("\n".join(line for k, line in enumerate(lines) if k not in gone) if gone else text, len(gone))
    return want


@pytest.mark.parametrize("share", [1, 256])
def test_passages_equal_place_by_place(spark, monkeypatch, share):
    monkeypatch.setattr(line_chunks, "PLACES_OF_SHARE", share)
    rng = random.Random(share)
    pool = [f"line {i}" for i in range(30)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += ["\n".join([f"own {i}", "hot a", "hot b", "hot c", f"end {i}"]) for i in range(30)] + [None, "", "\n", "a\na\na\na\na"]
    table = list(enumerate(texts))
    names = ["gone", "wanted", "__lines", "__row_id", "anchor", "hash", "place", "first", "n", "share", "shares", "__line_gone", "copy"]
    df = with_clashes(spark.createDataFrame(table, "doc_id long, text string").repartition(3), *names)
    out = line_chunks.remove_passages(df)
    assert out.columns == ["doc_id", "text", *names, "removed_lines"]
    rows = out.collect()
    assert {r.doc_id: (r.text, r.removed_lines) for r in rows} == _without_passages(table, line_chunks.LEAST_WORDS)
    assert all(r["__lines"] == r.gone == r["__row_id"] == "clash" for r in rows)
    assert line_chunks.remove_repeated(df).where("gone = 'clash' AND __row_id = 'clash'").count() == len(table)


def test_passages_of_one_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_chunks, "_anchor_hash", lambda *lines: F.length(lines[0]).cast("long"))
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(12)]
    table = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    rows = line_chunks.remove_passages(df).collect()
    assert {r.doc_id: (r.text, r.removed_lines) for r in rows} == _without_passages(table, line_chunks.LEAST_WORDS)


def test_recall_by_length_of_passage(spark):
    """Passages between lines of their own: all lines go from three lines up, or from 50 words up."""
    rng = random.Random(4)
    own = lambda: f"own {rng.random()}"
    wordy = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    shapes = {"1 long": [60], "2 long": [30, 30], **{str(k): [2] * k for k in (2, 3, 4, 6, 10, 15)}}
    texts, of = [], {}
    for shape, sizes in shapes.items():
        for _ in range(40):
            passage = [wordy(n) for n in sizes]
            for again in range(2):
                if again:
                    of[len(texts)] = (shape, len(sizes))
                texts.append("\n".join([own(), *passage, own()]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    lost = {r.doc_id: r.removed_lines for r in line_chunks.remove_passages(df).collect()}
    recall = {s: sum(lost[i] for i, (t, _) in of.items() if t == s) / sum(n for t, n in of.values() if t == s) for s in shapes}
    print(recall)
    assert all(recall[s] == 1 for s in shapes if s != "2") and recall["2"] > 0.25
    assert all(lost[i] == 0 for i in lost if i not in of)


def test_passages_go_to_their_edges(spark):
    rng = random.Random(9)
    own = lambda: f"own {rng.random()}"
    long = " ".join(f"w{rng.random()}" for _ in range(60))
    passages = [[f"shared {k} {rng.random()}" for _ in range(k)] for k in (2, 3, 4, 6, 10)] + [[long]]
    texts = ["\n".join([own(), *p, own()]) for _ in range(3) for p in passages] + ["\n".join(passages[3])] * 2
    texts += ["same line\n" * 40, "a\nb\na\nb\na", "short line", "short line", "", None]
    table = list(enumerate(texts))
    df = with_clashes(spark.createDataFrame(table, "doc_id long, text string").repartition(3), "Removed_lines", "anchor")
    out = line_chunks.remove_passages(df)
    assert out.columns == ["doc_id", "text", "anchor", "removed_lines"]
    got = {r.doc_id: (r.text, r.removed_lines) for r in out.collect()}
    assert got == _without_passages(table, line_chunks.LEAST_WORDS)
    n = len(passages)
    assert [got[i][1] for i in range(n, 2 * n)][1:] == [3, 4, 6, 10, 1]
    assert line_chunks.remove_passages(df.limit(0)).count() == 0


def test_passages_of_odd_rows(spark):
    df = documents(spark)
    out = line_chunks.remove_passages(df)
    assert out.count() == df.count() and out.where("text is null").count() == 1
    first = {line for (t,) in df.select("text").collect() for line in (t or "").split("\n")}
    left = {line for (t,) in out.select("text").collect() for line in (t or "").split("\n")}
    assert first <= left | {""}


def _groups(table):
    found = defaultdict(list)
    for i, text in table:
        found[(text or "").encode().lower()].append(i)
    return found


def test_stream_dedup(spark, tmp_path):
    df = with_clashes(documents(spark), "digest", "bytes", "keep_id")
    path = str(tmp_path / "docs")
    df.write.parquet(path)
    table = [(r.doc_id, r.text) for r in df.collect()]
    groups = _groups(table)
    for digest in (stream_dedup.sha256, lambda t: hashlib.sha256(t).digest()[:1]):  # the second one collides
        out = stream_dedup.duplicates(spark, path, digest=digest).collect()
        assert len(out) == len(table)
        sizes = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept) for r in out)
        want = []
        for members in groups.values():
            keep = max((m for m in members if m is not None), default=None)
            want += [(m if m is not None else -1, keep, len(members), m == keep) for m in members]
        assert sizes == sorted(want)


def test_stream_continues_from_its_state(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame([(1, "A"), (2, "b"), (3, "a")], "doc_id long, text string").write.parquet(path)
    first = {r.doc_id: (r.keep_id, r.group_size) for r in stream_dedup.duplicates(spark, path, checkpoint=state).collect()}
    assert first == {1: (3, 2), 2: (2, 1), 3: (3, 2)}
    spark.createDataFrame([(9, "a"), (4, None)], "doc_id long, text string").write.mode("append").parquet(path)
    again = {r.doc_id: (r.keep_id, r.group_size) for r in stream_dedup.duplicates(spark, path, checkpoint=state).collect()}
    assert again == {1: (9, 3), 2: (2, 1), 3: (9, 3), 9: (9, 3), 4: (4, 1)}


def test_stream_continues_with_new_files_only(spark, tmp_path):
    """What earlier files put into the state counts, though the path holds new files only."""
    first, second = (str(tmp_path / n) for n in ("first", "second"))
    spark.createDataFrame([(1, "A"), (2, "b"), (3, "a"), (5, "alone")], "doc_id long, text string").write.parquet(first)
    spark.createDataFrame([(9, "a"), (0, "B"), (7, "new")], "doc_id long, text string").write.parquet(second)
    checkpoint = str(tmp_path / "state")
    rows = lambda path: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in stream_dedup.duplicates(spark, path, checkpoint=checkpoint).collect()}
    assert rows(first) == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 5: (5, 1, True)}
    assert rows(second) == {9: (9, 3, True), 0: (2, 2, False), 7: (7, 1, True)}


def test_located_bytes_tell_texts_of_one_digest_apart(spark, tmp_path):
    """The row that stays lies in an earlier file; its bytes are fetched from there and differ."""
    weak = lambda text: text[:1]
    first, second = (str(tmp_path / n) for n in ("first", "second"))
    spark.createDataFrame([(8, "xa")], "doc_id long, text string").write.parquet(first)
    spark.createDataFrame([(3, "xb"), (4, "XA"), (5, "xb")], "doc_id long, text string").write.parquet(second)
    checkpoint = str(tmp_path / "state")
    rows = lambda path: {r.doc_id: (r.keep_id, r.group_size) for r in stream_dedup.duplicates(spark, path, checkpoint=checkpoint, digest=weak).collect()}
    assert rows(first) == {8: (8, 1)}
    assert rows(second) == {3: (5, 2), 4: (8, 2), 5: (5, 2)}


def test_stream_reserves_no_disk_and_splits_hot_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_dedup, "ROWS_OF_SHARE", 3)
    table = [(i, "hot" if i % 3 else f"own {i}") for i in range(90)]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    # The stores' own folder of this session.
    local = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    size = lambda: sum(f.lstat().st_blocks * 512 for f in local.rglob("*") if f.is_file())
    try:
        start = size()
        rows = {r.doc_id: (r.keep_id, r.group_size) for r in stream_dedup.duplicates(spark, str(tmp_path / "in")).collect()}
        assert 0 < size() - start < 100 << 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows == {i: ((89, 60) if i % 3 else (i, 1)) for i in range(90)}


def test_stream_of_one_file_and_of_none(spark, tmp_path):
    import pyarrow.parquet as pq

    file = str(tmp_path / "docs.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": ["x", "X"]}), file)
    assert {r.doc_id: r.keep_id for r in stream_dedup.duplicates(spark, file).collect()} == {1: 2, 2: 2}
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(empty)
    assert stream_dedup.duplicates(spark, empty).count() == 0


def test_passages_are_looked_for_once(spark):
    """The texts are cut into anchors to find candidates and once more for their places, not again for the result."""
    out = line_chunks.remove_passages(documents(spark).select("doc_id", "text"))
    assert "__line_anchors" not in out._jdf.queryExecution().optimizedPlan().toString()
