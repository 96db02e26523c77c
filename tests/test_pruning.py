"""Pruned rankings against unpruned ones: metadata signatures, stored keys of near words."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.operators import blocktopk, metadata_similarity as M
from vitrine.operators.fuzzy import KeyTable, _swap_distance, expand_terms, vocabulary_keys
from vitrine.operators.terms import SearchField, TextIndex

ITEM = (
    "doc_id long, artist string, medium string, classification string, department string, culture string, "
    "artistNationality string, period string, dynasty string, dateBegin int, dateEnd int, width double, height double"
)


def gallery(n, seed, copies):
    """Items of which ``copies`` are equal to an earlier one, with nulls and empty values."""
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    rows = []
    for i in range(n):
        if i >= 20 and i < 20 + copies:
            rows.append((i, *rows[rng.randrange(20)][1:]))
            continue
        year = pick(None, 0, rng.randint(1400, 1950))
        rows.append(
            (
                i, pick("Unknown", "", None, f"Artist {rng.randrange(9)}"), pick("oil on canvas", "oil on wood", "olil on canvas", None, "ink"),
                pick("Paintings", "Prints", None), pick("European", "Asian"), pick("French", "Dutch", None, ""), pick("French", None),
                pick(f"P{rng.randrange(4)}", None), pick(None, "Ming"), year, None if year is None else year + rng.randrange(9),
                pick(None, 0.0, rng.uniform(5, 90)), pick(None, rng.uniform(5, 90)),
            )
        )
    return rows


def ranked(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.select("query_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("options", [{}, {"max_query_rows": 0}])
def test_metadata_signatures_equal_scoring_all(spark, options, monkeypatch):
    monkeypatch.setattr(M, "OWN_ROWS", 32)
    monkeypatch.setattr(M.MetadataScorer, "block_rows", 16)
    df = spark.createDataFrame(gallery(260, 4, 150), ITEM).repartition(3)
    assert ranked(M.similar_by_metadata(df, size=7, **options)) == ranked(M.similar_by_metadata(df, size=7, with_total=True))
    some = df.where("doc_id % 9 = 0").select("doc_id", *df.columns[1:])
    assert ranked(M.similar_by_metadata(df, some, 5, **options)) == ranked(M.similar_by_metadata(df, some, 5, with_total=True))


def test_queries_meet_only_blocks_that_may_reach_their_bar(spark, monkeypatch):
    """In blocks of the whole corpus by likeness; years, sizes and values may be missing. Nothing may be lost by it."""
    monkeypatch.setattr(blocktopk, "BOUNDED_BLOCK", 24)
    monkeypatch.setattr(blocktopk, "MOST_BLOCKS", 1.0)
    monkeypatch.setattr(M, "OWN_ROWS", 32)
    monkeypatch.setattr(M.MetadataScorer, "block_rows", 8)
    sizes, stage = [], blocktopk.stage

    def noted(df):
        staged = stage(df)
        if "blocks" in staged.columns:
            sizes.extend(r[0] for r in staged.select(F.size("blocks")).collect())
        return staged

    monkeypatch.setattr(blocktopk, "stage", noted)
    df = spark.createDataFrame(gallery(600, 11, 0), ITEM).repartition(3)
    assert ranked(M.similar_by_metadata(df, size=4, max_query_rows=0)) == ranked(M.similar_by_metadata(df, size=4, with_total=True))
    assert len(sizes) > 500 and 1 <= sum(sizes) / len(sizes) < 0.75 * 600 / 24
    # Without a bar of use all blocks are asked for, which falls back to the grid.
    monkeypatch.setattr(blocktopk, "MOST_BLOCKS", 0.0)
    some = df.where("doc_id % 9 = 0")
    assert ranked(M.similar_by_metadata(df, some, 5, max_query_rows=0)) == ranked(M.similar_by_metadata(df, some, 5, with_total=True))


def test_bars_wait_for_enough_rows(spark):
    """Batches of few rows are put together, so a bar is never one of a piece without ``k`` documents."""
    class Equal:
        queries = documents = staticmethod(lambda table, *rest: table.num_rows)
        score = staticmethod(lambda queries, documents, start, stop: np.ones((stop - start, documents)))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        both = spark.range(103).coalesce(1).select(F.col("id").alias("query_id"), F.col("id").alias("_doc_doc_id"))
        bars = blocktopk.own_block_bars(both, Equal(), 8, ["query_id"], 16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)
    assert sorted(r.query_id for r in bars) == list(range(103)) and {r.bar for r in bars} == {1.0}


def test_only_copies_and_single_items(spark):
    same = [(i, "A", "oil", "Paintings", "E", None, None, None, None, 1900, 1900, 5.0, 5.0) for i in range(40)]
    df = spark.createDataFrame(same, ITEM)
    got = M.similar_by_metadata(df, size=3)
    assert ranked(got) == ranked(M.similar_by_metadata(df, size=3, with_total=True))
    assert M.similar_by_metadata(df.where("doc_id = 3"), size=3).count() == 0
    assert M.similar_by_metadata(df.limit(0), size=3).count() == 0


def test_blocks_that_cannot_serve_are_left_out(spark, monkeypatch):
    """Two schools without anything in common: a source's blocks are those of its own."""
    rows = []
    for i in range(400):
        s = i % 2
        rows.append((i, f"Artist {s}{i % 7}", f"kind{s}", f"Class {s}", f"D{s}", None, None, f"P{s}", None, None, None, None, None))
    df = spark.createDataFrame(rows, ITEM)
    scored = []
    plain = M.MetadataScorer.score

    def counted(self, queries, documents, start, stop):
        scored.append((stop - start) * documents[0][1])
        return plain(self, queries, documents, start, stop)

    clauses = M.Clauses()
    scorer = M.MetadataScorer(clauses)
    queries = M.source_features(df, df, clauses).orderBy("query_id").toArrow()
    documents = M.candidate_features(df, clauses).toArrow()
    whole = scorer.score(scorer.queries(queries), scorer.documents(documents, scorer.queries(queries)), 0, 400).copy()
    whole[np.arange(400), np.arange(400)] = -np.inf
    bars = np.sort(whole, axis=1)[:, -5]
    monkeypatch.setattr(M.MetadataScorer, "score", counted)
    monkeypatch.setattr(M.MetadataScorer, "block_rows", 20)
    best, held, positions = blocktopk._setup(scorer, queries.append_column("bar", pa.array(bars)), 5, True)
    blocktopk._offer_block(best, scorer, held, positions, documents, True)
    assert sum(scored) < 400 * 400 * 0.55
    for q in range(400):
        mine = np.sort(best.scores[best.rows == q])[::-1]
        assert mine == pytest.approx(np.round(np.sort(whole[q])[::-1][:5], 6))


def test_bounds_hold(spark):
    df = spark.createDataFrame(gallery(120, 9, 0), ITEM)
    clauses = M.Clauses()
    scorer = M.MetadataScorer(clauses)
    queries = scorer.queries(M.source_features(df, df, clauses).toArrow())
    table = scorer.order(M.candidate_features(df, clauses).toArrow())
    for start in range(0, 120, 11):
        documents = scorer.documents(table.slice(start, 11), queries)
        scores = scorer.score(queries, documents, 0, 120).copy()  # the array is used again
        assert (scores.max(axis=1) <= scorer.bounds(queries, documents) + 1e-9).all()
        rows = np.array([3, 50, 51, 119])
        assert (scorer.score(scorer.take(queries, rows), documents, 0, 4) == scores[rows]).all()


def test_stored_keys_give_the_same_words(spark, tmp_path):
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 12, 13, 15, 18]))) for _ in range(700)}
    vocabulary = spark.createDataFrame([(f, w, i) for f in "xy" for i, w in enumerate(sorted(words))], "field string, term string, df long")
    KeyTable.write(vocabulary, str(tmp_path), rows_per_bucket=2000)
    keys = KeyTable.read(spark, str(tmp_path))
    assert keys.buckets > 20
    asked = [w[:-1] + rng.choice(["", "zz", w[:1]]) for w in rng.sample(sorted(words), 60)]
    wanted = spark.createDataFrame([("x", w) for w in set(asked) if w], "field string, query_term string")
    plain, stored = (sorted(map(tuple, expand_terms(wanted, vocabulary, keys=k).collect())) for k in (None, keys))
    assert plain == stored and len(plain) > 60
    one = wanted.limit(1).select(F.xxhash64("query_term").alias("key"))
    held = keys.matching(one)
    assert "PartitionFilters: [isnotnull(bucket" in held._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in held._jdf.queryExecution().toString()
    assert held.select(F.input_file_name()).distinct().count() == 1


def test_near_words_take_one_key_join(spark):
    vocabulary = spark.createDataFrame([("f", "paint", 1)], "field string, term string, df long")
    wanted = spark.createDataFrame([("f", "pianted")], "field string, query_term string")
    plan = expand_terms(wanted, vocabulary)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def _edited(rng, word):
    """The word after one or two edits, swaps also at its middle and at the cuts of its segments."""
    for _ in range(rng.randrange(1, 3)):
        i = rng.choice([rng.randrange(len(word)), len(word) // 2 - 1, len(word) // 5, len(word) - 2])
        kind, c = rng.randrange(4), rng.choice("abé")
        word = [word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + word[i : i + 2][::-1] + word[i + 2 :]][kind]
    return word


def test_longer_words_are_found_by_few_keys(spark, tmp_path):
    """Every word within the edits is found, from keys that are few for each word of the vocabulary."""
    rng = random.Random(4)
    bases = ["".join(rng.choice("abé") for _ in range(n)) for n in range(5, 31) for _ in range(3)]
    words = sorted({*bases, *(_edited(rng, b) for b in bases for _ in range(12))})
    asked = rng.sample(words, 150)
    vocabulary = spark.createDataFrame([("text", w, 1) for w in words], "field string, term string, df long")
    KeyTable.write(vocabulary, str(tmp_path), rows_per_bucket=3000)
    wanted = spark.createDataFrame([("text", w) for w in asked], "field string, query_term string")
    want = set()
    for q in asked:
        budget = 2 if len(q) >= 6 else 1 if len(q) >= 3 else 0
        want |= {(q, w, d) for w in words if abs(len(q) - len(w)) <= 2 and (d := _swap_distance(q, w)) <= budget}
    for keys in (None, KeyTable.read(spark, str(tmp_path))):
        near = expand_terms(wanted, vocabulary, None, keys)
        assert {(r.query_term, r.term, r.edits) for r in near.collect()} == want
    held = vocabulary.where("char_length(term) BETWEEN 10 AND 24").select(F.char_length("term").alias("n"), F.size(F.array_distinct(vocabulary_keys(F.col("term")))).alias("keys"))
    assert held.where("keys > n + 2").count() == 0


def test_postings_counted_in_rows_merge_equal_ids(spark, tmp_path):
    """An index is written from words counted where they lie; rows with equal or missing ids and lengths count together, as before."""
    corpus = spark.createDataFrame(
        [(1, "b a b", "x"), (1, "a b c", "x"), (1, "a", "y"), (None, "a a", None), (None, "c a", "x"), (2, None, "x"), (3, "", None)],
        "doc_id long, text string, kind string",
    )
    fields = [SearchField("text"), SearchField("kind", exact=True)]
    index = TextIndex.of(corpus, fields)
    index.write(str(tmp_path))
    key = lambda r: (r.field, r.term, r.doc_id is None, r.doc_id or 0, r.dl)
    got = sorted((*key(r), r.tf) for r in TextIndex.read(spark, str(tmp_path), fields).postings.collect())
    assert got == sorted((*key(r), r.tf) for r in index.all_postings().collect())
    none, one = (True, 0), (False, 1)
    assert got == [
        ("kind", "x", False, 1, 1, 2), ("kind", "x", False, 2, 1, 1), ("kind", "x", *none, 1, 1), ("kind", "y", *one, 1, 1),
        ("text", "a", *one, 1, 1), ("text", "a", *one, 3, 2), ("text", "a", *none, 2, 3),
        ("text", "b", *one, 3, 3), ("text", "c", *one, 3, 1), ("text", "c", *none, 2, 1),
    ]
