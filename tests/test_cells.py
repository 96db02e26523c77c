"""Vector index by cell: exact search against brute force, skipped cells, budgets and recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import cells
from vitrine.operators.cells import CellIndex, budget_search, calibrate, exact_search
from vitrine.operators.knn import semantic_search
from vitrine.operators.lsh import recall

SCHEMA = "doc_id long, vec array<double>"


def table(spark, vecs, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vecs)], SCHEMA)


def clustered(groups=20, each=60, dims=12, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [c / np.linalg.norm(c) + rng.normal(scale=spread, size=dims) for c in centres for _ in range(each)]


@pytest.fixture(scope="module")
def groups(spark):
    """Groups of vectors, one of them many copies, with missing, empty and zero vectors and equal scores."""
    vecs = clustered()
    vecs[100:400] = [vecs[100]] * 300
    df = table(spark, [*vecs, None, [], [0.0] * 12]).repartition(5)
    return df, CellIndex.build(df)


def pairs(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("max_query_rows", [16_384, 0])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_exact_search_equals_all_pairs(groups, max_query_rows, exclude_self):
    df, index = groups
    queries = df.withColumnRenamed("doc_id", "query_id")
    got = exact_search(queries, index, 7, exclude_self=exclude_self, max_query_rows=max_query_rows)
    want = semantic_search(queries, df, 7, exclude_self=exclude_self)
    assert pairs(got) == pairs(want)


def test_most_cells_are_left_out(groups):
    df, index = groups
    unit = np.array(clustered(seed=3))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    bars = np.full(len(unit), 0.99)
    assert index.by_bound(unit, bars).mean() < 0.3
    assert index.by_bound(unit, np.full(len(unit), -1.0)).sum() == len(unit) * (index.sizes > 0).sum()


def test_bound_holds_for_every_vector(groups):
    """No vector scores above the bound of its cell."""
    df, index = groups
    rows = index.vectors.collect()
    vecs = np.array([r.vec for r in rows])
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    rng = np.random.default_rng(1)
    queries = rng.normal(size=(50, 12))
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    scores = (1 + queries @ vecs.T) / 2
    for i, row in enumerate(rows):
        assert index.by_bound(queries, scores[:, i])[:, row.cell].all()
    assert index.sizes.sum() == len(rows) == 1200


def test_budget_bounds_the_candidates(groups):
    _, index = groups
    unit = np.random.default_rng(2).normal(size=(40, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for budget in (1, 50, 400, 10**6):
        wanted = index.by_budget(unit, budget)
        held = wanted @ index.sizes
        assert (held >= min(budget, index.sizes.sum())).all()
        assert (held - index.sizes.max() < budget).all()


@pytest.mark.parametrize("max_query_rows", [16_384, 0])
def test_calibrated_budget_reaches_its_recall(spark, max_query_rows):
    rng = np.random.default_rng(8)
    df = table(spark, rng.normal(size=(1500, 16)))
    queries = df.withColumnRenamed("doc_id", "query_id")
    index = CellIndex.build(df, sample_rows=400)
    budget = calibrate(index, queries, 10, 0.93)
    near = budget_search(queries, index, 10, budget, exclude_self=True, max_query_rows=max_query_rows, corpus_block=100)
    exact = semantic_search(queries, df, 10, exclude_self=True)
    row = recall(near, exact).first()
    assert row.expected == 15_000 and row.recall >= 0.9
    joined = near.join(exact.drop("rank").withColumnRenamed("score", "want"), ["query_id", "doc_id"])
    assert joined.where(F.abs(F.col("score") - F.col("want")) > 1e-9).count() == 0
    assert near.where("query_id = doc_id").count() == 0


@pytest.mark.parametrize("like", [True, False])
def test_many_queries_go_to_groups_of_cells(spark, monkeypatch, like):
    """A query is not copied for every cell that it looks at, whether these are few or nearly all."""
    df = table(spark, clustered() if like else np.random.default_rng(6).normal(size=(1200, 12)))
    queries = df.withColumnRenamed("doc_id", "query_id")
    index = CellIndex.build(df)
    staged, stage = [], cells.stage
    monkeypatch.setattr(cells, "stage", lambda frame: staged.append(stage(frame)) or staged[-1])
    got = pairs(exact_search(queries, index, 5, exclude_self=True, max_query_rows=0, corpus_block=400, query_block=500))
    assert got == pairs(semantic_search(queries, df, 5, exclude_self=True))
    groups = len(index.groups(400))
    assert 3 <= groups < len(index.centres) / 4
    assert max(frame.count() for frame in staged) <= 1200 * groups


def test_written_index_reads_its_cells_only(spark, tmp_path, groups):
    df, index = groups
    index.write(str(tmp_path))
    held = CellIndex.read(spark, str(tmp_path))
    query = df.where("doc_id = 900").withColumnRenamed("doc_id", "query_id")
    assert pairs(exact_search(query, held, 9)) == pairs(semantic_search(query, df, 9))
    plan = budget_search(query, held, 3, 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell" in plan or "PushedFilters: [IsNotNull(cell), EqualTo(cell" in plan


def test_no_vectors(spark):
    empty = table(spark, [None, [0.0, 0.0]])
    index = CellIndex.build(empty)
    queries = table(spark, [[1.0, 0.0], None]).withColumnRenamed("doc_id", "query_id")
    assert budget_search(queries, index, 3).count() == 0
    assert exact_search(queries, index, 3).count() == 0
    some = CellIndex.build(table(spark, [[1.0, 0.0]]))
    assert [r.doc_id for r in exact_search(queries, some, 3).collect()] == [0]
    assert exact_search(queries.limit(0), some, 3).count() == 0


def test_quality_counts_wrong_scores_of_far_hits(spark):
    """A wrong score is counted wherever the hit ranks, also beyond the thousand nearest."""
    from registered.vector_queries import _asking, _quality

    angles = np.linspace(0, np.pi, 1_300)
    df = table(spark, np.stack([np.cos(angles), np.sin(angles)], axis=1))
    queries = _asking(df)
    assert sorted(r.query_id for r in queries.collect()) == list(range(0, 1_300, 50))
    near = semantic_search(queries, df, 10, exclude_self=True)
    assert _quality(spark, df, queries, near).collect() == [(0, 0, 1_300, True)]
    far = spark.createDataFrame([(0, 1_250, 0.5, 11), (0, 0, 1.0, 12)], "query_id long, doc_id long, score double, rank int")
    assert _quality(spark, df, queries, near.unionByName(far)).collect() == [(1, 1, 1_300, True)]
    assert _quality(spark, df, queries, near.where("rank > 2")).first().good_recall is False
    assert _quality(spark, df, queries.where("query_id < 0"), near.limit(0)).first().good_recall is True
