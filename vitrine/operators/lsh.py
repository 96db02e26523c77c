"""Approximate nearest neighbours by random projections.

Vectors are hashed into buckets by several tables of joint projections.  A bucket is
scored exactly and block by block; one that holds many copies is split over tasks, so
pairs within it are neither emitted nor gathered in one place.

Where the buckets hold more pairs than there are, as pairs meet in several tables, blocks of all are scored once and the
buckets of the pairs that may be among the best are compared: the same hits for less work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import constants as C
from vitrine.functions.vectors import has_direction, normalize
from vitrine.operators.blocktopk import grid_topk
from vitrine.operators.knn import PAIRS_AT_ONCE, RoughCosineScorer
from vitrine.operators.ranking import top_n
from vitrine.session import stage


class BucketScorer(RoughCosineScorer):
    """Cosine scores of pairs that share one of their ``buckets``; a document counts once, with its best row."""

    distinct = True

    def _decode(self, table: pa.Table):
        buckets = table["buckets"].combine_chunks()
        return *super()._decode(table), buckets.flatten().to_numpy().reshape(len(buckets), -1)

    def matching(self, queries, documents, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        good = np.empty(len(rows), dtype=bool)
        for at in range(0, len(rows), PAIRS_AT_ONCE):
            some = slice(at, at + PAIRS_AT_ONCE)
            good[some] = (queries[2][rows[some]] == documents[2][cols[some]]).any(axis=1)
        return good


def _hashed(df: DataFrame, model, id_col: str, joint: int, tables: int) -> DataFrame:
    """The vectors with ``buckets``, the joint bucket of their projections in each table."""
    hashed = model.transform(df)
    values = F.transform(F.col("hashes"), lambda h: F.element_at(vector_to_array(h), 1).cast("long"))
    buckets = [F.xxhash64(F.slice("hash_values", t * joint + 1, joint)) for t in range(tables)]
    return hashed.withColumn("hash_values", values).select(id_col, "vec", F.array(*buckets).alias("buckets"))


def _by_table(hashed: DataFrame, *columns: str) -> DataFrame:
    """One row per table with its bucket."""
    return hashed.select(*columns, F.posexplode("buckets").alias("hash_table", "bucket"))


def _pairs(documents: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """How many pairs the buckets hold, and how many there are."""
    keys = ["hash_table", "bucket"]
    held = _by_table(documents).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
    asked = _by_table(queries).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("m"))
    met = held.join(asked, keys).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0))).first()[0]
    return int(met), documents.count() * queries.count()


def approximate_search(
    queries: DataFrame,
    corpus: DataFrame,
    size: int = C.DEFAULT_SIZE,
    *,
    tables: int = 16,
    joint: int = 2,
    width: float = 0.2,
    seed: int = 7,
    exclude_self: bool = False,
    **blocks,
) -> DataFrame:
    """Nearest documents that share a bucket with the query, exactly scored.

    More ``tables`` find more neighbours; more ``joint`` projections or a smaller
    ``width`` make buckets smaller.
    """
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables * joint, seed=seed
    )

    def unit(df: DataFrame, id_col: str) -> DataFrame:
        usable = df.where(F.col("vec").isNotNull() & has_direction(F.col("vec")))
        return usable.select(id_col, "vec", array_to_vector(normalize(F.col("vec"))).alias("features"))

    documents, wanted = unit(corpus, "doc_id"), unit(queries, "query_id")
    model = lsh.fit(documents)
    # Read for the sizes of the buckets, the split of large ones and the rows themselves.
    held = stage(_hashed(documents, model, "doc_id", joint, tables))
    asked = stage(_hashed(wanted, model, "query_id", joint, tables))
    met, pairs = _pairs(held, asked)
    if met > pairs:
        cells = grid_topk(held, asked, BucketScorer(), size, exclude_self=exclude_self, **blocks)
    else:
        keys = ["hash_table", "bucket"]
        held, asked = _by_table(held, "doc_id", "vec"), _by_table(asked, "query_id", "vec")
        cells = grid_topk(held, asked, RoughCosineScorer(), size, keys=keys, exclude_self=exclude_self, **blocks)
    # The same document may turn up in several tables, always with the same score.
    return top_n(cells.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), size)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found: ``found, expected, recall``."""
    # A merge join, as packed lists take many times their size on the driver when they are broadcast.
    hits = exact.select("query_id", "doc_id").join(
        approximate.select("query_id", "doc_id", F.lit(1).alias("hit")).hint("merge"), ["query_id", "doc_id"], "left"
    )
    counts = hits.agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("expected"))
    return counts.withColumn("recall", F.round(F.col("found") / F.nullif("expected", F.lit(0)), 4))
