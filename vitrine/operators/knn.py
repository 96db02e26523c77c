"""Cosine nearest neighbours, exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vitrine import constants as C
from vitrine.operators.blocktopk import dense_topk

#: Pairs that are scored exactly at once.
PAIRS_AT_ONCE = 20_000


class CosineScorer:
    """(1 + cos) / 2 between ``vec`` columns; a vector without direction never matches."""

    def queries(self, table: pa.Table):
        return self._unit(table)

    def documents(self, table: pa.Table, queries):
        return self._unit(table)

    def score(self, queries, documents, start: int, stop: int) -> np.ndarray:
        if not queries.size or not documents.size:
            return np.full((stop - start, len(documents)), -np.inf)
        scores = queries[start:stop] @ documents.T
        scores += 1
        scores /= 2
        scores[np.isnan(scores)] = -np.inf
        return scores

    @staticmethod
    def _unit(table: pa.Table) -> np.ndarray:
        """Unit vectors; missing, empty and zero ones are not a number throughout."""
        column = table["vec"].combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        width = int(lengths.max(initial=0))
        whole = lengths == width
        if width and not (whole | (lengths == 0)).all():
            raise ValueError("vectors of different lengths")
        matrix = np.full((len(column), width), np.nan)
        if width:
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            norms = np.linalg.norm(flat, axis=1, keepdims=True)
            matrix[whole] = np.divide(flat, norms, out=np.full_like(flat, np.nan), where=norms > 0)
        return matrix


class RoughCosineScorer(CosineScorer):
    """As ``CosineScorer``, first in single precision; pairs that may be among the best are scored in double precision."""

    distinct = False
    # Larger blocks than others take, as a row is small and blocks are sent to each other.
    corpus_block, query_block = 200_000, 50_000

    def queries(self, table: pa.Table):
        return self._decode(table)

    def documents(self, table: pa.Table, queries):
        return self._decode(table)

    def _decode(self, table: pa.Table):
        unit = self._unit(table)
        return unit, unit.astype(np.float32)

    def valid(self, decoded) -> np.ndarray:
        unit = decoded[0]
        return ~np.isnan(unit[:, 0]) if unit.shape[1] else np.zeros(len(unit), dtype=bool)

    def rough(self, queries, documents, start: int, stop: int) -> tuple[np.ndarray, float]:
        (queries, documents) = queries[1], documents[1]
        if not queries.size or not documents.size:
            return np.full((stop - start, len(documents)), np.nan, dtype=np.float32), 0.0
        scores = (queries[start:stop] / 2) @ documents.T
        scores += np.float32(0.5)
        # More than the roundings of the parts, the products and the sums can add up to.
        return scores, (queries.shape[1] + 4) * 2.0**-23

    def exact(self, queries, documents, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        (queries, documents) = queries[0], documents[0]
        scores = np.empty(len(rows))
        for at in range(0, len(rows), PAIRS_AT_ONCE):
            some = slice(at, at + PAIRS_AT_ONCE)
            scores[some] = np.einsum("ij,ij->i", queries[rows[some]], documents[cols[some]])
        return (scores + 1) / 2


def semantic_search(queries: DataFrame, corpus: DataFrame, size: int = C.DEFAULT_SIZE, **options) -> DataFrame:
    """Nearest documents of every query vector.

    ``queries(query_id, vec)``, ``corpus(doc_id, vec)``; options go to ``dense_topk``.
    """
    return dense_topk(corpus.select("doc_id", "vec"), queries.select("query_id", "vec"), RoughCosineScorer(), size, **options)


def similar_by_vector(corpus: DataFrame, source_ids: DataFrame | None = None, size: int = C.DEFAULT_SIZE, **options) -> DataFrame:
    """Nearest other documents of every source document (all of them by default)."""
    # A merge join, as the ids of many sources, small as they are in files, would go to the driver to be broadcast.
    vectors = corpus if source_ids is None else corpus.join(source_ids.select("doc_id").hint("merge"), "doc_id", "left_semi")
    queries = vectors.withColumnRenamed("doc_id", "query_id")
    return semantic_search(queries, corpus, size, exclude_self=True, **options)
