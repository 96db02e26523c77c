"""Nearest neighbours in an index of vectors by cell.

A coarse quantiser, k-means on a bounded sample, gives every vector of the corpus a cell. The vectors are stored in the
order of their cells, with each cell's size and radius.

* ``budget_search`` looks at the cells nearest to a query until these hold as many candidates as the query may have, and
  ranks the candidates exactly.
* ``exact_search`` takes the k-th best score of the nearest cells as a bar, and by the triangle inequality leaves out
  all cells that no better vector can lie in.

A cell is scored as a block; what is shuffled is the best ``k`` per query and task. A cell that holds a third of
the corpus, such as copies of one vector, lies in as many files and tasks as its rows need. Queries too many to be sent
to every task meet groups of cells: a query goes to a group once, with a mark for each cell there that it looks at.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import constants as C
from vitrine.functions.vectors import has_direction
from vitrine.operators.blocktopk import CORPUS_BLOCK, MAX_QUERY_BYTES, MAX_QUERY_ROWS, _Best, _is_small, _result_schema, grid_topk
from vitrine.operators.knn import CosineScorer
from vitrine.operators.ranking import top_n
from vitrine.session import ship_package, stage

#: Rows that the quantiser is fitted on, and the most cells it may have: both bound what the driver holds.
SAMPLE_ROWS = 50_000
MAX_CELLS = 4_096
_ROUNDS = 8
_GRAIN = 1 << 20
# Rows of a cell scored at once.
_ROWS = 4_096
# Rounding of scores and angles may not lose a neighbour.
_SLACK = 1e-5


def fit_centres(unit: np.ndarray, cells: int, seed: int = 7, rounds: int = _ROUNDS) -> np.ndarray:
    """Unit centres of ``cells`` groups of unit vectors; at most one for each distinct vector."""
    distinct = np.unique(unit, axis=0)
    random = np.random.default_rng(seed)
    centres = distinct[random.choice(len(distinct), min(cells, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        nearest = nearest_cell(unit, centres)[0]
        total = np.zeros_like(centres)
        np.add.at(total, nearest, unit)
        norms = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, total / np.maximum(norms, 1e-9), centres)
    return centres


def nearest_cell(unit: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector and its angle to the centre."""
    cell, cosine = np.empty(len(unit), dtype=np.int64), np.empty(len(unit))
    step = max(1, (4 << 20) // max(1, len(centres)))
    for first in range(0, len(unit), step):
        part = unit[first : first + step] @ centres.T
        cell[first : first + step] = part.argmax(axis=1)
        cosine[first : first + step] = part.max(axis=1)
    return cell, np.arccos(np.clip(cosine, -1, 1))


@dataclass(frozen=True)
class CellIndex:
    """``vectors(doc_id, vec, cell)`` in the order of cells; centre, number of vectors and radius (an angle) of each cell."""

    vectors: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    @staticmethod
    def build(corpus: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> CellIndex:
        """Index every vector of ``corpus(doc_id, vec)`` that has a direction.

        The quantiser is fitted on about ``sample_rows`` of them, chosen by a hash of the id; without ``cells`` their number is
        the root of the corpus, ``MAX_CELLS`` at most.
        """
        ship_package(corpus.sparkSession)
        usable = corpus.select("doc_id", "vec").where(F.col("vec").isNotNull() & has_direction(F.col("vec")))
        rows = usable.count()
        share = math.ceil(_GRAIN * min(1.0, sample_rows / max(rows, 1)))
        chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(_GRAIN)) < share).limit(2 * sample_rows).toArrow()
        if not chosen.num_rows:  # a small table may have no id below the share
            chosen = usable.limit(1).toArrow()
        unit = CosineScorer._unit(chosen)
        centres = fit_centres(unit, cells or min(MAX_CELLS, math.ceil(math.sqrt(max(rows, 1)))), seed)
        shared = corpus.sparkSession.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                cell, angle = nearest_cell(CosineScorer._unit(table), shared.value)
                columns = [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "vec", "cell", "angle"])

        kinds = [usable.schema[name].dataType.simpleString() for name in ("doc_id", "vec")]
        assigned = usable.mapInArrow(assign, f"doc_id {kinds[0]}, vec {kinds[1]}, cell int, angle double")
        # By cell and id, so that a large cell spans files.
        ranged = assigned.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id")
        return CellIndex._of(stage(ranged), centres)

    @staticmethod
    def _of(vectors: DataFrame, centres: np.ndarray) -> CellIndex:
        sizes, radii = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
        # One row per cell.
        for row in vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect():
            sizes[row.cell], radii[row.cell] = row.n, row.radius
        return CellIndex(vectors, centres, sizes, radii)

    def write(self, path: str) -> None:
        """Write the index; a search reads the row groups of its cells."""
        self.vectors.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id").write.mode("overwrite").parquet(f"{path}/vectors")
        spark = self.vectors.sparkSession
        rows = [(i, json.dumps(c.tolist())) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "cell int, centre string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    @staticmethod
    def read(spark: SparkSession, path: str) -> CellIndex:
        rows = sorted(spark.read.parquet(f"{path}/centres").collect())  # at most MAX_CELLS
        centres = np.array([json.loads(r.centre) for r in rows]).reshape(len(rows), -1)
        return CellIndex._of(spark.read.parquet(f"{path}/vectors"), centres)

    def by_budget(self, unit: np.ndarray, num_candidates: int) -> np.ndarray:
        """Which cells a query looks at: the nearest ones until they hold ``num_candidates`` vectors."""
        order = np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")
        size = self.sizes[order]
        wanted = np.cumsum(size, axis=1) - size < num_candidates
        out = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(out, order, wanted, axis=1)
        return out & (self.sizes > 0)

    def by_bound(self, unit: np.ndarray, bars: np.ndarray) -> np.ndarray:
        """Which cells may hold a vector that scores ``bars`` or better with a query."""
        angle = np.arccos(np.clip(unit @ self.centres.T, -1, 1))
        best = (1 + np.cos(np.maximum(angle - self.radii - _SLACK, 0))) / 2
        return (best + _SLACK >= bars[:, None]) & (self.sizes > 0)

    def groups(self, rows: int) -> np.ndarray:
        """The first cell of each group of neighbouring cells with at most ``rows`` vectors; a larger cell is its own group."""
        first, held = [0], 0
        for cell, size in enumerate(self.sizes.tolist()):
            if held and held + size > rows:
                first.append(cell)
                held = 0
            held += size
        return np.array(first)


class CellScorer(CosineScorer):
    """Cosine scores within the cells that a query looks at.

    ``cells`` of a query has a bit for each cell of the group, ``place`` of a document is the number of its cell there.
    """

    def queries(self, table: pa.Table):
        bits = np.frombuffer(b"".join(table["cells"].to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)
        return self._unit(table), np.unpackbits(bits, axis=1).astype(bool)

    def documents(self, table: pa.Table, queries):
        place = table["place"].to_numpy()
        order = np.argsort(place, kind="stable")
        present, first = np.unique(place[order], return_index=True)
        return self._unit(table), place, present, np.split(order, first[1:])

    def score(self, queries, documents, start: int, stop: int) -> np.ndarray:
        (asking, bits), (vectors, place, present, columns) = queries, documents
        wanted = bits[start:stop]
        pairs = wanted[:, present].sum(axis=0) @ np.array([len(c) for c in columns], dtype=np.int64)
        if 2 * pairs > (stop - start) * len(place):
            scores = super().score(asking, vectors, start, stop)
            if pairs < scores.size:
                scores[~wanted[:, place]] = -np.inf
            return scores
        scores = np.full((stop - start, len(place)), -np.inf)
        for cell, own in zip(present.tolist(), columns):
            rows = np.flatnonzero(wanted[:, cell])
            if len(rows):
                scores[np.ix_(rows, own)] = super().score(asking[start + rows], vectors[own], 0, len(rows))
        return scores


def _scan(index: CellIndex, table: pa.Table, wanted: np.ndarray, k: int, exclude_self: bool, schema) -> DataFrame:
    """Score the cells where they lie; ``wanted`` says which query looks at which."""
    spark = index.vectors.sparkSession
    cells = np.flatnonzero(wanted.any(axis=0))
    source = index.vectors
    if len(cells) < len(index.centres):
        source = source.where(F.col("cell").isin([int(c) for c in cells]))
    shared = spark.sparkContext.broadcast((table, np.packbits(wanted, axis=0), len(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, bits, n = shared.value
        ids = queries["query_id"].to_pylist()
        unit = CosineScorer._unit(queries)
        position = {q: i for i, q in enumerate(ids)} if exclude_self else {}
        best, doc_type = _Best(ids, k), None
        for batch in batches:
            block = pa.Table.from_batches([batch]).sort_by([("cell", "ascending"), ("doc_id", "ascending")])
            doc_type = block.schema.field("doc_id").type
            vectors, cell = CosineScorer._unit(block), block["cell"].to_numpy()
            names = np.array(block["doc_id"].to_pylist(), dtype=object)
            bounds = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                asking = np.flatnonzero(np.unpackbits(bits[:, cell[first]], count=n))
                for low in range(first, last, _ROWS):
                    high = min(low + _ROWS, last)
                    step = max(1, 500_000 // (high - low))
                    for some in range(0, len(asking), step):
                        rows = asking[some : some + step]
                        scores = (1 + unit[rows] @ vectors[low:high].T) / 2
                        if exclude_self:
                            own = np.array([position.get(d, -1) for d in names[low:high]])
                            at = np.searchsorted(rows, own)
                            mine = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == own)
                            scores[at[mine], np.flatnonzero(mine)] = -np.inf
                        best.offer(rows, scores, names[low:high])
        if doc_type is not None:
            yield best.table(queries.schema.field("query_id").type, doc_type)

    return source.select("doc_id", "vec", "cell").mapInArrow(run, schema)


def _usable(queries: DataFrame, *more: str) -> DataFrame:
    return queries.select("query_id", "vec", *more).where(F.col("vec").isNotNull() & has_direction(F.col("vec")))


def _groups_of(index: CellIndex, groups: np.ndarray, queries: DataFrame, choose: Callable[[CellIndex, pa.Table], np.ndarray]) -> DataFrame:
    """``query_id, vec, group, cells``: one row for each group with a cell that a query looks at, and a bit for each cell there."""
    bare = CellIndex(None, index.centres, index.sizes, index.radii)
    shared = index.vectors.sparkSession.sparkContext.broadcast((bare, [*groups.tolist(), len(index.centres)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, firsts = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                wanted = choose(held, pa.Table.from_batches([part]))
                for group, (low, high) in enumerate(zip(firsts, firsts[1:])):
                    rows = np.flatnonzero(wanted[:, low:high].any(axis=1))
                    if len(rows):
                        asked, bits = part.take(pa.array(rows)), np.packbits(wanted[rows, low:high], axis=1)
                        columns = [asked.column(0), asked.column(1), pa.array(np.full(len(rows), group, np.int32)), pa.array([b.tobytes() for b in bits])]
                        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec", "group", "cells"])

    kinds = [queries.schema[name].dataType.simpleString() for name in ("query_id", "vec")]
    return queries.mapInArrow(run, f"query_id {kinds[0]}, vec {kinds[1]}, group int, cells binary")


def _search(index: CellIndex, queries: DataFrame, choose, k: int, exclude_self: bool, max_query_rows: int, **blocks) -> DataFrame:
    """Partial best lists of the cells that ``choose`` gives each query."""
    ship_package(index.vectors.sparkSession)
    if not len(index.centres):
        return index.vectors.sparkSession.createDataFrame([], _result_schema(index.vectors, queries))
    if _is_small(queries, max_query_rows, MAX_QUERY_BYTES):
        table = queries.toArrow()
        wanted = choose(index, table) if table.num_rows else np.zeros((0, len(index.centres)), dtype=bool)
        return _scan(index, table, wanted, k, exclude_self, _result_schema(index.vectors, queries))
    groups = index.groups(blocks.get("corpus_block", CORPUS_BLOCK))
    asked = stage(_groups_of(index, groups, queries, choose))
    group = np.searchsorted(groups, np.arange(len(index.centres)), side="right") - 1
    places = [(c, g, c - f) for c, g, f in zip(range(len(group)), group.tolist(), groups[group].tolist())]
    of_cell = index.vectors.sparkSession.createDataFrame(places, "cell int, group int, place int")  # at most MAX_CELLS
    corpus = index.vectors.join(F.broadcast(of_cell), "cell").select("doc_id", "vec", "group", "place")
    return grid_topk(corpus, asked, CellScorer(), k, keys=["group"], exclude_self=exclude_self, **blocks)


def budget_search(
    queries: DataFrame,
    index: CellIndex,
    size: int = C.DEFAULT_SIZE,
    num_candidates: int | None = None,
    *,
    exclude_self: bool = False,
    max_query_rows: int = MAX_QUERY_ROWS,
    **blocks,
) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the best among the ``num_candidates`` of each query.

    The candidates are whole cells, nearest first, so there may be some more of them; by default four times ``size``.
    ``calibrate`` gives the number that a wanted recall needs. A query without direction has no hits.
    """
    budget = num_candidates or size * C.CANDIDATES

    def choose(held: CellIndex, table: pa.Table) -> np.ndarray:
        return held.by_budget(CosineScorer._unit(table), budget)

    found = _search(index, _usable(queries), choose, size, exclude_self, max_query_rows, **blocks)
    return top_n(found.drop("matches"), size)


def exact_search(
    queries: DataFrame, index: CellIndex, size: int = C.DEFAULT_SIZE, *, exclude_self: bool = False, max_query_rows: int = MAX_QUERY_ROWS, **blocks
) -> DataFrame:
    """As ``knn.semantic_search``, but cells that can't hold a hit are left out.

    A first pass over the nearest cells gives each query the score of its ``size``-th candidate; the second one
    looks at the cells whose bound reaches it.
    """
    usable = _usable(queries)
    need = size + (1 if exclude_self else 0)
    near = budget_search(queries, index, size, need, exclude_self=exclude_self, max_query_rows=max_query_rows, **blocks)
    bars = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= size, F.min("score")).otherwise(-1.0).alias("bar"))
    barred = stage(usable.join(bars, "query_id", "left").select("query_id", "vec", F.coalesce("bar", F.lit(-1.0)).alias("bar")))
    found = _search(index, barred, chosen_by_bound, size, exclude_self, max_query_rows, **blocks)
    return top_n(found.drop("matches"), size)


def chosen_by_bound(held: CellIndex, table: pa.Table) -> np.ndarray:
    return held.by_bound(CosineScorer._unit(table), pc.fill_null(table["bar"].combine_chunks(), -1.0).to_numpy(zero_copy_only=False))


def calibrate(index: CellIndex, queries: DataFrame, size: int = C.DEFAULT_SIZE, least_recall: float = 0.95, sample_queries: int = 256) -> int:
    """The number of candidates with which ``least_recall`` of the true neighbours of some queries are found.

    About ``sample_queries`` queries, chosen by a hash of the id, are searched exactly; each of their neighbours needs
    the vectors of all cells nearer to the query than its own.
    """
    usable = _usable(queries)
    share = math.ceil(_GRAIN * min(1.0, sample_queries / max(usable.count(), 1)))
    sample = stage(usable.where(F.pmod(F.xxhash64("query_id"), F.lit(_GRAIN)) < share).limit(2 * sample_queries))
    hits = exact_search(sample, index, size, exclude_self=True)
    cells = index.vectors.select("doc_id", "cell")
    # At most twice sample_queries times size rows.
    table = hits.join(cells, "doc_id").join(sample, "query_id").select("vec", "cell").toArrow()
    if not table.num_rows:
        return size
    order = np.argsort(-(CosineScorer._unit(table) @ index.centres.T), axis=1, kind="stable")
    size_of = index.sizes[order]
    at = np.argmax(order == table["cell"].to_numpy()[:, None], axis=1)
    needed = (np.cumsum(size_of, axis=1) - size_of)[np.arange(len(at)), at] + 1
    return int(np.sort(needed)[max(0, math.ceil(least_recall * len(needed)) - 1)])
