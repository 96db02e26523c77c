"""Exact top-k of a dense score between a query table and a corpus.

Scores come from a vectorised ``Scorer``; no pair of query and document ever becomes
a row, only the best ``k`` per query and block do.

* A query table within the row and byte bounds goes to every task, and the corpus is
  scanned where it lies: no shuffle but the final one of ``k`` rows per query and task.
* A larger one is cut into blocks, as is the corpus, and every cell of the grid of
  blocks is scored by itself (``grid_topk``).

Blocks come from a hash of the id, so they are even whatever the data holds. With bars and a scorer with bounds they are
ranges of like documents instead, and a query goes only to the blocks that may reach its bar (``bounded_topk``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import constants as C
from vitrine.operators.ranking import top_n
from vitrine.session import ship_package, stage

MAX_QUERY_ROWS = 16_384
MAX_QUERY_BYTES = 128 << 20
# Scores held at once: few enough to stay in a core's cache.
CELLS_AT_ONCE = 500_000
# Rough ones, of which each is read few times.
ROUGH_CELLS_AT_ONCE = 2_500_000
# Bytes of documents decoded at once.
BYTES_AT_ONCE = 64 << 20
CORPUS_BLOCK = 50_000
QUERY_BLOCK = 16_384
# Documents of a block that a query is kept from as a whole, the fewest where blocks are cut for every core to have
# some, and the most summary rows of all blocks.
BOUNDED_BLOCK = 8_192
LEAST_BLOCK = 1_024
MAX_SUMMARY_ROWS = 4_000_000
# Share of all queries and blocks from which keeping queries away does not pay.
MOST_BLOCKS = 0.5
# Pairs put aside per query and hit before they are ranked.
PAIRS_AT_ONCE = 2
# Scores this close may round to the same value.
_SLACK = 2 * 10.0**-C.SCORE_DIGITS


class Scorer(Protocol):
    """Scores blocks of queries against blocks of documents."""

    def queries(self, table: pa.Table) -> Any:
        """Decode the query columns once per task."""

    def documents(self, table: pa.Table, queries: Any) -> Any:
        """Decode the columns of a block of documents."""

    def score(self, queries: Any, documents: Any, start: int, stop: int) -> np.ndarray:
        """Scores of queries ``start:stop`` (rows); minus infinity marks no match."""


class BoundedScorer(Scorer, Protocol):
    """A scorer that can tell which queries a block of documents can't serve, so these are left out."""

    block_rows: int

    def order(self, table: pa.Table) -> pa.Table:
        """The documents so that like ones stand together."""

    def bounds(self, queries: Any, documents: Any) -> np.ndarray:
        """What no document of the block can exceed, for each query."""

    def take(self, queries: Any, rows: np.ndarray) -> Any:
        """Some of the queries, by rising place."""

    def summary(self, corpus: DataFrame, queries: DataFrame) -> DataFrame:
        """What the rows of equal ``block`` hold at most: ``block, name, term, low, high``."""

    def blocks(self, summary: pa.Table, n: int, queries: Any) -> Any:
        """Decode the summary of ``n`` blocks."""

    def block_bounds(self, queries: Any, blocks: Any, start: int, stop: int) -> np.ndarray:
        """What no document of each block can exceed, for queries ``start:stop`` (rows)."""


class RoughScorer(Scorer, Protocol):
    """A scorer that first tells roughly which pairs may be among the best, and scores these alone."""

    #: Only some pairs match, and a document counts once for a query, whatever the number of its rows.
    distinct: bool

    def valid(self, decoded: Any) -> np.ndarray:
        """Which of the decoded rows can match at all."""

    def rough(self, queries: Any, documents: Any, start: int, stop: int) -> tuple[np.ndarray, float]:
        """Rough scores of queries ``start:stop`` (rows), not a number for no match, and how far they may be off."""

    def matching(self, queries: Any, documents: Any, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Which of the pairs match."""

    def exact(self, queries: Any, documents: Any, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Scores of the pairs."""


class _Best:
    """Running best ``k`` documents of every query; ties go to the smaller id.

    ``bars`` are scores that the k-th best document of a query is known to reach.
    """

    def __init__(self, query_ids: list, k: int, bars: np.ndarray | None = None, distinct: bool = False):
        self.k = k
        self.distinct = distinct
        self.aside: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.query_ids = query_ids
        self.barred = bars is not None
        self.bar = np.full(len(query_ids), -np.inf) if bars is None else bars.copy()
        self.matches = np.zeros(len(query_ids), np.int64)
        self.rows = np.empty(0, np.int64)
        self.scores = np.empty(0)
        self.ids = np.empty(0, object)

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in a block; rows are ``queries`` by rising place, columns documents by rising id.

        Scores are rounded after a first cut with some slack, so most are never rounded.
        """
        k, (height, width) = self.k, scores.shape
        self.matches[queries] += np.count_nonzero(scores > -np.inf, axis=1)
        bar = self.bar[queries]
        close = scores >= (bar - _SLACK)[:, None]
        close &= scores > -np.inf
        if width > k and np.count_nonzero(close) > 4 * k * height:
            bar = np.maximum(bar, np.partition(scores, width - k, axis=1)[:, width - k])
            close &= scores >= (bar - _SLACK)[:, None]
        rows, cols = np.nonzero(close)
        if not len(rows):
            return
        values = np.round(scores[rows, cols], C.SCORE_DIGITS)
        rows, cols, values = self._cut(rows, cols, values, cols)
        own = np.zeros(len(self.bar), dtype=bool)
        own[queries] = True
        keep = own[self.rows]
        all_rows = np.concatenate([self.rows[keep], queries[rows]])
        all_scores = np.concatenate([self.scores[keep], values])
        all_ids = np.concatenate([self.ids[keep], ids[cols]])
        order = np.unique(all_ids, return_inverse=True)[1]
        best = self._cut(all_rows, all_ids, all_scores, order)
        self.rows = np.concatenate([self.rows[~keep], best[0]])
        self.ids = np.concatenate([self.ids[~keep], best[1]])
        self.scores = np.concatenate([self.scores[~keep], best[2]])
        counts = np.bincount(best[0], minlength=len(self.bar))
        worst = np.full(len(self.bar), np.inf)
        np.minimum.at(worst, best[0], best[2])
        full = counts >= k
        self.bar[full] = worst[full]

    def put_aside(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in pairs that reached the bar; many are ranked at once."""
        self.aside.append((rows, ids, np.round(scores, C.SCORE_DIGITS)))
        if sum(len(x[0]) for x in self.aside) > PAIRS_AT_ONCE * self.k * len(self.bar):
            self.settle()

    def settle(self) -> None:
        """Rank what was put aside."""
        if not self.aside:
            return
        held = [(self.rows, self.ids, self.scores)] if len(self.rows) else []
        rows, ids, scores = (np.concatenate(x) for x in zip(*held, *self.aside))
        self.aside = []
        tie = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        if self.distinct:
            order = np.lexsort((-scores, tie, rows))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (rows[order[1:]] != rows[order[:-1]]) | (tie[order[1:]] != tie[order[:-1]])
            rows, ids, scores, tie = (x[order[new]] for x in (rows, ids, scores, tie))
        self.rows, self.ids, self.scores = self._cut(rows, ids, scores, tie)
        full = np.flatnonzero(np.bincount(self.rows, minlength=len(self.bar)) >= self.k)
        # Rows are in order, so the last of a query is its worst.
        last = np.searchsorted(self.rows, full, side="right") - 1
        self.bar[full] = np.maximum(self.bar[full], self.scores[last])

    def _cut(self, rows, payload, scores, tie):
        order = np.lexsort((tie, -scores, rows))
        rows = rows[order]
        first = np.searchsorted(rows, rows, side="left")
        kept = order[np.arange(len(rows)) - first < self.k]
        return rows[np.arange(len(rows)) - first < self.k], payload[kept], scores[kept]

    def table(self, query_type: pa.DataType, doc_type: pa.DataType) -> pa.RecordBatch:
        # The first row of a query carries the number of its matches in the block.
        self.settle()
        order = np.argsort(self.rows, kind="stable")
        rows, ids, scores = self.rows[order], self.ids[order], self.scores[order]
        first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.empty(0, bool)
        return pa.record_batch(
            [
                pa.array([self.query_ids[r] for r in rows], query_type),
                pa.array(list(ids) if ids.dtype == object else ids, doc_type),
                pa.array(scores, pa.float64()),
                pa.array(np.where(first, self.matches[rows], 0), pa.int64()),
            ],
            names=["query_id", "doc_id", "score", "matches"],
        )


def _offer_block(best: _Best, scorer: Scorer, queries: Any, positions: dict, table: pa.Table, exclude_self: bool) -> None:
    """Score one block of documents, of a scorer with bounds in small blocks of like documents."""
    if not best.barred:
        for part in _pieces(table):
            _offer_part(best, scorer, queries, np.arange(len(best.query_ids)), positions, part, exclude_self)
        return
    table = scorer.order(table)
    for start in range(0, table.num_rows, scorer.block_rows):
        part = table.slice(start, scorer.block_rows).sort_by("doc_id")
        documents = scorer.documents(part, queries)
        rows = np.nonzero(scorer.bounds(queries, documents) >= best.bar - _SLACK)[0]
        if len(rows):
            chosen = queries if len(rows) == len(best.bar) else scorer.take(queries, rows)
            _offer_part(best, scorer, chosen, rows, positions, part, exclude_self, documents)


def _pieces(table: pa.Table) -> Iterator[pa.Table]:
    """All rows in pieces of at most ``BYTES_AT_ONCE`` bytes; a longer row stands alone."""
    if table.nbytes <= BYTES_AT_ONCE or table.num_rows < 2:
        yield table
        return
    half = table.num_rows // 2
    yield from _pieces(table.slice(0, half))
    yield from _pieces(table.slice(half))


def _offer_part(best, scorer, queries, rows: np.ndarray, positions: dict, table: pa.Table, exclude_self: bool, documents=None) -> None:
    """Score some queries (``rows`` of all) against documents, in chunks of queries that bound the memory."""
    table = table.sort_by("doc_id")
    documents = scorer.documents(table, queries) if documents is None else documents
    ids = np.array(table["doc_id"].to_pylist(), dtype=object)
    own = None
    if exclude_self:
        place = np.full(len(best.query_ids) + 1, -1)
        place[rows] = np.arange(len(rows))
        own = place[[positions.get(i, -1) for i in ids]]
    step = max(1, CELLS_AT_ONCE // max(1, len(ids)))
    if hasattr(scorer, "rough"):
        step = max(1, ROUGH_CELLS_AT_ONCE // max(1, len(ids)))
        if pa.types.is_integer(table.schema.field("doc_id").type) and not table["doc_id"].null_count:
            ids = table["doc_id"].to_numpy()
        _offer_rough(best, scorer, queries, rows, documents, ids, own, step)
        return
    for start in range(0, len(rows), step):
        stop = min(start + step, len(rows))
        scores = scorer.score(queries, documents, start, stop)
        if own is not None:
            mine = (own >= start) & (own < stop)
            scores[own[mine] - start, np.nonzero(mine)[0]] = -np.inf
        best.offer(rows[start:stop], scores, ids)


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``mask.nonzero()``, faster where little is true."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _offer_rough(best: _Best, scorer: RoughScorer, queries, rows: np.ndarray, documents, ids: np.ndarray, own: np.ndarray | None, step: int) -> None:
    """Score exactly only the pairs whose rough score may reach the bar of their query."""
    usable = scorer.valid(documents)
    if not usable.any():
        return
    asking = scorer.valid(queries)
    best.matches[rows[asking]] += np.count_nonzero(usable)
    if own is not None:
        mine = own[usable & (own >= 0)]
        np.subtract.at(best.matches, rows[mine[asking[mine]]], 1)
    # A document may fill as many places as it has rows.
    need = best.k * int(np.unique(ids, return_counts=True)[1].max()) if best.distinct else best.k
    for start in range(0, len(rows), step):
        stop = min(start + step, len(rows))
        scores, off = scorer.rough(queries, documents, start, stop)
        if own is not None:
            mine = (own >= start) & (own < stop)
            scores[own[mine] - start, np.nonzero(mine)[0]] = np.nan
        height, width = scores.shape
        held = rows[start:stop]
        close = scores >= (best.bar[held] - off - _SLACK)[:, None].astype(scores.dtype)
        if width > 4 * need and np.count_nonzero(close) > 8 * need * height:
            # Bars from every fourth document, and the pairs that reach them.
            part = np.nan_to_num(scores[:, ::4], nan=-np.inf)
            low = np.partition(part, part.shape[1] - need, axis=1)[:, part.shape[1] - need] - 2 * off - _SLACK
            at, cols = _places(scores >= np.fmax(low, best.bar[held] - off - _SLACK)[:, None].astype(scores.dtype))
            if best.distinct:
                good = scorer.matching(queries, documents, at + start, cols)
                at, cols = at[good], cols[good]
            full = np.bincount(at, minlength=height) >= need
            at, cols = at[full[at]], cols[full[at]]
            best.bar[held[full]] = np.fmax(best.bar[held[full]], low[full] - off)
            if len(at):
                best.put_aside(rows[at + start], ids[cols], scorer.exact(queries, documents, at + start, cols))
            if full.all():
                continue
            close[full] = False
        # All that may reach the bar, where no better one was found.
        at, cols = _places(close)
        if best.distinct and len(at):
            good = scorer.matching(queries, documents, at + start, cols)
            at, cols = at[good], cols[good]
        if len(at):
            best.put_aside(rows[at + start], ids[cols], scorer.exact(queries, documents, at + start, cols))


def _setup(scorer: Scorer, query_table: pa.Table, k: int, exclude_self: bool):
    query_ids = query_table["query_id"].to_pylist()
    positions = {q: i for i, q in enumerate(query_ids)} if exclude_self else {}
    bars = None
    if "bar" in query_table.column_names:
        bars = pc.fill_null(query_table["bar"].combine_chunks(), -np.inf).to_numpy(zero_copy_only=False)
    return _Best(query_ids, k, bars, getattr(scorer, "distinct", False)), scorer.queries(query_table), positions


def own_block_bars(both: DataFrame, scorer: Scorer, k: int, query_columns: Sequence[str], rows: int) -> DataFrame:
    """``query_id, bar``: the ``k``-th best score of each query among the ``rows`` documents it stands with.

    ``both`` holds queries that are documents too, like ones next to each other; the work grows with its rows.
    """
    ship_package(both.sparkSession)
    documents = [c for c in both.columns if c not in query_columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best_of(part: pa.Table) -> pa.RecordBatch:
            table = part.select(list(query_columns))
            best, queries, positions = _setup(scorer, table, k, False)
            renamed = part.select(documents).rename_columns([c.removeprefix("_doc_") for c in documents])
            _offer_part(best, scorer, queries, np.arange(len(table)), positions, renamed, False)
            return pa.record_batch([table["query_id"].combine_chunks(), pa.array(best.bar)], names=["query_id", "bar"])

        held = None
        for batch in batches:
            # Even pieces, the last one waiting for more rows, as a short one would give low bars.
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            pieces = max(1, round(held.num_rows / rows))
            cuts = np.linspace(0, held.num_rows, pieces + 1).astype(int).tolist()
            for start, stop in zip(cuts[:-1], cuts[1:-1]):
                yield best_of(held.slice(start, stop - start).combine_chunks())
            held = held.slice(cuts[-2]).combine_chunks()
        if held is not None and held.num_rows:
            yield best_of(held)

    schema = T.StructType([T.StructField("query_id", both.schema["query_id"].dataType), T.StructField("bar", T.DoubleType())])
    return both.mapInArrow(run, schema)


def _scan(shared, scorer: Scorer, k: int, exclude_self: bool):
    """Task function: one pass over a partition of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_table = shared.value
        best, queries, positions = _setup(scorer, query_table, k, exclude_self)
        doc_type = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            doc_type = table.schema.field("doc_id").type
            _offer_block(best, scorer, queries, positions, table, exclude_self)
        if doc_type is not None:
            yield best.table(query_table.schema.field("query_id").type, doc_type)

    return run


def _cell(scorer: Scorer, k: int, exclude_self: bool, keys: Sequence[str]):
    """Task function: one cell of the grid."""

    def run(docs: pa.Table, query_table: pa.Table) -> pa.Table:
        q_type, d_type = query_table.schema.field("query_id").type, docs.schema.field("doc_id").type
        if not docs.num_rows or not query_table.num_rows:
            return pa.Table.from_batches([_Best([], k).table(q_type, d_type)])
        best, queries, positions = _setup(scorer, query_table.drop_columns(list(keys)), k, exclude_self)
        docs = docs.drop_columns(list(keys))
        for start in range(0, docs.num_rows, 10_000):
            _offer_block(best, scorer, queries, positions, docs.slice(start, 10_000), exclude_self)
        return pa.Table.from_batches([best.table(q_type, d_type)])

    return run


def _result_schema(corpus: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_id", corpus.schema["doc_id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("matches", T.LongType()),
        ]
    )


def grid_topk(
    corpus: DataFrame,
    queries: DataFrame,
    scorer: Scorer,
    k: int,
    *,
    keys: Sequence[str] = (),
    exclude_self: bool = False,
    corpus_block: int | None = None,
    query_block: int | None = None,
) -> DataFrame:
    """Best ``k`` per query and cell (with ``matches`` in it), only pairs with equal ``keys`` being scored.

    A key with more rows than one block is split on both sides, each piece meeting
    every piece of the other side, so a hot key is spread over many tasks.
    """
    ship_package(corpus.sparkSession)
    corpus_block = corpus_block or getattr(scorer, "corpus_block", CORPUS_BLOCK)
    query_block = query_block or getattr(scorer, "query_block", QUERY_BLOCK)
    queries, query_parts = _split(queries, "query_id", keys, query_block, "_q")
    # A small grid is cut finer, for every core to have its cell.
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    at_least = 1 if keys else math.ceil(2 * cores / query_parts)
    corpus, corpus_parts = _split(corpus, "doc_id", keys, corpus_block, "_c", at_least)
    if keys:
        corpus = corpus.join(query_parts, list(keys), "inner")
        queries = queries.join(corpus_parts, list(keys), "inner")
    else:
        corpus = corpus.withColumn("_q_parts", F.lit(query_parts))
        queries = queries.withColumn("_c_parts", F.lit(corpus_parts))
    corpus = corpus.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_q_parts") - 1))).drop("_q_parts")
    queries = queries.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_c_parts") - 1))).drop("_c_parts")
    # Fresh column identities, as both sides may stem from one table.
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    cell = [*keys, "_c", "_q"]
    if not keys:
        # A fixed number of partitions, as little data may still be much work.
        tasks = max(2 * query_parts * corpus_parts, cores)
        corpus, queries = corpus.repartition(tasks, *cell), queries.repartition(tasks, *cell)
    return (
        corpus.groupBy(*cell)
        .cogroup(queries.groupBy(*cell))
        .applyInArrow(_cell(scorer, k, exclude_self, cell), _result_schema(corpus, queries))
    )


def bounded_topk(corpus: DataFrame, queries: DataFrame, scorer: BoundedScorer, k: int, order: Sequence[Column]) -> DataFrame:
    """Best ``k`` per query and block, where ``queries`` have a ``bar``; blocks that can't reach it are left out.

    The corpus is cut into ranges of ``order``, in which like documents stand together. A query goes to the blocks whose
    summary allows a score at its bar; queries of one block, which look at much the same ones, share a cell.
    """
    ship_package(corpus.sparkSession)
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    rows = corpus.count()
    parts = max(math.ceil(rows / BOUNDED_BLOCK), min(2 * cores, math.ceil(rows / LEAST_BLOCK)), 1)
    keys = [f"_order{i}" for i in range(len(order))]
    keyed = corpus.select("*", *[o.alias(n) for o, n in zip(order, keys)])
    # By the id too, so that no value is too frequent to be cut.
    ranged = keyed.repartitionByRange(parts, *keys, "doc_id").drop(*keys)
    blocks = stage(ranged.withColumn("block", F.spark_partition_id()))
    summary = stage(scorer.summary(blocks, queries))
    if not _is_small(summary, MAX_SUMMARY_ROWS, MAX_QUERY_BYTES):
        return grid_topk(corpus, queries, scorer, k)
    shared = corpus.sparkSession.sparkContext.broadcast(summary.toArrow())
    own = blocks.groupBy(F.col("doc_id").alias("query_id")).agg(F.min("block").alias("part"))
    other = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    dealt = queries.join(own, "query_id", "left").withColumn("part", F.coalesce("part", other))
    schema = T.StructType([*dealt.schema.fields, T.StructField("blocks", T.ArrayType(T.IntegerType()))])
    asked = stage(dealt.mapInArrow(_choose(shared, scorer, parts), schema))
    wanted = asked.agg(F.sum(F.size("blocks"))).first()[0] or 0
    if parts > 1 and wanted > MOST_BLOCKS * parts * queries.count():
        return grid_topk(corpus, queries, scorer, k)
    asking = asked.withColumn("block", F.explode("blocks")).drop("blocks")
    cells = stage(asking.select("block", "part").distinct())
    tasks = max(2 * cores, math.ceil(cells.count() / 4))
    cell = ["block", "part"]
    scored = blocks.join(cells, "block").repartition(tasks, *cell).groupBy(*cell)
    return scored.cogroup(asking.repartition(tasks, *cell).groupBy(*cell)).applyInArrow(
        _cell(scorer, k, False, cell), _result_schema(corpus, queries)
    )


def _choose(shared, scorer: BoundedScorer, parts: int):
    """Task function: adds to each query the blocks that may hold a document at its bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS_AT_ONCE // parts)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            bars = pc.fill_null(batch.column("bar"), -np.inf).to_numpy(zero_copy_only=False)
            queries = scorer.queries(table)
            blocks = scorer.blocks(shared.value, parts, queries)
            chosen = []
            for start in range(0, batch.num_rows, step):
                stop = min(start + step, batch.num_rows)
                may = scorer.block_bounds(queries, blocks, start, stop) >= bars[start:stop, None] - _SLACK
                chosen.append((may.sum(axis=1), np.nonzero(may)[1]))
            counts, found = (np.concatenate(x) for x in zip(*chosen)) if chosen else (np.zeros(0, int), np.zeros(0, int))
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "blocks"])

    return run


def _split(df: DataFrame, id_col: str, keys: Sequence[str], block: int, out: str, at_least: int = 1):
    """Add the piece number ``out``; also give the number of pieces (per key)."""
    if not keys:
        parts = max(at_least, math.ceil(df.count() / block))
        return df.withColumn(out, F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")), parts
    parts_col = f"{out}_parts"
    parts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(parts_col))
    hot = parts.where(F.col(parts_col) > 1)
    own = df.join(hot, list(keys), "left").withColumn(
        out, F.pmod(F.xxhash64(id_col), F.coalesce(F.col(parts_col), F.lit(1))).cast("int")
    )
    return own.drop(parts_col), parts


def _is_small(queries: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """True if the query table may go to the driver: its rows and bytes are counted on the executors first."""
    if max_rows < 1:
        return False
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))  # more than the columns take
    rows, taken = queries.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return rows <= max_rows and taken <= max_bytes


def dense_topk(
    corpus: DataFrame,
    queries: DataFrame,
    scorer: Scorer,
    k: int,
    *,
    exclude_self: bool = False,
    with_total: bool = False,
    spread: int | None = None,
    max_query_rows: int = MAX_QUERY_ROWS,
    max_query_bytes: int = MAX_QUERY_BYTES,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Best ``k`` documents per query: ``query_id, doc_id, score, rank``.

    ``with_total`` adds the number of all matching documents.  ``spread`` re-deals
    a corpus that comes in fewer partitions.  With ``order``, by which like documents stand together, many queries with
    a ``bar`` meet only the blocks that may reach it.
    """
    ship_package(corpus.sparkSession)
    if _is_small(queries, max_query_rows, max_query_bytes):
        shared = queries.sparkSession.sparkContext.broadcast(queries.toArrow())
        if spread and corpus.rdd.getNumPartitions() < spread:
            corpus = corpus.repartition(spread, "doc_id")
        partial = corpus.mapInArrow(_scan(shared, scorer, k, exclude_self), _result_schema(corpus, queries))
    elif order is not None and "bar" in queries.columns and not (exclude_self or with_total):
        partial = bounded_topk(corpus, queries, scorer, k, order)
    else:
        partial = grid_topk(corpus, queries, scorer, k, exclude_self=exclude_self)
    if not with_total:
        return top_n(partial.drop("matches"), k)
    partial = stage(partial)  # read twice: to rank and to count
    totals = partial.groupBy("query_id").agg(F.sum("matches").alias("total"))
    return top_n(partial.drop("matches"), k).join(totals, "query_id")
