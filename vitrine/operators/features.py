"""Block scorer of BM25-weighted features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vitrine import constants as C
from vitrine.operators.terms import SearchField

# Share of a block's documents from which a term counts as frequent, and the most such terms.
FREQUENT = 0.01
# Words of documents that are looked up at once.
WORDS_AT_ONCE = 500_000
MOST_FREQUENT = 128


class FeatureScorer:
    """Field scores are sums over matching terms; the best field, or all of them, count.

    Query rows hold ``features(field, term, avg_length, weight)``.  Document rows hold,
    per text field, the list of its words (with ``#tf`` and ``#length`` columns where
    equal words are already counted), and per exact field its value.
    """

    def __init__(self, fields: Sequence[SearchField], best_field: bool):
        self.fields = tuple(fields)
        self.best_field = best_field
        self._room: dict[str, np.ndarray] = {}

    def room(self, name: str, height: int, width: int) -> np.ndarray:
        """A reused array; fresh ones of this size cost more than the arithmetic in them."""
        if name not in self._room or self._room[name].size < height * width:
            self._room[name] = np.empty(height * width)
        return self._room[name][: height * width].reshape(height, width)

    def queries(self, table: pa.Table):
        """Per field: its distinct terms, and who wants which, by rising query."""
        lists = table["features"].combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        owner = np.repeat(np.arange(len(lists)), lengths)
        flat = lists.flatten()
        names = flat.field("field")
        sparse = {None: len(lists)}  # the number of queries
        for item in self.fields:
            at = np.nonzero(pc.equal(names, item.name).to_numpy(zero_copy_only=False))[0]
            if not len(at):
                continue
            terms = flat.field("term").take(pa.array(at)).dictionary_encode()
            weights = flat.field("weight").to_numpy()[at]
            average = flat.field("avg_length").to_numpy()[at[0]]
            sparse[item.name] = (terms.dictionary, owner[at], terms.indices.to_numpy(), weights, average)
        return sparse

    def documents(self, table: pa.Table, queries):
        """Per field: documents grouped by term, with the BM25 saturation of the pair."""
        sparse = {}
        for item in self.fields:
            if item.name not in queries:
                continue
            vocabulary, *_, average = queries[item.name]
            if item.exact:
                codes = pc.index_in(table[item.name].combine_chunks(), value_set=vocabulary)
                docs = np.nonzero(pc.is_valid(codes).to_numpy(zero_copy_only=False))[0]
                codes, worth = codes.drop_null().to_numpy(), np.ones(len(docs))
            else:
                docs, codes, worth = _saturated(table, item.name, vocabulary, average)
            sparse[item.name] = _by_term(docs, codes, worth, len(vocabulary), table.num_rows)
        return sparse, table.num_rows

    def blocks(self, summary: pa.Table, n: int, queries):
        """As ``documents``, for ``n`` blocks: each holds a term as in its document where it is worth most."""
        sparse = {}
        for item in self.fields:
            if item.name not in queries:
                continue
            vocabulary = queries[item.name][0]
            mine = summary.filter(pc.equal(summary["name"], item.name))
            codes = pc.index_in(mine["term"].combine_chunks(), value_set=vocabulary)
            known = np.nonzero(pc.is_valid(codes).to_numpy(zero_copy_only=False))[0]
            block, worth = mine["block"].to_numpy()[known], mine["high"].to_numpy()[known]
            sparse[item.name] = _by_term(block, codes.drop_null().to_numpy(), worth, len(vocabulary), n)
        return sparse, n

    def bounds(self, queries, documents) -> np.ndarray:
        """What no document of the block exceeds: every term of a query as in the document where it is worth most."""
        sparse, n = documents
        total = np.zeros(self.height(queries))
        for name, (_, worth, bounds, _, _) in sparse.items():
            _, owner, codes, weights, _ = queries[name]
            most = np.zeros(len(bounds) - 1)
            held = np.nonzero(np.diff(bounds))[0]
            if len(held):
                most[held] = np.maximum.reduceat(worth, bounds[held])
            field = np.bincount(owner, weights * most[codes], minlength=len(total))
            total = np.maximum(total, field) if self.best_field else total + field
        return total

    def take(self, queries, rows: np.ndarray):
        place = np.full(self.height(queries), -1)
        place[rows] = np.arange(len(rows))
        out = {None: len(rows)}
        for name, held in queries.items():
            if name is None:
                continue
            vocabulary, owner, codes, weights, average = held
            own = place[owner]
            kept = own >= 0
            out[name] = (vocabulary, own[kept], codes[kept], weights[kept], average)
        return out

    @staticmethod
    def height(queries) -> int:
        return queries[None]

    def score(self, queries, documents, start: int, stop: int) -> np.ndarray:
        total = self.sums(queries, documents, start, stop)
        total[total <= 0] = -np.inf
        return total

    def sums(self, queries, documents, start: int, stop: int) -> np.ndarray:
        """Feature scores of queries ``start:stop``; every match is worth more than zero."""
        sparse, width = documents
        total = self.room("total", stop - start, width)
        total[:] = 0
        for name, (docs, worth, bounds, row_of, matrix) in sparse.items():
            _, owner, codes, weights, _ = queries[name]
            lo, hi = np.searchsorted(owner, [start, stop])
            mine, codes, weights = owner[lo:hi] - start, codes[lo:hi], weights[lo:hi]
            row = row_of[codes]
            wanted = np.zeros((stop - start, len(matrix)))
            wanted[mine[row >= 0], row[row >= 0]] = weights[row >= 0]
            scores = np.matmul(wanted, matrix, out=self.room("field", stop - start, width))
            order = np.nonzero((row < 0) & (bounds[codes + 1] > bounds[codes]))[0]
            order = order[np.argsort(codes[order], kind="stable")]
            terms, first = np.unique(codes[order], return_index=True)
            for term, group in zip(terms, np.split(order, first[1:])):
                d = slice(bounds[term], bounds[term + 1])
                scores[np.ix_(mine[group], docs[d])] += np.outer(weights[group], worth[d])
            if self.best_field:
                np.maximum(total, scores, out=total)
            else:
                total += scores
        return total


def _by_term(docs: np.ndarray, codes: np.ndarray, worth: np.ndarray, terms: int, n: int):
    """What ``FeatureScorer.sums`` reads of a field: the ``n`` documents grouped by term."""
    order = np.lexsort((docs, codes))
    docs, worth = docs[order], worth[order]
    bounds = np.searchsorted(codes[order], np.arange(terms + 1))
    # Frequent terms as a matrix, which multiplies faster than it is looked up.
    counts = np.diff(bounds)
    frequent = np.argsort(-counts, kind="stable")[:MOST_FREQUENT]
    frequent = frequent[counts[frequent] >= FREQUENT * n]
    matrix = np.zeros((len(frequent), n))
    for row, term in enumerate(frequent):
        matrix[row, docs[bounds[term] : bounds[term + 1]]] = worth[bounds[term] : bounds[term + 1]]
    row_of = np.full(terms, -1)
    row_of[frequent] = np.arange(len(frequent))
    return docs, worth, bounds, row_of, matrix


def _saturated(table: pa.Table, name: str, vocabulary: pa.Array, average: float):
    """(document, term, saturation) of every pair that occurs in a text field."""
    column = table[name].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    counted = f"{name}#tf" in table.column_names
    parts, start = [], 0
    ends = np.cumsum(lengths)
    while start < len(lengths):
        taken = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, taken + WORDS_AT_ONCE, side="right")))
        part, sizes = column.slice(start, stop - start), lengths[start:stop]
        codes = pc.index_in(part.flatten(), value_set=vocabulary)
        valid = pc.is_valid(codes).to_numpy(zero_copy_only=False)
        docs = np.repeat(np.arange(start, stop), sizes)[valid]
        pairs = docs * len(vocabulary) + codes.drop_null().to_numpy().astype(np.int64)
        if counted:
            tf = table[f"{name}#tf"].combine_chunks().slice(start, stop - start).flatten().to_numpy()[valid]
        else:
            pairs, tf = np.unique(pairs, return_counts=True)
        parts.append((pairs, tf))
        start = stop
    if not parts:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    pairs, tf = (np.concatenate(x) for x in zip(*parts))
    del parts
    if counted:
        lengths = pc.fill_null(table[f"{name}#length"].combine_chunks(), 0).to_numpy()
    docs, codes = pairs // len(vocabulary), pairs % len(vocabulary)
    norm = C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * lengths[docs] / average)
    return docs, codes, (C.BM25_K1 + 1) * tf / (tf + norm)
