"""Numbers of word pieces of whole texts by a linear longest-match automaton.

A trie of the vocabulary gets failure links: where no longer piece matches, the link leads to the node of what is
left after popping the longest pieces, and each node holds how many pieces that pops. Counts come without
building a piece, in one pass over a word.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm.columns import append_columns, held_in_worker
from vitrine.llm.units import UnitCache, sums

UNKNOWN = -1


class Automaton:
    """Greedy longest-match counts of byte strings over a vocabulary of byte strings."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: dict[int, int] = {}
        final = [False]
        children: list[list[tuple[int, int]]] = [[]]
        for piece in pieces:
            node = 0
            for byte in piece:
                code = node << 8 | byte
                if (child := self.next.get(code)) is None:
                    child = self.next[code] = len(final)
                    children[node].append((byte, child))
                    final.append(False)
                    children.append([])
                node = child
            if piece:
                final[node] = True
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in children[node]:
                queue.append(child)
                if final[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                at, popped = self.fail[node], self.popped[node]
                while at >= 0 and (at << 8 | byte) not in self.next:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.next[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word, ``UNKNOWN`` if some part matches none."""
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for byte in word:
            while (after := step.get(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return UNKNOWN
                total += popped[node]
                node = fail[node]
            node = after
        while node:
            if fail[node] < 0:
                return UNKNOWN
            total += popped[node]
            node = fail[node]
        return total


def _counts(pieces: list[bytes], lead: bytes) -> UnitCache:
    count = Automaton(pieces).count

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [u.strip() for u in units]
        values = [count(lead + w) for w in words if w]
        return np.array(values, dtype=np.int32), np.array([1 if w else 0 for w in words], dtype=np.int64)

    return UnitCache(encode)


def count_pieces(df: DataFrame, pieces: list[bytes], text_col: str = "text", lead: bytes = b" ", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_words``, ``n_tokens`` and ``n_unknown`` of each whole text.

    Words stand between ASCII white space; each is matched greedily after ``lead``, which vocabularies put before a
    word. A word with a part that no piece matches counts as one token and one unknown word. The vocabulary
    reaches the tasks by broadcast and is as large as its file. Null and empty texts give zeros, repeated rows each
    their own counts, an empty table no rows; columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(sorted(set(pieces)))
    key = hash((tuple(shared.value), lead))

    def make():
        cache = held_in_worker(("pieces", key), lambda: _counts(shared.value, lead))

        def work(texts: pa.Array) -> list[pa.Array]:
            values, offsets = cache.sequences(texts)
            unknown = values == UNKNOWN
            tokens = sums(np.where(unknown, 1, values).astype(np.int64), offsets)
            return [pa.array(np.diff(offsets)), pa.array(tokens), pa.array(sums(unknown.astype(np.int64), offsets))]

        return work

    fields = [T.StructField(name, T.LongType(), True) for name in ("n_words", "n_tokens", "n_unknown")]
    return append_columns(df, text_col, make, fields, keep)
