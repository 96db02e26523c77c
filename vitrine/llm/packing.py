"""Pack token sequences of whole documents into training sequences under several limits at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.columns import quoted, release, slices
from vitrine.llm.word_tokens import word_tokens
from vitrine.session import ship_package

#: Pieces that wait in a task for a sequence that suits them.
POOL = 1024
#: Bytes of text that a task codes at once, about 60 bytes of scratch space for each.
CODED_BYTES = 3 << 19
SCHEMA = (
    "start long, length long, ids binary, loss_tokens long, doc_tokens long, "
    "sequence_id long, offset long, padded_length long"
)


class Packer:
    """Vector bin packing of pieces by the dot-product heuristic.

    A piece asks for tokens, one segment and loss-bearing tokens, as shares of the limits. The open sequence takes
    the waiting piece whose demand has the largest dot product with what it has left, until none fits; the rest of
    its tokens is filled by cutting a piece. A sequence that ends short of ``tokens`` is divided into sequences
    whose lengths are powers of two, which need no padding.
    """

    def __init__(self, tokens: int, segments: int, loss: int):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([tokens, segments, loss], dtype=np.float64)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.length = np.zeros(2 * POOL, dtype=np.int64)
        self.lossy = np.zeros(2 * POOL, dtype=np.int64)
        self.waiting: list[tuple[int, int, int]] = []  # document, start, end
        self.ids: dict[int, tuple[np.ndarray, int, int]] = {}  # ids, first loss-bearing id, pieces to come
        self.out: list[tuple] = []
        self.sequences = 0

    def _losses(self, doc: int, start: int, end: int) -> int:
        return max(0, end - max(start, self.ids[doc][1]))

    def _wait(self, doc: int, start: int, end: int) -> None:
        at = len(self.waiting)
        self.waiting.append((doc, start, end))
        self.length[at], self.lossy[at] = end - start, self._losses(doc, start, end)

    def _take(self, at: int) -> tuple[int, int, int]:
        piece, last = self.waiting[at], self.waiting.pop()
        if at < len(self.waiting):
            self.waiting[at] = last
            self.length[at], self.lossy[at] = self.length[len(self.waiting)], self.lossy[len(self.waiting)]
        return piece

    def _fit(self, doc: int, start: int, end: int, tokens: int, loss: int) -> int:
        """Where a piece must end to ask for no more than this."""
        end = min(end, start + tokens)
        return min(end, max(start, self.ids[doc][1]) + loss)

    def add(self, doc: int, ids: np.ndarray, first_loss: int) -> None:
        """Take in a document: whole sequences at once, the rest waits."""
        self.ids[doc] = (ids, first_loss)
        start = 0
        while len(ids) - start >= self.tokens and self._fit(doc, start, len(ids), self.tokens, self.loss) == start + self.tokens:
            self._emit([(doc, start, start + self.tokens)])
            start += self.tokens
        while start < len(ids):
            end = self._fit(doc, start, len(ids), self.tokens, self.loss)
            self._wait(doc, start, end)
            start = end
            while len(self.waiting) >= POOL:
                self._fill()

    def finish(self) -> None:
        while self.waiting:
            self._fill()

    def _fill(self) -> None:
        """Pack one sequence."""
        left = np.array([self.tokens, self.segments, self.loss], dtype=np.int64)
        packed: list[tuple[int, int, int]] = []
        while self.waiting and left[0] and left[1]:
            n = len(self.waiting)
            length, lossy = self.length[:n], self.lossy[:n]
            fits = (length <= left[0]) & (lossy <= left[2])
            share = left / self.limits
            score = length * (share[0] / self.tokens) + lossy * (share[2] / self.loss) + share[1] / self.segments
            if fits.any():
                piece = self._take(int(np.argmax(np.where(fits, score, -1.0))))
            else:  # nothing fits: cut the piece that leaves the most of itself
                at = int(np.argmax(length))
                doc, start, end = self.waiting[at]
                cut = self._fit(doc, start, end, int(left[0]), int(left[2]))
                if cut == start:
                    break
                self._take(at)
                self._wait(doc, cut, end)
                piece = (doc, start, cut)
            packed.append(piece)
            left -= [piece[2] - piece[1], 1, self._losses(*piece)]
        self._emit(packed)

    def _emit(self, pieces: list[tuple[int, int, int]]) -> None:
        total = sum(end - start for _, start, end in pieces)
        room = total if total == self.tokens else 1 << (total.bit_length() - 1)
        offset = 0
        for doc, start, end in pieces:
            while start < end:
                stop = min(end, start + room - offset)
                ids = self.ids[doc][0]
                self.out.append((doc, start, stop, ids[start:stop].tobytes(), self._losses(doc, start, stop), len(ids), self.sequences, offset, room))
                offset += stop - start
                start = stop
                if offset == room:
                    self.sequences += 1
                    total -= room
                    room, offset = (1 << (total.bit_length() - 1) if total else 0), 0

    def flush(self) -> list[tuple]:
        """Packed pieces so far; documents without waiting pieces are forgotten."""
        out, self.out = self.out, []
        open_ = {doc for doc, _, _ in self.waiting}
        self.ids = {doc: held for doc, held in self.ids.items() if doc in open_}
        return out


def coded_parts(batch: pa.RecordBatch, tokens: Callable) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Parts of a batch (an id and its texts) of about ``CODED_BYTES`` each, with the ids and offsets of every text column."""
    for begin, stop in slices(batch.column(batch.num_columns - 1), CODED_BYTES):
        part = batch.slice(begin, stop - begin)
        yield part, [tokens(part.column(i)) for i in range(1, part.num_columns)]


def pack_documents(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 64,
    max_loss: int = 2048,
) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most ``max_tokens`` ids.

    Each row is a document: the ids of ``prompt_col`` (if given), which bear no loss, those of ``text_col`` and
    ``end_id``. A sequence has at most ``max_segments`` pieces and ``max_loss`` loss-bearing ids. One row per piece:
    the id column, ``start`` and ``length`` in the document, ``ids`` (32-bit, little-endian), ``loss_tokens``,
    ``doc_tokens``, ``sequence_id``, ``offset`` there and ``padded_length``: sequences whose length is a power of
    two stay as they are, and all others have ``max_tokens`` ids, so padding is needed only if that is no power
    of two.

    Each task packs its own rows, in their order, so a lost task gives the same pieces again and nothing is
    shuffled. A null or empty text is the end id alone; repeated rows and ids are packed each for itself; an empty
    table gives no rows; other columns are left out. An id column named as an output column is an error.
    """
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    if id_col.lower() in names:
        raise ValueError(f"the id column may not be named {id_col}")
    ship_package(df.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    key = hash(shared.value)
    text = [F.coalesce(F.col(quoted(c)), F.lit("")) for c in ([prompt_col] if prompt_col else []) + [text_col]]
    source = df.select(F.col(quoted(id_col)), *[c.alias(f"__text{i}") for i, c in enumerate(text)])
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(key, shared.value)
        packer = Packer(max_tokens, max_segments, max_loss)
        first = TaskContext.get().partitionId() << 36
        keys: dict[int, object] = {}
        count = 0
        end = np.array([end_id], dtype="<u4")

        def rows(id_type) -> Iterator[pa.RecordBatch]:
            packed = packer.flush()
            if not packed:
                return
            doc, start, stop, ids, loss, size, sequence, offset, room = zip(*packed)
            begin = np.array(start, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[d] for d in doc], id_type), pa.array(begin), pa.array(np.array(stop, dtype=np.int64) - begin),
                    pa.array(ids, pa.binary()), pa.array(loss, pa.int64()), pa.array(size, pa.int64()),
                    pa.array(np.array(sequence, dtype=np.int64) + first), pa.array(offset, pa.int64()), pa.array(room, pa.int64()),
                ],
                names=[id_col, *names],
            )
            for d in [d for d in keys if d not in packer.ids]:
                del keys[d]

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for part, coded in coded_parts(batch, tokens):
                for row, value in enumerate(part.column(0).to_pylist()):
                    runs = [ids[ends[row] : ends[row + 1]].astype("<u4") for ids, ends in coded]
                    keys[count] = value
                    packer.add(count, np.concatenate([*runs, end]), len(runs[0]) if prompt_col else 0)
                    count += 1
                yield from rows(id_type)
        packer.finish()
        if id_type is not None:
            yield from rows(id_type)
        release()

    return source.mapInArrow(run, f"{quoted(id_col)} {kind}, {SCHEMA}")
