"""Pack pieces of documents into few sequences: dominance reduction first, best fit for what is left.

All that decides how many sequences are needed is how many pieces there are of each length, at most ``max_tokens``
numbers. The reduction fixes sequences that some best packing has, as no other set of pieces could stand for them
(Martello and Toth: one, two or three pieces that dominate every feasible set with the longest of them); it goes on with the
shrunk instance until nothing more can be fixed. The rest is packed by best fit, longest pieces first. Pieces of one
length are interchangeable: the plan says which of them, by number, lie where, and the pieces are numbered and
placed in parallel.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.llm.columns import quoted, release, slices
from vitrine.llm.units import ragged
from vitrine.llm.word_tokens import word_tokens
from vitrine.session import ship_package, stage

SCHEMA = "piece int, start long, length long, ids binary"
PLACED = "sequence_id long, offset long"


class Sizes:
    """How many pieces there are of each length."""

    def __init__(self, counts: dict[int, int]):
        self.count = {size: n for size, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.remove(size)

    def put(self, size: int, n: int) -> None:
        if size not in self.count:
            insort(self.order, size)
        self.count[size] = self.count.get(size, 0) + n

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for size in self.order:
            out += [size] * min(self.count[size], n - len(out))
            if len(out) == n:
                break
        return out

    def largest_within(self, room: int) -> int:
        """The longest piece of at most ``room``; 0 if there is none."""
        at = bisect_right(self.order, room)
        return self.order[at - 1] if at else 0

    def best_pair(self, room: int) -> int:
        """The largest sum within ``room`` of two pieces; 0 if there is none."""
        best, low, high = 0, 0, bisect_right(self.order, room) - 1
        while low <= high:
            a, b = self.order[low], self.order[high]
            if a + b > room or (low == high and self.count[a] < 2):
                high -= 1
            else:
                best = max(best, a + b)
                low += 1
        return best

    def just_above(self, size: int, n: int) -> list[int]:
        """The ``n`` shortest pieces longer than ``size``."""
        out: list[int] = []
        for bigger in self.order[bisect_right(self.order, size) :]:
            out += [bigger] * min(self.count[bigger], n - len(out))
            if len(out) == n:
                break
        return out


def dominant_set(sizes: Sizes, longest: int, capacity: int) -> tuple[tuple[int, ...], int] | None:
    """Pieces that dominate every feasible set with a piece of length ``longest``, and how often that holds in a row."""
    own, room = sizes.count[longest], capacity - longest
    sizes.take(longest, 1)
    try:
        small = sizes.smallest(3)
        fit = sum(1 for total in np.cumsum(small) if total <= room)
        if fit == 0:
            return (longest,), own
        partner = sizes.largest_within(room)
        pairs = own // 2 if partner == longest else min(own, sizes.count.get(partner, 0))
        if fit == 1 or partner == room:
            return (longest, partner), pairs
        if fit > 2:
            return None
        best = sizes.best_pair(room)
        if partner >= best:
            return (longest, partner), pairs
        sizes.take(partner, 1)
        third = sizes.largest_within(room - partner)
        above = sizes.just_above(third, 2)
        between = [size for size in above if size <= partner] if third < partner else []
        sizes.put(partner, 1)
        if not third or partner + third != best or not (len(between) < 2 or sum(between) > room):
            return None
        chosen = (longest, partner, third)
        if len(set(chosen)) < 3:
            return chosen, 1
        return chosen, max(1, min(own, sizes.count[partner], sizes.count[third]) - 2)
    finally:
        sizes.put(longest, 1)


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences that some best packing has, with their number, and the pieces that are left."""
    sizes, fixed = Sizes(counts), []
    changed = True
    while changed:
        changed = False
        for longest in sizes.order[::-1]:
            while longest in sizes.count:
                found = dominant_set(sizes, longest, capacity)
                if found is None:
                    break
                for size in found[0]:
                    sizes.take(size, found[1])
                fixed.append(found)
                changed = True
    return fixed, sizes.count


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences as ((length, copies), ...) with their number: longest pieces first, each where least room is left.

    Pieces of one length and sequences of one content are handled together.
    """
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, content, n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((content, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                each, room, content, n = capacity // size, capacity, (), left
            else:
                room = rooms[at]
                content, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                each = room // size
            full = min(n, left // each)
            put(room - each * size, (*content, (size, each)), full)
            left -= full * each
            n -= full
            if n and left:  # the last of them, fewer than fit
                put(room - left * size, (*content, (size, left)), 1)
                left, n = 0, n - 1
            if content:
                put(room, content, n)
    return [each for room in rooms for each in open_[room]]


@dataclass
class Plan:
    """Where the pieces of each length go: rows (length, first, last, sequence, copies, offset).

    Piece ``n`` of a length, from 0, with first <= n < last lies in sequence ``sequence + (n - first) div copies`` at
    ``offset + (n - first) % copies * length``.
    """

    sequences: int = 0
    fixed: int = 0
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """A packing of ``counts[length]`` pieces of each length, none longer than ``capacity``."""
    if any(size < 1 or size > capacity for size in counts):
        raise ValueError("pieces must have 1 to capacity tokens")
    fixed, left = reduce(counts, capacity)
    plan = Plan(fixed=sum(n for _, n in fixed))
    used: dict[int, int] = {}
    grouped = [(tuple((s, pieces.count(s)) for s in sorted(set(pieces), reverse=True)), n) for pieces, n in fixed]
    for content, n in [*grouped, *best_fit(left, capacity)]:
        offset = 0
        for size, copies in content:
            first = used.get(size, 0)
            used[size] = first + copies * n
            plan.rows.append((size, first, used[size], plan.sequences, copies, offset))
            offset += size * copies
        plan.sequences += n
    return plan


def cut_documents(df: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int, max_tokens: int) -> DataFrame:
    """The pieces of all documents, with the task that made each (``lane``) and its number among those of its length there."""
    ship_package(df.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    key = hash(shared.value)
    source = df.select(F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("__text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(key, shared.value)
        lane = TaskContext.get().partitionId()
        before = np.zeros(max_tokens + 1, dtype=np.int64)
        for batch in batches:
            for begin, stop in slices(batch.column(1)):
                part = batch.slice(begin, stop - begin)
                ids, ends = tokens(part.column(1))
                sizes = np.diff(ends) + 1
                held = np.full(int(sizes.sum()), end_id, dtype="<u4")
                starts = np.cumsum(sizes) - sizes
                held[ragged(starts, sizes - 1)] = ids
                pieces = -(-sizes // max_tokens)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                number = ragged(np.zeros(len(pieces), dtype=np.int64), pieces)
                start = number * max_tokens
                length = np.minimum(sizes[doc] - start, max_tokens)
                order = np.argsort(length, kind="stable")
                same = np.bincount(length, minlength=max_tokens + 1)
                place = np.empty(len(length), dtype=np.int64)
                place[order] = np.arange(len(length)) - (np.cumsum(same) - same)[length[order]]
                place += before[length]
                before += same
                bounds = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(held)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), data,
                        pa.array(np.full(len(length), lane, dtype=np.int64)), pa.array(place),
                    ],
                    names=[id_col, "piece", "start", "length", "ids", "__lane", "__place"],
                )
        release()

    return source.mapInArrow(run, f"{quoted(id_col)} {kind}, {SCHEMA}, __lane long, __place long")


def pack_whole(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, max_tokens: int = 2048) -> DataFrame:
    """Pieces of the documents' ids in as few sequences of at most ``max_tokens`` ids as the method finds.

    A document is the ids of its text and ``end_id``. Only longer ones are cut, into pieces of ``max_tokens`` and a
    last one that may be shorter. One row per piece: the id column, ``piece`` (from 0), ``start`` and ``length`` in the
    document, ``ids`` (32-bit, little-endian), ``sequence_id`` and ``offset`` there; sequences have no gaps.

    The pieces are written once to the shared folder; what goes through the driver is the number of pieces of each
    length, at most ``max_tokens`` numbers. Pieces are numbered within the task that made them and, by sums of the
    counts of tasks before, over all. A null or empty text is the end id alone; repeated rows are packed each for
    itself; equal lengths are placed in the order of the tasks; an empty table gives no rows; other columns are
    left out. An id column named as a column of the result is an error.
    """
    names = [part.split()[0] for part in f"{SCHEMA}, {PLACED}".split(", ")]
    if id_col.lower() in names:
        raise ValueError(f"the id column may not be named {id_col}")
    spark = df.sparkSession
    pieces = stage(cut_documents(df, vocabulary, id_col, text_col, end_id, max_tokens))
    lanes = pieces.groupBy("length", "__lane").agg(F.count(F.lit(1)).alias("__n"))
    counts = {row["length"]: row["n"] for row in lanes.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    plan = make_plan(counts, max_tokens)
    earlier = W.partitionBy("length").orderBy("__lane").rowsBetween(W.unboundedPreceding, -1)
    lanes = lanes.select("length", "__lane", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rows = spark.createDataFrame(plan.rows, "length long, __first long, __last long, __sequence long, __copies long, __offset long")
    rank = F.col("__place") + F.col("__before")
    numbered = pieces.join(lanes, ["length", "__lane"]).withColumn("__rank", rank)
    # The plan has a few rows for each length, whatever the number of pieces.
    placed = numbered.join(F.broadcast(rows), (numbered["length"] == rows["length"]) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__last")))
    return placed.select(
        F.col(quoted(id_col)), "piece", "start", numbered["length"], "ids",
        F.expr("__sequence + (__rank - __first) div __copies").alias("sequence_id"),
        (F.col("__offset") + (F.col("__rank") - F.col("__first")) % F.col("__copies") * numbered["length"]).alias("offset"),
    )
