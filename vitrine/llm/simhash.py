"""SimHash near-duplicates with covering locality-sensitive hashing.

Bit i of a fingerprint belongs to the non-zero vector ``i mod (2^(r+1) - 1) + 1`` of r + 1 bits, and each non-zero
vector v of as many bits gives a table whose mask keeps the bits that are not orthogonal to v. The vectors of r
bits span at most r dimensions, so some v is orthogonal to all of them: fingerprints that differ in r bits or
fewer agree under that mask and meet in that table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.columns import append_columns
from vitrine.llm.components import components
from vitrine.session import ship_package, stage

BITS = 64
#: Distinct fingerprints of a bucket that are compared in one task; a larger bucket is divided by its other bits.
BUCKET = 1024
#: Beyond it the masks that divide large buckets would be too many.
LARGEST_RADIUS = 3
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the word shingles of a text, whose A-Z count as lower case."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(shingle, len(words))
    begin, end = (ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(begin), _BLOCK):
        some = [digest(joined[a:b], 42) for a, b in zip(begin[at : at + _BLOCK], end[at : at + _BLOCK])]
        hashes = np.array(some, dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begin), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``fingerprint`` (long: the 64 bits) of each whole text; zero without words or for null."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            raw = texts.cast(pa.binary()).to_pylist()
            return [pa.array([fingerprint(t, shingle) for t in raw], pa.int64())]

        return work

    return append_columns(df, text_col, make, [T.StructField("fingerprint", T.LongType(), True)], keep)


def masks(radius: int, bits: int = BITS) -> list[int]:
    """Bit masks of the covering tables."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def bucket_links(values: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint, the first one of those that links within ``values`` reach from it."""
    bits = values.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        low = np.where(near, label[None, :], len(values)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join the ``fingerprint`` values within ``radius`` bits of each other, and no others.

    Not all pairs are listed: a bucket gives one link per fingerprint, which connect the same ones.
    """
    if not 0 <= radius <= LARGEST_RADIUS:
        raise ValueError(f"the radius must be 0 to {LARGEST_RADIUS}")
    ship_package(distinct.sparkSession)
    tables = masks(radius)
    keys = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in tables])
    placed = distinct.select("fingerprint", F.posexplode(keys).alias("table", "key"))
    counts = placed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = placed.join(counts, ["table", "key"])
    lists = shared.where(F.col("n") <= BUCKET).groupBy("table", "key").agg(F.collect_list("fingerprint").alias("members"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            members = batch.column(0)
            held, ends = members.values.to_numpy(), members.offsets.to_numpy()
            for a, b in zip(ends, ends[1:]):
                values = held[a:b]
                label = bucket_links(values, radius)
                apart = label != np.arange(len(values))
                left.append(values[apart])
                right.append(values[label[apart]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    small = lists.select("members").mapInArrow(compare, "a long, b long")
    # A large bucket: without any r of its other bits, fingerprints that are near each other become equal, and
    # at most 2^r can do so. The masks are a table of fixed size.
    cleared = [
        (i, _signed(((1 << BITS) - 1) ^ sum(1 << bit for bit in some)))
        for i, m in enumerate(tables)
        for some in combinations([bit for bit in range(BITS) if not m >> bit & 1], radius)
    ]
    rests = distinct.sparkSession.createDataFrame(pa.table({"table": pa.array([t for t, _ in cleared], pa.int32()), "mask": pa.array([m for _, m in cleared], pa.int64())}))
    large = shared.where(F.col("n") > BUCKET).join(F.broadcast(rests), "table")
    groups = large.groupBy("mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("rest")).agg(F.collect_set("fingerprint").alias("members"))
    stars = groups.where("size(members) > 1").select(F.array_min("members").alias("b"), F.explode("members").alias("a")).where("a <> b")
    return small.union(stars.select("a", "b"))


def near_groups(prints: DataFrame, id_col: str, radius: int = 2) -> DataFrame:
    """``fingerprint`` and ``component_id`` of every distinct ``fingerprint`` of ``prints``.

    Equal fingerprints and those that differ in ``radius`` bits or fewer are linked, and ``component_id`` is the
    smallest id that links reach. Ids that are null are never the smallest; a group of such rows has a null.
    """
    classes = stage(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")))
    linked = components(fingerprint_links(classes.select("fingerprint"), radius))
    rooted = classes.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(roots, "root").select("fingerprint", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``id_col``, ``fingerprint`` (long) and ``component_id`` of every row.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other; a text with
    fewer words than a shingle is one shingle. Repeated rows are in one group; an empty table gives no rows; other
    columns are left out.
    """
    prints = stage(fingerprints(df.select(F.col(id_col), F.col(text_col)), text_col, shingle, [id_col]))
    return prints.join(near_groups(prints, id_col, radius), "fingerprint").select(id_col, "fingerprint", "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``df`` that stay when of each group of ``near_duplicates`` only the smallest id does.

    Columns stay as they are. Rows without an id all stay; of rows that repeat an id one stays. Only the ids of rows
    that go are joined with the texts.
    """
    found = stage(near_duplicates(df, id_col, text_col, shingle, radius))
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    left = df.join(gone, id_col, "left_anti").select(*df.columns)
    repeated = found.groupBy(id_col).count().where(F.col(id_col).isNotNull() & (F.col("count") > 1)).select(id_col)
    if repeated.isEmpty():
        return left
    once = left.join(repeated, id_col, "left_semi").dropDuplicates([id_col])
    return left.join(repeated, id_col, "left_anti").unionByName(once)
