"""Near-duplicates by the similarity of their shingle sets, found with wide SimHash fingerprints.

One fingerprint of 64 bits can't reach a similarity of 0.8: such texts differ in about ten bits, and masks that cover
so many are too many. Here a text has up to ``PARTS`` fingerprints of 64 bits, one wide fingerprint. Its shingles are dealt
by their hashes into parts of about four to eight, and each part has its own SimHash. The covering masks keep one part
each, so any two texts whose wide fingerprints agree in one part or more collide in some table: texts with a
similarity of 0.8 share some of 16 parts nearly always. The SimHash of the whole text is searched as well, by the covering
masks of ``simhash`` with the largest radius. Candidates are then compared by their shingles, so no false link stays.

Texts with the same words are one class. In a bucket the classes are compared with its smallest one. Where links leave
some of a bucket apart, all that are apart are compared: the bucket is cut into tiles, and in a tile only those meet that
share one of their rarest shingles, as many as similar sets must. So no pair becomes a row and none is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm import simhash
from vitrine.llm.columns import append_columns, quoted, release
from vitrine.llm.components import components
from vitrine.llm.units import _LOWER, _hashes, cut_words, ragged, text_bytes
from vitrine.session import ship_package, stage

#: Fingerprints of 64 bits in a wide one, and the shingles of each at least (twice as many at most).
PARTS = 16
SHINGLES_OF_PART = 4
#: Rows that one copy of a compared text serves, so a text that thousands are compared with is no single task's.
ROWS_OF_COPY = 64
#: Classes of a piece of a bucket; two pieces are a tile, which one task compares.
PIECE = 512
_TEXT_BYTES = 2 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct word shingles of all texts, in order; a text of fewer words is one shingle."""
    data, offsets = text_bytes(texts)
    none = np.zeros(0, dtype=np.int64)
    if not len(data):
        return none, none.astype(np.uint64)
    data, starts, lengths = cut_words(_LOWER[data], offsets)
    if not len(starts):
        return none, none.astype(np.uint64)
    words = _hashes(data, starts, lengths)
    bounds = np.searchsorted(starts, offsets)
    sizes = np.diff(bounds)
    width = np.minimum(sizes, shingle)
    first = ragged(bounds[:-1], np.where(sizes > 0, sizes - width + 1, 0))
    owner = np.searchsorted(bounds, first, side="right") - 1
    value = np.zeros(len(first), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(shingle):
            there = i < width[owner]
            at = np.minimum(first + i, len(words) - 1)
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + np.where(there, words[at], np.uint64(i + 1)))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def wide_fingerprints(owner: np.ndarray, hashes: np.ndarray, similarity: float):
    """(text, level, part, fingerprint) of the parts of all texts.

    The level, the logarithm of the number of parts, follows the number of shingles. A text also has the parts of
    the next level if a similar longer text would.
    """
    found = []
    n = np.bincount(owner)[owner].astype(np.float64) if len(owner) else np.zeros(0)
    low = np.maximum(np.floor(np.log2(np.maximum(n, 1) / SHINGLES_OF_PART)), 0).astype(np.int64)
    high = np.maximum(np.floor(np.log2(np.maximum(n / similarity + 1e-9, 1) / SHINGLES_OF_PART)), 0).astype(np.int64)
    for level, chosen in ((low, np.ones(len(owner), dtype=bool)), (high, high != low)):
        part = (_mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) & ((np.uint64(1) << level.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        rows = np.flatnonzero(chosen & (part < PARTS))
        rows = rows[np.lexsort((part[rows], owner[rows]))]
        if not len(rows):
            continue
        text, which = owner[rows], part[rows]
        begin = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (which[1:] != which[:-1])]))
        size = np.diff(np.append(begin, len(rows)))
        bits = np.unpackbits(hashes[rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        prints = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<i8").ravel()
        found.append((text[begin], level[rows][begin], which[begin], prints))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    columns = [np.concatenate(c) for c in zip(*found)]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    return tuple(c[order] for c in columns)


KEY = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("print", T.LongType())])


def sketches(df: DataFrame, text_col: str, shingle: int, similarity: float, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``same``, a digest of the words of each text, ``parts`` of its wide fingerprint, and ``whole``, its SimHash."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            raw = texts.cast(pa.binary()).to_pylist()
            words = [b" ".join(t.lower().split()) for t in raw]
            whole = pa.array([simhash.fingerprint(t, shingle) for t in raw], pa.int64())
            same = pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in words], pa.binary())
            text, level, part, prints = wide_fingerprints(*shingle_hashes(texts, shingle), similarity)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(level, pa.int32()), pa.array(part, pa.int32()), pa.array(prints, pa.int64())], names=KEY.names)
            return [same, pa.ListArray.from_arrays(pa.array(bounds), items), whole]

        return work

    fields = [T.StructField("same", T.BinaryType(), True), T.StructField("parts", T.ArrayType(KEY), True), T.StructField("whole", T.LongType(), True)]
    return append_columns(df, text_col, make, fields, keep, _TEXT_BYTES)


def shingles(text: str, width: int) -> set[bytes]:
    words = text.encode("utf-8").lower().split()
    n = min(width, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def alike(left: set[bytes], right: set[bytes], similarity: float) -> bool:
    both = len(left & right)
    return both >= similarity * (len(left) + len(right) - both)


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose ``texts(node, text)`` have shingle sets as similar as that."""
    ship_package(pairs.sparkSession)
    # A text that many are compared with goes along in as many copies as its rows need.
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / ROWS_OF_COPY).cast("int").alias("copies"))
    centres = texts.join(copies, texts["node"] == copies["b"]).select(
        "b", F.col("text").alias("right"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )
    dealt = pairs.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy"))
    both = dealt.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(centres, ["b", "copy"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, set()
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            good = []
            for row, centre in enumerate(b.to_pylist()):
                if held != centre:
                    held, mine = centre, shingles(right[row].as_py(), shingle)
                good.append(alike(shingles(left[row].as_py(), shingle), mine, similarity))
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], names=["a", "b"])
        release()

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "left", "right").mapInArrow(compare, f"a {kind}, b {kind}")


def covered(classes: DataFrame) -> DataFrame:
    """The rows of ``classes(node, whole)`` by the bucket of all SimHashes that the covering masks lead to each other."""
    prints = stage(classes.select(F.col("whole").alias("fingerprint")).distinct())
    linked = components(simhash.fingerprint_links(prints, simhash.LARGEST_RADIUS)).withColumnRenamed("node", "whole")
    rooted = classes.join(linked, "whole", "left")
    return rooted.select("node", F.lit(-1).alias("level"), F.lit(0).alias("part"), F.coalesce("root", "whole").alias("print"))


def alike_in_tile(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of sorted ``sets`` of different ``group`` (and different ``side``, if there are two) that may be similar.

    Similar sets share one of the shingles that either holds least often in the tile, as many as it may lack and one
    more. The generator is sent whether a pair is similar; such ones are one group from then on.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    _, token, counts = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((token, counts[token], owner))
    begin = np.cumsum(sizes) - sizes
    prefix = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    first = order[np.arange(len(flat)) - np.repeat(begin, sizes) < np.repeat(prefix, sizes)]
    first = first[np.argsort(token[first], kind="stable")]
    token, owner = token[first], owner[first]
    near = np.zeros((len(sets), len(sets)), dtype=bool)
    live = np.arange(len(token))
    for step in range(1, len(token)):
        live = live[live + step < len(token)]
        live = live[token[live] == token[live + step]]
        if not len(live):
            break
        near[owner[live], owner[live + step]] = True
    near |= near.T
    near &= (group[:, None] != group[None, :]) & (sizes[:, None] >= similarity * sizes[None, :] - 1e-9)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    near &= near.T
    group = group.copy()
    for a, b in zip(*np.nonzero(np.triu(near))):
        if group[a] == group[b]:
            continue
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if both >= similarity * (sizes[a] + sizes[b] - both) and (yield a, b):
            group[group == group[b]] = group[a]


def apart_links(rows: DataFrame, texts: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of similar ``texts(node, text)`` in a bucket of ``rows`` that ``roots(node, root)`` leave apart."""
    ship_package(rows.sparkSession)
    keys = ["level", "part", "print"]
    labelled = stage(rows.join(roots, "node", "left").select("node", *keys, F.coalesce("root", "node").alias("root")))
    buckets = labelled.groupBy(*keys).agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("again"),
    ).where("n > 2 and least <> most")  # two have been compared
    # Buckets of the same classes are one.
    once = buckets.groupBy("n", "members", "again").agg(F.min(F.struct(*keys)).alias("key"))
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    tiles = stage(once.select("key.*", pieces.alias("pieces")))
    dealt = labelled.join(tiles, keys).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.withColumn("low", F.least("piece", "other")).withColumn("high", F.greatest("piece", "other"))
    tile = [*keys, "low", "high"]
    held = dealt.join(texts, "node").select(*tile, "piece", "node", "root", "text")

    def compare(part: pa.Table) -> pa.Table:
        nodes, text = part["node"].to_pylist(), part["text"].combine_chunks()
        code = part["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        side = part["piece"].to_numpy() != part["low"].to_numpy()
        a, b = [], []
        # All of one group, or all pairs of one side, are done.
        if (code != code[0]).any() and (part["low"][0] == part["high"][0] or (side.any() and not side.all())):
            search = alike_in_tile(_sets(text, shingle), code, side, similarity)
            good = None
            while True:
                try:
                    i, j = search.send(good)
                except StopIteration:
                    break
                i, j = int(i), int(j)
                good = alike(shingles(text[i].as_py(), shingle), shingles(text[j].as_py(), shingle), similarity)
                if good:
                    a.append(nodes[i])
                    b.append(nodes[j])
        kind = part.schema.field("node").type
        return pa.table([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    kind = rows.schema["node"].dataType.simpleString()
    return held.groupBy(*tile).applyInArrow(compare, f"a {kind}, b {kind}")


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted hashes of the shingles of each text, some texts at a time."""
    sets, start = [], 0
    ends = np.cumsum([len(x) for x in texts.cast(pa.binary()).to_pylist()])
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _TEXT_BYTES, side="right")))
        owner, value = shingle_hashes(texts.slice(start, stop - start), shingle)
        sets += np.split(value, np.searchsorted(owner, np.arange(1, stop - start)))
        start = stop
    return sets


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col`` and ``component_id``, the smallest id that links reach, of every row.

    Linked are texts whose sets of ``shingle`` words (A-Z in lower case; a shorter text is one shingle) have a Jaccard
    similarity of ``similarity`` or more, as far as they share a part of their wide fingerprints or covering masks lead
    from one SimHash to the other; the tests measure how many do. Texts with the same words, and all without words or null, are one class. Rows without an id take
    part, but are never the smallest. Repeated rows are in one group; an empty table gives no rows.
    """
    own = df.select(F.col(quoted(id_col)).alias("node"), F.col(quoted(text_col)).alias("text"))
    sketched = stage(sketches(own, "text", shingle, similarity, ["node"]))
    classes = stage(sketched.groupBy("same").agg(F.min("node").alias("node"), F.any_value("parts").alias("parts"), F.any_value("whole").alias("whole")).where("node IS NOT NULL"))
    rows = stage(classes.select("node", F.inline("parts")).unionByName(covered(classes)))
    keys = ["level", "part", "print"]
    first = rows.groupBy(*keys).agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(first, keys).where("node <> b")
    candidates = stage(met.select(F.col("node").alias("a"), "b").distinct())
    # The texts of candidates only; of rows that repeat an id, one.
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = own.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text", True).alias("text"))
    texts = stage(texts.select("node", F.coalesce("text", F.lit("")).alias("text")))
    links = stage(similar_pairs(candidates, texts, shingle, similarity))
    # Those that the smallest class of their bucket does not lead to each other.
    links = links.unionByName(stage(apart_links(rows, texts, components(links), shingle, similarity)))
    roots = components(links).withColumnRenamed("node", "least")
    joined = sketched.join(classes.select("same", F.col("node").alias("least")), "same", "left").join(roots, "least", "left")
    return joined.select(F.col("node").alias(id_col), F.coalesce("root", "least").alias("component_id"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay when of each of ``similar_groups`` only the smallest id does.

    Columns stay as they are. Rows without an id all stay; of rows that repeat an id one stays. Only the ids of rows
    that go are joined with the texts.
    """
    found = stage(similar_groups(df, id_col, text_col, shingle, similarity))
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    left = df.join(gone, id_col, "left_anti").select(*df.columns)
    repeated = found.groupBy(id_col).count().where(F.col(id_col).isNotNull() & (F.col("count") > 1)).select(id_col)
    if repeated.isEmpty():
        return left
    once = left.join(repeated, id_col, "left_semi").dropDuplicates([id_col])
    return left.join(repeated, id_col, "left_anti").unionByName(once)
