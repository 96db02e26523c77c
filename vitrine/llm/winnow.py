"""Document fingerprints by winnowing, in DataFrame expressions.

A text is cut into words; ideographs and the like are words of their own and longer runs are cut after 32
characters. Each run of ``GRAM`` words has a rolling polynomial hash, of every ``WINDOW`` hashes in a row the
smallest is kept, the rightmost of equal ones, with the place of its first word. Two texts that share
``GRAM + WINDOW - 1`` words in a row share at least one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.columns import fresh, quoted
from vitrine.session import stage

GRAM = 3
#: A power of two.
WINDOW = 4
_WIDE = r"\x{2E80}-\x{D7FF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
WORDS = rf"[{_WIDE}]|[^\s{_WIDE}]{{1,32}}"
#: Hashes are taken modulo this prime, words are digits to this base.
PRIME, BASE = (1 << 31) - 1, 1_000_003
_LOW = (1 << 32) - 1


def _paired(left: Column, right: Column, shift: int, join) -> Column:
    """``join`` of each element of ``left`` with the one ``shift`` places on in ``right``, as far as there are any."""
    n = F.size(right) - shift
    return F.when(n > 0, F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), join)).otherwise(left)


def with_marks(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array ``out`` of marks of the column ``text``.

    A mark holds the hash (31 bits) above the place counted down from 2^32 - 1, so the smallest mark of a window
    is the rightmost of its smallest hashes. A text with fewer words than ``GRAM`` is one gram, one with fewer
    grams than ``WINDOW`` one window; a text without words, or null, has no marks.
    """
    words, grams = fresh("__words", df.columns), fresh("__grams", df.columns)
    found = F.regexp_extract_all(F.coalesce(F.col(quoted(text)), F.lit("")), F.lit(WORDS), F.lit(0))
    df = df.withColumn(words, F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))
    df = df.withColumn(grams, F.col(words))
    for shift in range(1, GRAM):
        df = df.withColumn(grams, _paired(F.col(grams), F.col(words), shift, lambda h, w: (h * BASE + w) % PRIME))
    place = lambda i: F.lit(_LOW) - i.cast("long")
    df = df.withColumn(out, F.transform(grams, lambda h, i: F.shiftleft(h, 32).bitwiseOR(place(i)))).drop(words)
    few = F.size(grams) <= WINDOW
    shift = 1
    while shift < WINDOW:
        c = F.col(out)
        df = df.withColumn(out, F.when(few, c).otherwise(_paired(c, c, shift, lambda a, b: F.least(a, b))))
        shift *= 2
    least = F.when(F.size(out) > 0, F.array(F.array_min(out))).otherwise(F.col(out))
    return df.withColumn(out, F.when(few, least).otherwise(F.array_distinct(out))).drop(grams)


def hashes(marks: Column) -> Column:
    """The distinct hashes of an array of marks."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 32).cast("int")))


def spans(marks: Column) -> Column:
    """Hash and place (of the first word, from zero) of each mark."""
    return F.transform(
        marks, lambda m: F.struct(F.shiftright(m, 32).alias("hash"), (F.lit(_LOW) - m.bitwiseAND(F.lit(_LOW))).alias("place"))
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, F.lit(1.0)).otherwise(common / total)


def predecessors(df: DataFrame, id_col: str, size_col: str) -> DataFrame:
    """Each distinct id with ``prev_id``, the id before it, and ``prev_size``, the largest size there.

    The first id comes after the last. Ids are sorted in parts of the range; within a part a window looks back,
    and the ends of the parts, one row for each, are put together on the driver.
    """
    spark = df.sparkSession
    distinct = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(size_col).alias("size"))
    ordered = stage(distinct.orderBy(id_col).withColumn("__row", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__row", 33))
    ends = ordered.groupBy("__part").agg(F.max(F.struct(id_col, "size")).alias("last")).orderBy("__part").collect()
    before = [(r["__part"], *ends[i - 1]["last"]) for i, r in enumerate(ends)]
    kind = ordered.schema[id_col].dataType.simpleString()
    edges = spark.createDataFrame(before, f"__part long, __end_id {kind}, __end_size int")
    back = Window.partitionBy("__part").orderBy("__row")
    looked = ordered.select("*", F.lag(F.struct(F.col(id_col).alias("id"), F.col("size").alias("size"))).over(back).alias("__prev"))
    joined = looked.join(F.broadcast(edges), "__part")  # one row per part
    return joined.select(
        id_col,
        F.coalesce(F.col("__prev.id"), F.col("__end_id")).alias("prev_id"),
        F.coalesce(F.col("__prev.size"), F.col("__end_size")).alias("prev_size"),
    )


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edit of it, and how like they are.

    The edit puts the first ``floor(n / 4)`` characters of the next text, by ascending id, in place of as many
    last ones; the last text is followed by the first. One row per row of ``df``: the id, ``n_chars``, ``edited``,
    ``marks`` and ``edited_marks`` (see ``with_marks``), ``near_edited`` and ``near_next``. Null texts count as
    empty. If an id repeats, its smallest text is the next one to the id before it; rows without an id have an
    empty next text and are next to none. An empty table gives no rows; other columns are left out.
    """
    own = df.select(F.col(quoted(id_col)).alias("__id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("__text"))
    links = predecessors(own.select("__id", F.char_length("__text").alias("__n")), "__id", "__n")
    # Both joins read the same shuffle of the texts: rows without an id, which neither needs, go another way.
    named, nameless = own.where(F.col("__id").isNotNull()), own.where(F.col("__id").isNull())
    following = named.join(links, "__id").groupBy("__id").agg(
        F.min("__text").alias("__text"), F.first("prev_id").alias("__prev"), F.first("prev_size").alias("__size")
    )
    following = hashed(with_marks(following, "__text", "__next_marks"), "__next_marks").select(
        F.col("__prev").alias("__id"),
        F.substring(F.col("__text"), F.lit(1), F.floor(F.col("__size") / 4).cast("int")).alias("__head"),
        F.col("__next_marks").alias("__next"),
    )
    rows = named.join(following, "__id", "left").unionByName(nameless, allowMissingColumns=True)
    rows = rows.withColumn("n_chars", F.char_length("__text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring(F.col("__text"), F.lit(1), F.col("n_chars").cast("int") - cut)
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.coalesce("__head", F.lit("")), F.lit(1), cut)))
    rows = with_marks(with_marks(rows, "__text", "marks"), "edited", "edited_marks")
    rows = rows.withColumn("__own", hashes(F.col("marks"))).withColumn("__edited", hashes(F.col("edited_marks")))
    rows = rows.withColumn("__next", F.coalesce("__next", F.array().cast("array<int>")))
    return rows.select(
        F.col("__id").alias(id_col), "n_chars", "edited", "marks", "edited_marks",
        likeness(F.col("__own"), F.col("__edited")).alias("near_edited"),
        likeness(F.col("__own"), F.col("__next")).alias("near_next"),
    )


def hashed(df: DataFrame, marks: str) -> DataFrame:
    """``df`` with the distinct hashes in place of the marks."""
    return df.withColumn(marks, hashes(F.col(marks)))
