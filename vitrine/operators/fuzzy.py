"""Fuzzy term expansion against a vocabulary.

Candidates come from an equi-join on keys and never from comparing all pairs:

* Two short words within ``d`` edits (an adjacent swap counts one) share a string that
  remains after at most ``d`` deletions from each.
* A longer word would have too many of those.  It is cut into two halves instead; of two
  edits one half takes one at most (a swap across the cut is a changed letter in each), so
  that half and the part of the other word that it comes from share a string that remains
  after at most one deletion from each.
* A very long word is cut into five segments; two edits touch four at most, so one segment
  stands in the other word as it is, shifted by two places at most.

Of halves the vocabulary's words get the fewer keys, as they are many; a query term asks for
all parts that may have come from theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import constants as C
from vitrine.session import ship_package, stage

#: Keys in one folder of a written table, about 30 MB, and the most tasks that write one.
ROWS_PER_BUCKET = 1_000_000
MOST_KEY_TASKS = 10_000

_MOST_EDITS = 2
_SEGMENTS = 5
# Longest vocabulary words matched by deletions, and by their halves.
_SHORT = 9
_MIDDLE = 24


def edit_budget(term: Column) -> Column:
    """AUTO fuzziness: 0, 1 or 2 edits by length."""
    length = F.char_length(term)
    return (
        F.when(length < C.FUZZY_ONE_EDIT_LENGTH, 0).when(length < C.FUZZY_TWO_EDIT_LENGTH, 1).otherwise(2)
    )


def _shorter(words: Column) -> Column:
    """All strings with one character less."""
    return F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))),
                lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))),
            ),
        )
    )


def deletion_keys(term: Column, edits: Column) -> Column:
    """The term and what remains of it after up to ``edits`` deletions."""
    itself = F.array(term)
    once = F.array_distinct(_shorter(itself))
    twice = F.array_distinct(_shorter(once))
    return (
        F.when(edits == 0, itself)
        .when(edits == 1, F.array_union(itself, once))
        .otherwise(F.array_union(F.array_union(itself, once), twice))
    )


def segment_keys(term: Column) -> Column:
    """Hashes of the five segments of a word, with its length."""
    length = F.char_length(term)
    return F.transform(F.sequence(F.lit(0), F.lit(_SEGMENTS - 1)), lambda i: _segment(term, length, i, F.lit(0)))


def reachable_segment_keys(term: Column) -> Column:
    """Hashes of every segment of a word of like length that may stand in ``term``."""
    length = F.char_length(term)
    shifts = F.sequence(F.lit(-_MOST_EDITS), F.lit(_MOST_EDITS))
    segments = F.sequence(F.lit(0), F.lit(_SEGMENTS - 1))
    lengths = F.sequence(length - _MOST_EDITS, length + _MOST_EDITS)
    return F.array_distinct(
        F.flatten(
            F.transform(
                lengths,
                lambda n: F.flatten(
                    F.transform(segments, lambda i: F.transform(shifts, lambda by: _segment(term, n, i, by)))
                ),
            )
        )
    )


def _segment(term: Column, length: Column, i: Column, by: Column) -> Column:
    start = F.floor(i * length / _SEGMENTS).cast("int")
    stop = F.floor((i + 1) * length / _SEGMENTS).cast("int")
    return F.xxhash64(length, i, F.substring(term, start + by + 1, stop - start))


def _halves(term: Column, length: Column, own: Column, by: int = 0) -> list[tuple[int, Column]]:
    """The parts of a word of ``own`` letters that stand for the halves of one of ``length``, ``by`` letters longer than these."""
    first = F.floor(length / 2).cast("int")
    last = length - first + by
    return [(0, F.substring(term, F.lit(1), first + by)), (1, F.substring(term, own - last + 1, last))]


def _half_key(length: Column, side: int) -> Callable[[Column], Column]:
    return lambda part: F.xxhash64(length, F.lit(side), part)


def half_keys(term: Column) -> Column:
    """Hashes of both halves of a word and what remains of them after a deletion, with its length."""
    length = F.char_length(term)
    return F.concat(
        *[
            F.transform(F.concat(F.array(part), _shorter(F.array(part))), _half_key(length, side))
            for side, part in _halves(term, length, length)
        ]
    )


def reachable_half_keys(term: Column) -> Column:
    """Hashes by which the halves of every word of like length are found that one edit may turn into a part of ``term``."""
    own = F.char_length(term)
    low, high = F.greatest(own - _MOST_EDITS, F.lit(_SHORT + 1)), F.least(own + _MOST_EDITS, F.lit(_MIDDLE))

    def of_length(n: Column) -> Column:
        parts = zip(_halves(term, n, own, -1), _halves(term, n, own), _halves(term, n, own, 1))
        # A part with a letter less is a half with a deletion as it is; one with a letter more has to lose it.
        return F.concat(
            *[
                F.transform(F.concat(F.array(less, same), _shorter(F.array(same, more))), _half_key(n, side))
                for (side, less), (_, same), (_, more) in parts
            ]
        )

    none = F.array().cast("array<bigint>")
    return F.when(low <= high, F.flatten(F.transform(F.sequence(low, F.greatest(low, high)), of_length))).otherwise(none)


def match_keys(term: Column, edits: Column) -> Column:
    """Keys a query term is looked up by, whichever way the vocabulary's words are cut; words without edits by themselves."""
    length = F.char_length(term)
    none = F.array().cast("array<bigint>")
    hashed = F.transform(deletion_keys(term, edits), lambda w: F.xxhash64(w))
    # Terms of few letters have fewer edits, and reach no word that is cut.
    return F.concat(
        F.when(length <= _SHORT + _MOST_EDITS, hashed).otherwise(none),
        F.when(length > _SHORT - _MOST_EDITS, reachable_half_keys(term)).otherwise(none),
        F.when(length > _MIDDLE - _MOST_EDITS, segment_keys(term)).otherwise(none),
    )


def vocabulary_keys(term: Column) -> Column:
    """Keys a vocabulary term is found by."""
    length = F.char_length(term)
    # A word of length n is only reached by query terms of n-2 letters or more.
    reach = F.when(length < 2, 0).when(length < 4, 1).otherwise(2)
    short = F.transform(deletion_keys(term, reach), lambda w: F.xxhash64(w))
    return F.when(length <= _SHORT, short).when(length <= _MIDDLE, half_keys(term)).otherwise(reachable_segment_keys(term))


def most_vocabulary_keys(term: Column) -> Column:
    """As many keys as a vocabulary term has, or more where letters repeat."""
    n = F.char_length(term)
    return F.when(n <= _SHORT, 1 + n + F.floor(n * (n - 1) / 2)).when(n <= _MIDDLE, n + 2).otherwise(_SEGMENTS * (2 * _MOST_EDITS + 1) ** 2)


def _swap_distance(left: str, right: str, most: int | None = None) -> int:
    """Edits between two words, an adjacent swap being one, no part edited twice.

    With ``most``, only the cells that can still stay within it are looked at.
    """
    width = max(len(left), len(right)) if most is None else most
    far = len(left) + len(right) + 1
    before, row = {}, {j: j for j in range(min(len(right), width) + 1)}
    for i, a in enumerate(left, 1):
        new = {0: i} if i <= width else {}
        for j in range(max(1, i - width), min(len(right), i + width) + 1):
            b = right[j - 1]
            cost = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (a != b))
            if i > 1 and j > 1 and a == right[j - 2] and left[i - 2] == b:
                cost = min(cost, before.get(j - 2, far) + 1)
            new[j] = cost
        before, row = row, new
    return row.get(len(right), far)


@F.pandas_udf(T.IntegerType())
def swap_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edits where they are two at most, something larger otherwise; null for a missing word."""
    return pd.Series([None if a is None else _swap_distance(a, b, _MOST_EDITS) for a, b in zip(left, right)], dtype="Int32")


# Keeps the planner from evaluating it below ``distinct`` as well.
swap_distance = swap_distance.asNondeterministic()


def _counted_edits(near: DataFrame) -> DataFrame:
    """``edits`` of the pairs within budget, in one pass.

    A swap is at most two plain edits, so pairs beyond twice the budget are out, and up to one plain edit both
    counts agree; only the words of the rest go to Python.
    """
    close = near.where(F.col("plain").between(0, 2 * F.col("budget")))
    open_ = F.col("plain") > 1
    counted = swap_distance(F.when(open_, F.col("query_term")), F.when(open_, F.col("term")))
    return close.withColumn("edits", F.coalesce(counted, F.col("plain"))).where(F.col("edits") <= F.col("budget")).drop("plain")


def keyed_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """``key, field, term, df``: the keys by which each vocabulary term is found."""
    keys = F.explode(F.array_distinct(vocabulary_keys(F.col("term"))))
    return vocabulary.select(keys.alias("key"), "field", "term", "df")


@dataclass(frozen=True)
class KeyTable:
    """A written ``keyed_vocabulary``: ``rows(bucket, key, field, term, df)`` in ``buckets`` folders, each sorted by key."""

    rows: DataFrame
    buckets: int

    @staticmethod
    def bucket(key: Column, buckets: int) -> Column:
        return F.pmod(key, F.lit(buckets)).cast("int")

    @staticmethod
    def write(vocabulary: DataFrame, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        keyed = keyed_vocabulary(vocabulary)
        n = vocabulary.select(F.sum(most_vocabulary_keys(F.col("term")))).first()[0] or 0
        # Twice as many as even ones would take: many words share a half, so buckets fill unevenly.
        buckets = max(1, -(-2 * n // rows_per_bucket))
        keyed = keyed.withColumn("bucket", KeyTable.bucket(F.col("key"), buckets))
        # A task for each bucket: its rows come together once, and a search reads whole folders of sorted keys.
        dealt = keyed.repartition(min(buckets, MOST_KEY_TASKS), "bucket").sortWithinPartitions("bucket", "key", "field", "term")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
        vocabulary.sparkSession.range(1).select(F.lit(buckets).cast("int").alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")

    @staticmethod
    def read(spark: SparkSession, path: str) -> KeyTable:
        schema = "key long, field string, term string, df long, bucket int"
        return KeyTable(spark.read.schema(schema).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/layout").first()[0])

    def matching(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that ``keys(key)`` fall into; at most ``buckets`` numbers come to the driver."""
        wanted = [r.bucket for r in keys.select(self.bucket(F.col("key"), self.buckets).alias("bucket")).distinct().collect()]
        rows = self.rows if len(wanted) == self.buckets else self.rows.where(F.col("bucket").isin(wanted))
        return rows.drop("bucket")


def expand_terms(
    wanted: DataFrame, vocabulary: DataFrame, max_expansions: int | None = C.MAX_EXPANSIONS, keys: KeyTable | None = None
) -> DataFrame:
    """Vocabulary terms near each wanted term.

    ``wanted(field, query_term)``, ``vocabulary(field, term, df)`` →
    ``field, query_term, term, edits, similarity, df``.  ``df`` is the largest of the
    expansions of a query term, so a rare misspelling does not outscore the word
    itself.  The 50 nearest terms are kept, as the search server documents it, or all with None.
    With a written ``keys`` table only the buckets of the wanted terms' keys are read; else the keys of the whole
    vocabulary are made anew.
    """
    ship_package(wanted.sparkSession)
    budget = edit_budget(F.col("query_term"))
    left = wanted.withColumn("budget", budget).withColumn(
        "key", F.explode(F.array_distinct(match_keys(F.col("query_term"), F.col("budget"))))
    )
    if keys is None:
        right = keyed_vocabulary(vocabulary)
    else:
        left = stage(left)  # read for its buckets and for the join
        right = keys.matching(left)
    near = (
        left.join(right, ["field", "key"])
        .where(F.abs(F.char_length("query_term") - F.char_length("term")) <= F.col("budget"))
        # Halves meet words that are far off, so these are dropped before pairs are dealt out.
        .where((F.char_length("term") > _MIDDLE) | (F.levenshtein("query_term", "term", 2 * _MOST_EDITS) >= 0))
        .select("field", "query_term", "budget", "term", "df")
        .distinct()
        .withColumn("plain", F.levenshtein("query_term", "term", 2 * _MOST_EDITS))
    )
    near = _counted_edits(near)
    shorter = F.least(F.char_length("query_term"), F.char_length("term"))
    near = near.withColumn("similarity", 1 - F.col("edits") / shorter).where("similarity > 0")
    per_term = Window.partitionBy("field", "query_term")
    kept = near
    if max_expansions is not None:
        nearest = per_term.orderBy(F.desc("similarity"), "term")
        kept = near.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= max_expansions)
    return kept.withColumn("df", F.max("df").over(per_term)).select(
        "field", "query_term", "term", "edits", "similarity", "df"
    )
