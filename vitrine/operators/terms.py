"""Searched fields, their term statistics and the weight of query terms."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import constants as C
from vitrine.functions import text
from vitrine.functions.scoring import idf
from vitrine.operators.fuzzy import KeyTable, expand_terms
from vitrine.session import stage

# Most bytes of distinct query terms named in a pushed-down filter, which spares row groups; the join decides either way.
FILTER_BYTES = 64 << 10


@dataclass(frozen=True)
class SearchField:
    """A searched column: analysed text, or an exact value matched as a whole."""

    name: str
    boost: float = 1.0
    exact: bool = False
    column: str | None = None

    @property
    def value(self) -> Column:
        return F.col(self.column or self.name)

    def terms(self, value: Column | None = None) -> Column:
        value = self.value if value is None else value
        return F.when(value.isNotNull(), F.array(value) if self.exact else text.tokens(value))


def default_fields(include_descriptions: bool = False) -> list[SearchField]:
    """The fields of the unified item, with their boosts."""
    fields = [SearchField(n, b, column=f"metadata.{n}") for n, b in C.TEXT_BOOSTS.items()]
    fields += [SearchField(n, b, exact=True, column=f"metadata.{n}") for n, b in C.KEYWORD_BOOSTS.items()]
    if include_descriptions:
        fields += [SearchField(n, b) for n, b in C.DESCRIPTION_BOOSTS.items()]
    return fields


def field_terms(df: DataFrame, values: Sequence[tuple[SearchField, Column]], id_col: str) -> DataFrame:
    """``id, field, terms`` of every field that has any term; one scan for all fields."""
    entries = [F.struct(F.lit(f.name).alias("field"), f.terms(value).alias("terms")) for f, value in values]
    return df.select(id_col, F.inline(F.array(*entries))).where(F.size("terms") > 0)


def wanted_terms(df: DataFrame, values: Sequence[tuple[SearchField, Column]], id_col: str) -> DataFrame:
    """``query_id, field, query_term, repeats`` looked for by each row.

    Dealt out by query once, so later groupings by query find their rows together.
    """
    return (
        field_terms(df, values, id_col)
        .select(F.col(id_col).alias("query_id"), "field", F.explode("terms").alias("query_term"))
        .repartition("query_id")
        .groupBy("query_id", "field", "query_term")
        .agg(F.count(F.lit(1)).alias("repeats"))
    )


@dataclass(frozen=True)
class TextIndex:
    """Statistics of a corpus, and the corpus itself or its postings.

    ``vocabulary(field, term, df)``, ``stats(field, n_docs, avg_length)``;
    ``postings(field, term, doc_id, tf, dl)`` and the keys of fuzzy terms of a written index.
    """

    fields: tuple[SearchField, ...]
    vocabulary: DataFrame
    stats: DataFrame
    corpus: DataFrame | None = None
    postings: DataFrame | None = None
    keys: KeyTable | None = None

    @staticmethod
    def of(corpus: DataFrame, fields: Sequence[SearchField]) -> TextIndex:
        """Statistics in one pass: words are counted where they lie before they are shuffled."""
        terms = field_terms(corpus, [(f, f.value) for f in fields], "doc_id")
        # The entry without a term counts the documents of a field and their lengths.
        entries = F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string")))
        counted = stage(
            terms.select("field", F.size("terms").alias("length"), F.explode(entries).alias("term"))
            .groupBy("field", "term")
            .agg(
                F.count(F.lit(1)).alias("df"),
                F.sum(F.when(F.col("term").isNull(), F.col("length"))).alias("total_length"),
            )
        )
        stats = counted.where(F.col("term").isNull()).select(
            "field", F.col("df").alias("n_docs"), (F.col("total_length") / F.col("df")).alias("avg_length")
        )
        vocabulary = counted.where(F.col("term").isNotNull()).select("field", "term", "df")
        return TextIndex(tuple(fields), vocabulary, stats, corpus=corpus)

    def without(self, names: Collection[str]) -> TextIndex:
        """The same index, some fields not being searched."""
        return replace(self, fields=tuple(f for f in self.fields if f.name not in names))

    def doc_id_type(self) -> str:
        held = self.corpus if self.postings is None else self.postings
        return held.schema["doc_id"].dataType.simpleString()

    def all_postings(self) -> DataFrame:
        if self.postings is not None:
            return self.postings
        return _merged(self._row_postings())

    def _row_postings(self) -> DataFrame:
        """Postings of each row of the corpus, counted where it lies; rows with equal ids are not merged."""
        terms = field_terms(self.corpus, [(f, f.value) for f in self.fields], "doc_id")
        # Equal words stand together once sorted; a word is counted from its first place to that of the next one.
        ordered = terms.select("doc_id", "field", F.size("terms").alias("dl"), F.sort_array("terms").alias("terms"))
        new = F.filter(F.sequence(F.lit(1), F.col("dl")), lambda i: (i == 1) | (F.get("terms", i - 1) != F.get("terms", i - 2)))
        at = F.col("at")
        counted = F.transform(
            at,
            lambda i, n: F.struct(
                F.get("terms", i - 1).alias("term"), (F.coalesce(F.get(at, n + 1), F.col("dl") + 1) - i).cast("long").alias("tf")
            ),
        )
        return ordered.withColumn("at", new).select("field", "doc_id", "dl", F.inline(counted))

    def write(self, path: str, partitions: int | None = None) -> None:
        """Write the index.  Postings are range-partitioned and sorted by term, so a
        search reads the row groups of its terms only, and a frequent term spans files."""
        order = ["field", "term", "doc_id"]
        # Staged, as the ranges are found by reading all postings; equal ids meet in a range, so one shuffle serves both.
        postings = self.postings if self.postings is not None else stage(self._row_postings())
        ranged = postings.repartitionByRange(partitions, *order) if partitions else postings.repartitionByRange(*order)
        merged = ranged if self.postings is not None else _merged(ranged)
        merged.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        KeyTable.write(self.vocabulary, f"{path}/keys")
        self.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark: SparkSession, path: str, fields: Sequence[SearchField]) -> TextIndex:
        return TextIndex(
            tuple(fields),
            spark.read.parquet(f"{path}/vocabulary"),
            spark.read.parquet(f"{path}/stats"),
            postings=spark.read.parquet(f"{path}/postings"),
            keys=KeyTable.read(spark, f"{path}/keys"),
        )


def _merged(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term", "doc_id", "dl").agg(F.sum("tf").alias("tf"))


def weighted_features(
    wanted: DataFrame, index: TextIndex, fuzzy_fields: Collection[str], max_expansions: int | None = C.MAX_EXPANSIONS
) -> DataFrame:
    """``query_id, features``: per matching term, what it is worth to the query.

    A repeated query word counts as often as it occurs.
    """
    fuzzy = sorted(fuzzy_fields)
    exact_vocabulary = index.vocabulary.where(~F.col("field").isin(fuzzy)) if fuzzy else index.vocabulary
    found = exact_vocabulary.select(
        "field", F.col("term").alias("query_term"), "term", F.lit(1.0).alias("similarity"), "df"
    )
    if fuzzy:
        distinct = wanted.where(F.col("field").isin(fuzzy)).select("field", "query_term").distinct()
        near = expand_terms(distinct, index.vocabulary.where(F.col("field").isin(fuzzy)), max_expansions, index.keys)
        found = found.unionByName(near.drop("edits"))
    boosts = F.create_map(*[F.lit(x) for f in index.fields for x in (f.name, f.boost)])
    weight = boosts[F.col("field")] * idf(F.col("n_docs"), F.col("df")) * F.col("similarity") * F.col("repeats")
    return (
        wanted.join(found, ["field", "query_term"])
        .join(F.broadcast(index.stats), "field")  # one row per field
        .groupBy("query_id", "field", "term", "avg_length")
        .agg(F.sum(weight).alias("weight"))
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("field", "term", "avg_length", "weight")).alias("features"))
    )


def candidate_terms(index: TextIndex, features: DataFrame) -> DataFrame:
    """``doc_id`` and, per field, what ``FeatureScorer`` reads of a document.

    From a corpus: its words as they are, no shuffle.  From a written index: the postings
    of the wanted terms only, gathered by document.
    """
    if index.postings is None:
        return index.corpus.select("doc_id", *[c for f in index.fields for c in _corpus_columns(f)])
    wanted = stage(features.select(F.inline("features")).select("field", "term").distinct())
    postings = index.postings
    names = wanted.select("term").distinct()
    size = names.agg(F.sum(F.octet_length("term") + F.lit(16))).first()[0]
    if size is not None and size <= FILTER_BYTES:
        postings = postings.where(F.col("term").isin([row.term for row in names.collect()]))
    matched = postings.join(wanted, ["field", "term"], "left_semi")
    gathered = []
    for f in index.fields:
        mine = F.col("field") == f.name
        if f.exact:
            gathered.append(F.max(F.when(mine, F.col("term"))).alias(f.name))
            continue
        pairs = F.collect_list(F.when(mine, F.struct("term", "tf")))
        gathered += [pairs["term"].alias(f.name), pairs["tf"].alias(f"{f.name}#tf")]
        gathered.append(F.max(F.when(mine, F.col("dl"))).cast("int").alias(f"{f.name}#length"))
    return matched.groupBy("doc_id").agg(*gathered)


def _corpus_columns(f: SearchField) -> list[Column]:
    return [f.value.alias(f.name) if f.exact else f.terms().alias(f.name)]
