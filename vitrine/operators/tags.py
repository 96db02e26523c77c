"""Tag containment and tag counts over an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import constants as C
from vitrine.functions.scoring import idf
from vitrine.operators.ranking import top_n
from vitrine.session import stage


def contains_tag(tags: Column, tag: str | Column) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def contains_all(tags: Column, wanted: Column) -> Column:
    return F.coalesce(F.size(F.array_except(wanted, tags)) == 0, F.lit(False))


def has_tags(tags: Column) -> Column:
    return F.coalesce(F.size(tags) > 0, F.lit(False))


def _doc_tags(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", F.explode(F.array_distinct("tags")).alias("tag"))


def tag_matches(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``query_id, doc_id, score`` where a document has every tag of the query.

    ``queries(query_id, tags)``, ``corpus(doc_id, tags)``.  The score is the summed
    inverse frequency of the query's tags, the same for all its hits.
    """
    document_tags = _doc_tags(corpus)
    frequency = document_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    n_docs = corpus.where(has_tags(F.col("tags"))).agg(F.count(F.lit(1))).scalar()
    # Each query looks up its rarest tag only and checks the others on the spot. Staged, so that few lookups are known
    # to be few and the corpus, one row per tag, is neither dealt nor sorted for them.
    lookups = stage(
        queries.select("query_id", F.explode("tags").alias("tag"))
        .join(frequency, "tag", "left")
        .groupBy("query_id")
        .agg(
            F.collect_set("tag").alias("wanted"),
            F.min_by("tag", "df").alias("tag"),
            F.round(F.sum(idf(n_docs, F.col("df"))), C.SCORE_DIGITS).alias("score"),
            F.bool_and(F.col("df").isNotNull()).alias("known"),
        )
        .where("known")
        .drop("known")
    )
    return (
        corpus.select("doc_id", "tags", F.explode(F.array_distinct("tags")).alias("tag"))
        .join(lookups, "tag")
        .where(contains_all(F.col("tags"), F.col("wanted")))
        .select("query_id", "doc_id", "score")
    )


def tag_search(queries: DataFrame, corpus: DataFrame, size: int = C.DEFAULT_SIZE) -> DataFrame:
    """Ranked list ``query_id, doc_id, score, rank``; equal tag lists are searched once."""
    asked = queries.select("query_id", F.array_sort("tags").alias("tags"))
    # Hits carry a number for their tag list: sorted by the list itself, they take several times the memory.
    distinct = stage(asked.select("tags").distinct().withColumn("_list", F.monotonically_increasing_id()))
    hits = tag_matches(distinct.select(F.col("_list").alias("query_id"), "tags"), corpus)
    ranked = top_n(hits, size).withColumnRenamed("query_id", "_list")
    return asked.join(distinct, "tags").join(ranked, "_list").select("query_id", "doc_id", "score", "rank")


def tag_facet(corpus: DataFrame, size: int = C.FACET_SIZE) -> DataFrame:
    """Documents per distinct tag, most frequent first: ``tag, count``."""
    counts = _doc_tags(corpus).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("tag")).limit(size)
