"""Vectors of past queries, kept a week from their last use."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import constants as C
from vitrine.functions import text
from vitrine.operators.ranking import latest_per_key
from vitrine.plans.jobs import Embedder, embed


def age_seconds(stamp: Column, now: Column) -> Column:
    return F.unix_micros(now) / 1e6 - F.unix_micros(stamp) / 1e6


def is_live(stamp: Column, now: Column) -> Column:
    return age_seconds(stamp, now) < C.CACHE_TTL_SECONDS


def with_key(queries: DataFrame) -> DataFrame:
    return queries.withColumn("cache_key", text.cache_key(F.col("text")))


def lookup(queries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Queries with the live vectors of their key, and ``cache_hit``."""
    live = cache.where(is_live(F.col("ts"), now)).withColumn("cache_hit", F.lit(True))
    return with_key(queries).join(live, "cache_key", "left").withColumn(
        "cache_hit", F.coalesce("cache_hit", F.lit(False))
    )


def to_embed(queries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """One row ``cache_key, text`` per distinct query without live vectors.

    Every spelling of a key embeds alike, so the least spelling stands for them all.
    """
    live = cache.where(is_live(F.col("ts"), now)).select("cache_key")
    return with_key(queries).groupBy("cache_key").agg(F.min("text").alias("text")).join(live, "cache_key", "left_anti")


def after_use(cache: DataFrame, queries: DataFrame, now: Column) -> DataFrame:
    """Cache with the stamp renewed for entries that were read and are over an hour old; dead entries go."""
    used = with_key(queries).select("cache_key").distinct().withColumn("_used", F.lit(True))
    stale = F.col("_used") & (age_seconds(F.col("ts"), now) > C.CACHE_REFRESH_SECONDS)
    return (
        cache.where(is_live(F.col("ts"), now))
        .join(used, "cache_key", "left")
        .withColumn("ts", F.when(stale, now).otherwise(F.col("ts")))
        .drop("_used")
    )


def merged(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache with new entries; only those with both vectors are kept, the newest per key wins."""
    complete = fresh.where(F.col("jina_v3").isNotNull() & F.col("siglip2").isNotNull())
    return latest_per_key(cache.unionByName(complete), ["cache_key"], [F.desc("ts")])


def embed_missing(queries: DataFrame, cache: DataFrame, load_models: Mapping[str, Callable[[], Embedder]], now: Column) -> DataFrame:
    """Fresh cache entries: each distinct query without live vectors is embedded once per model."""
    missing = to_embed(queries, cache, now).select(F.col("cache_key").alias("artwork_id"), "text")
    entries = missing.select(F.col("artwork_id").alias("cache_key"))
    for model, load in load_models.items():
        vectors = embed(missing, load, model).select(
            F.col("artwork_id").alias("cache_key"), F.col("embedding").alias(model)
        )
        entries = entries.join(vectors, "cache_key", "left")
    return entries.withColumn("ts", now.cast("timestamp"))
