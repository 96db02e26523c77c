"""Joins that enrich items with model output, and what they cover."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text
from vitrine.operators.ranking import latest_per_key


def attach_vectors(items: DataFrame, vectors: Mapping[str, DataFrame]) -> DataFrame:
    """Left join of one vector per model, as a struct ``embeddings``."""
    for model, table in vectors.items():
        items = items.join(table.select("doc_id", F.col("vec").alias(f"_vec_{model}")), "doc_id", "left")
    columns = [f"_vec_{model}" for model in vectors]
    return items.withColumn(
        "embeddings", F.struct(*[F.col(f"_vec_{m}").alias(m) for m in vectors])
    ).drop(*columns)


def attach_descriptions(items: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Left join of generated descriptions; the emoji summary is split into tags."""
    summary = F.col("emoji_summary")
    described = descriptions.select(
        F.col("artwork_id").alias("doc_id"),
        F.col("alt_text").alias("visual_alt_text"),
        F.col("long_description").alias("visual_long_description"),
        summary.alias("visual_emoji_summary"),
        F.when(summary != "", text.emoji_points(summary)).alias("visual_emoji_array"),
        F.struct(
            "model", F.col("timestamp").alias("generated_at"), "has_violations", "violations"
        ).alias("description_metadata"),
    )
    return items.join(described, "doc_id", "left")


def coverage(items: DataFrame, present: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``kind, matched, total, percent``: items that have each kind of model output.

    ``present(doc_id, kind)`` may name items more than once or not in the corpus.
    """
    found = present.select("doc_id", "kind").distinct().join(items.select("doc_id"), "doc_id")
    counts = found.groupBy("kind").agg(F.count(F.lit(1)).alias("matched"))
    names = items.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    total = items.agg(F.count(F.lit(1))).scalar()
    return (
        names.join(counts, "kind", "left")
        .select("kind", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), total.alias("total"))
        .withColumn("percent", F.round(100 * F.col("matched") / F.col("total"), 1))
    )


def backlog(candidates: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Candidates without output yet, the first ``limit`` by key."""
    rest = candidates.join(done.select(key), key, "left_anti")
    return rest.orderBy(key).limit(limit) if limit else rest


def covered(items: DataFrame, present: DataFrame, key: str = "doc_id") -> DataFrame:
    return items.join(present.select(key), key, "left_semi")


def update_matched(
    target: DataFrame, updates: DataFrame, key: str, fields: Sequence[str], newest: Sequence[Column] = ()
) -> DataFrame:
    """Replace ``fields`` where an update has the key; never adds rows.

    Of several updates of a key one counts: the first by ``newest``, then the one with the largest values.
    """
    updates = latest_per_key(updates, [key], [*newest, *[F.desc(F.to_json(F.struct(f))) for f in fields]])
    new = updates.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"))
    joined = target.join(new, key, "left")
    values: list[Column] = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in target.columns
    ]
    return joined.select(*values)


def update_summary(items: DataFrame, target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``status, count``: an item is updated when it has an update and a stored row, else skipped."""
    has_update = updates.select(key).distinct().withColumn("_update", F.lit(True))
    stored = target.select(key).distinct().withColumn("_stored", F.lit(True))
    status = F.when(F.col("_update") & F.col("_stored"), "updated").otherwise("skipped")
    return (
        items.select(key)
        .join(has_update, key, "left")
        .join(stored, key, "left")
        .groupBy(status.alias("status"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def image_share(rows: DataFrame, has_image: Column) -> DataFrame:
    """``checked, with_images, percent``."""
    flag = F.coalesce(has_image, F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(flag).alias("with_images"),
        F.round(100 * F.avg(flag.cast("int")), 1).alias("percent"),
    )


def status_counts(results: DataFrame, violations: Column | None = None) -> DataFrame:
    """One row: processed, skipped, failed and, of those processed, with violations."""
    counters = [F.count_if(F.col("status") == s).alias(s) for s in ("processed", "skipped", "failed")]
    if violations is not None:
        done = F.col("status") == "processed"
        counters.append(F.count_if(done & F.coalesce(violations, F.lit(False))).alias("with_violations"))
    return results.agg(*counters)
