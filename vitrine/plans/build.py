"""Building a collection: read, enrich, report coverage, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.operators.enrich import attach_descriptions, coverage
from vitrine.operators.terms import TextIndex, default_fields
from vitrine.plans.jobs import vectors_of
from vitrine.sources import store
from vitrine.sources.files import read_jsonl
from vitrine.sources.registry import read_source


def read_model_output(spark: SparkSession, folder: str, models: Sequence[str] = tuple(schemas.EMBEDDING_MODELS)) -> tuple[DataFrame, DataFrame]:
    """(long vector table, descriptions) of a collection's output folder; what is missing is empty."""
    vectors = None
    for model in models:
        path = f"{folder}/embeddings/{model}/embeddings.jsonl"
        records = read_jsonl(spark, path, schemas.EMBEDDING_RECORD, "artwork_id")
        table = vectors_of(records.withColumn("model", F.lit(model)))
        vectors = table if vectors is None else vectors.unionByName(table)
    descriptions = read_jsonl(
        spark, f"{folder}/descriptions/descriptions.jsonl", schemas.DESCRIPTION_RECORD, "artwork_id"
    )
    return vectors, descriptions


def coverage_report(items: DataFrame, vectors: DataFrame, descriptions: DataFrame) -> DataFrame:
    present = vectors.select("doc_id", F.col("model").alias("kind")).unionByName(
        descriptions.select(F.col("artwork_id").alias("doc_id"), F.lit("descriptions").alias("kind"))
    )
    return coverage(items, present, [*schemas.EMBEDDING_MODELS, "descriptions"])


def build_collections(
    spark: SparkSession, sources: dict[str, dict], out: str, force: bool = False, include_descriptions: bool = True
) -> dict:
    """Build one collection table from several sources.

    ``sources[id]`` holds the reader's options and ``output``, the folder of model
    output.  Writes ``items``, ``vectors`` and ``index`` under ``out``.
    """
    all_items, all_vectors, all_descriptions = None, None, None
    for collection, options in sources.items():
        options = dict(options)
        vectors, descriptions = read_model_output(spark, options.pop("output"))
        items = read_source(spark, collection, **options)
        all_items = items if all_items is None else all_items.unionByName(items)
        all_vectors = vectors if all_vectors is None else all_vectors.unionByName(vectors)
        all_descriptions = descriptions if all_descriptions is None else all_descriptions.unionByName(descriptions)
    enriched = attach_descriptions(all_items, all_descriptions).withColumn("indexed_at", F.current_timestamp())
    counts = store.load_items(enriched, f"{out}/items", force)
    if counts is None:
        return {"indexed": 0, "existing": True}
    stored = spark.read.parquet(f"{out}/items")
    # A vector without an item in the collection is of no use to any search.
    store.write_vectors(all_vectors.join(stored.select("doc_id"), "doc_id", "left_semi"), f"{out}/vectors")
    TextIndex.of(stored, default_fields(include_descriptions)).write(f"{out}/index")
    return counts
