"""Collections by name: a source is a function to a DataFrame of unified items."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine import schemas
from vitrine.functions import text
from vitrine.sources.files import read_catalogue, read_jsonl
from vitrine.sources.normalize import normalize_source1, normalize_source2

Reader = Callable[..., DataFrame]


@dataclass(frozen=True)
class Source:
    id: str
    name: str
    read: Reader


_SOURCES: dict[str, Source] = {}


def register_source(collection_id: str, name: str, reader: Reader) -> Source:
    """Add a collection; ``reader(spark, **paths)`` gives unified items."""
    source = Source(collection_id, name, reader)
    _SOURCES[collection_id] = source
    return source


def source_ids() -> list[str]:
    return sorted(_SOURCES)


def _names(kind: T.DataType) -> list:
    return [(f.name, f.dataType.simpleString()) for f in kind.fields] if isinstance(kind, T.StructType) else [kind]


def read_source(spark: SparkSession, collection_id: str, **options) -> DataFrame:
    """Items of a registered collection, its schema checked."""
    items = _SOURCES[collection_id].read(spark, **options)
    expected = spark.createDataFrame([], schemas.ITEM).schema
    if _names(items.schema) != _names(expected):
        raise TypeError(f"source {collection_id} gives {items.schema.simpleString()}, not {expected.simpleString()}")
    return items


def _read_first(spark: SparkSession, csv: str, image_cache: str, limit: int | None = None) -> DataFrame:
    cache = read_jsonl(spark, image_cache, schemas.IMAGE_CACHE_RECORD, "object_id")
    return normalize_source1(read_catalogue(spark, csv, schemas.SOURCE1_CSV), cache, limit)


def _read_second(spark: SparkSession, csv: str, limit: int | None = None) -> DataFrame:
    return normalize_source2(read_catalogue(spark, csv, schemas.SOURCE2_CSV), limit)


register_source("met", schemas.COLLECTIONS["met"].display_name, _read_first)
register_source("moma", schemas.COLLECTIONS["moma"].display_name, _read_second)


def with_collection_names(hits: DataFrame, column: str = "collection") -> DataFrame:
    """Display and short name of the collection of each hit; an unknown id names itself."""
    collections = schemas.COLLECTIONS.values()
    return hits.select(
        "*",
        text.lookup({c.id: c.display_name for c in collections}, F.col(column)).alias("collection_name"),
        text.lookup({c.id: c.short_name for c in collections}, F.col(column)).alias("collection_short_name"),
    )
