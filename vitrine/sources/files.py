"""CSV and JSON-lines files in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.ranking import latest_per_key


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Catalogue CSV with a header: all strings, empty for what is missing.

    Quoted values may span lines, which makes a file one unit of work; give a folder of
    files for parallel reading, or ``multi_line=False`` where no value spans lines.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', encoding="UTF-8")
    named = {name.lstrip("\ufeff"): name for name in raw.columns}
    wanted = [
        F.coalesce(F.col(f"`{named[n]}`"), F.lit("")).alias(n) if n in named else F.lit("").alias(n)
        for n in schema.names
    ]
    return raw.select(*wanted)


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None, time: str | None = None) -> DataFrame:
    """JSON-lines records; bad lines are skipped, a missing path is an empty table.

    With ``key`` the last record of each key is kept: the one furthest down in the newest
    file, whatever its stamp.  With ``time`` the newest stamp comes first.
    """
    try:
        raw = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if key is None:
        return raw
    position = ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"]
    placed = raw.select("*", *[F.col(p).alias(f"_p{i}") for i, p in enumerate(position)])
    placed = placed.withColumn("_p3", F.monotonically_increasing_id()).where(F.col(key).isNotNull())
    order = ([F.desc_nulls_last(time)] if time else []) + [F.desc(f"_p{i}") for i in range(4)]
    return latest_per_key(placed, [key], order).drop(*[f"_p{i}" for i in range(4)])


def write_jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def image_cache_rows(fetched: DataFrame) -> DataFrame:
    """Cache rows of fetched objects; one has an image when its main image is not empty."""
    text_columns = ["primaryImage", "primaryImageSmall", "title", "artistDisplayName", "objectDate"]
    return fetched.select(
        "object_id",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in text_columns],
        F.coalesce(F.col("primaryImage") != "", F.lit(False)).alias("hasImage"),
        F.col("fetched_at"),
    )
