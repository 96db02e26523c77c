"""Rank windows shared by every ranked list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, n: int, keys: Sequence[str] = ("query_id",), score: str = "score", tie: str = "doc_id") -> DataFrame:
    """Best ``n`` rows per key with a 1-based ``rank``.

    A literal bound on ``row_number`` lets Spark cut each map task to ``n`` rows per
    key before the shuffle, so a key that matches a third of the corpus stays small.
    Spark does so up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows, which
    ``build_session`` raises from its default of 1,000.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last record per key wins, ``order`` lists what is newest first."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def add_total(ranked: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Number of rows per key of an already cut list."""
    return ranked.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
