"""CSV with quoted values that span lines, one file read by many tasks.

A file is read as lines by byte range, as Spark divides any text. Whether a line begins inside quotes depends on
all quotes before it: each range counts its quotes, a sum over the ranges before tells its state, and the lines are
joined to records from there. A record that crosses into the next range is put together from its parts. Records are
then parsed by Spark's own CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.session import ship_package, stage

_PARTS = "path string, start long, record long, part long, text string, closed boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _records(states: dict[tuple[str, int], bool]):
    """Task function: lines to records; ``states`` says which ranges begin inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held, inside = None, 0, [], False

        def emit(out, closed):
            out.append((*at, number, 0 if number else 1, "\n".join(held), closed))

        for batch in batches:
            out: list[tuple] = []
            for path, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, start) != at:
                    if held:
                        emit(out, False)
                    # Record 0 of a range is what it finishes for the range before; it may be empty.
                    at, held, inside = (path, start), [], states[path, start]
                    number = 0 if inside else 1
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    emit(out, True)
                    held, number = [], number + 1
            yield _batch(out)
        if held:
            out = []
            emit(out, False)
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "start", "record", "part", "text", "closed"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, start, record, text``: the records of all files below ``path``, the range and the number there of each."""
    ship_package(spark)
    lines = _lines(spark, path)
    quotes = F.sum(F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit(""))))
    counted = lines.groupBy("path", "start").agg(quotes.alias("quotes"))
    before = F.coalesce(F.sum("quotes").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row per byte range of the files.
    states = {(r.path, r.start): bool(r.open) for r in counted.select("path", "start", (before % 2 == 1).alias("open")).collect()}
    parts = stage(lines.mapInArrow(_records(states), _PARTS))
    # A record that is not closed goes on in the ranges after it, as their record 0.
    whole = parts.where("closed AND record > 0").select("path", "start", "record", "text")
    crossing = parts.where("NOT closed OR record = 0")
    by_range = W.partitionBy("path").orderBy("start", "record")
    owner = F.last(F.when(F.col("record") > 0, F.struct("start", "record")), True).over(by_range)
    grouped = crossing.withColumn("owner", owner).groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "record", "text"))).alias("parts"))
    joined = grouped.select("path", F.col("owner.start").alias("start"), F.col("owner.record").alias("record"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(joined)


def read_quoted_catalogue(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``files.read_catalogue``, but a file is read by as many tasks as it has byte ranges.

    The header is the first record of each file, with or without a byte order mark; its names may be quoted, and files
    may have their columns in different order. All columns are strings, empty for what is missing.
    """
    records = read_records(spark, path).withColumn("text", F.regexp_replace("text", "\r$", ""))
    heads = records.groupBy("path").agg(F.min_by("text", F.struct("start", "record")).alias("head"), F.min(F.struct("start", "record")).alias("first"))
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    found = {}
    for row in heads.select("head").distinct().collect():  # the distinct headers
        widest = row.head.count(",") + 1
        cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(widest)])
        plain = spark.range(1).select(F.from_csv(F.lit(row.head.lstrip("﻿")), cells.simpleString()[7:-1].replace(":", " "), options).alias("c")).first().c
        found[row.head] = [n.strip() if n is not None else "" for n in plain]
    bodies = records.join(F.broadcast(heads), "path").where((F.col("start") != F.col("first.start")) | (F.col("record") != F.col("first.record")))
    bodies = bodies.where(F.col("text") != "")
    out = None
    for head, names in found.items():
        cells = ", ".join(f"c{i} string" for i in range(len(names)))
        place = {name: i for i, name in reversed(list(enumerate(names)))}
        parsed = bodies.where(F.col("head") == head).select(F.from_csv("text", cells, options).alias("c"))
        part = parsed.select(*[(F.coalesce(F.col(f"c.c{place[n]}"), F.lit("")) if n in place else F.lit("")).alias(n) for n in schema.names])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in schema.names]))
