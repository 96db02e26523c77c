"""Incremental ingest of JSON-lines records, last record per key wins."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators.ranking import latest_per_key
from vitrine.sources.buckets import BucketStore


def ingest_records(spark: SparkSession, folder: str, schema: str, key: str, target: str, checkpoint: str, time: str = "timestamp") -> StreamingQuery:
    """Take in what has newly arrived in ``folder`` and stop.

    Each micro-batch becomes one partition of an append-only log.  A repeated batch
    overwrites its own partition only, so a retry after a failure adds nothing twice
    and no old data is rewritten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        records = batch.where(F.col(key).isNotNull())
        order = [F.desc_nulls_last(time), F.desc("_path"), F.desc("_start"), F.desc("_row")]
        newest = latest_per_key(records.withColumn("_row", F.monotonically_increasing_id()), [key], order)
        newest.drop("_path", "_start", "_row").write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    stream = (
        spark.readStream.schema(schema)
        .option("mode", "DROPMALFORMED")
        .json(folder)
        .select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    )
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, target: str, key: str, time: str = "timestamp") -> DataFrame:
    """Newest record of every key of the log."""
    return latest_per_key(spark.read.parquet(target), [key], [F.desc_nulls_last(time), F.desc("batch_id")])


def compact(spark: SparkSession, target: str, snapshot: str, key: str, time: str = "timestamp") -> None:
    """Write the log's current state as a log of one batch to ``snapshot``."""
    newest = read_ingested(spark, target, key, time)
    newest.write.mode("errorifexists").partitionBy("batch_id").parquet(snapshot)


def ingest_into(spark: SparkSession, folder: str, schema: str, store: BucketStore, checkpoint: str, time: str = "timestamp", files_per_batch: int | None = None) -> StreamingQuery:
    """Take what has newly arrived in ``folder`` into a stored table, and stop.

    Each micro-batch rewrites the buckets of its keys only. The manifest says which batches of the checkpoint are in,
    so a batch that is repeated after a failure changes nothing. A record replaces an older one of its key; of the
    same ``time``, the one with the larger values stays, whatever order the files come in.
    """
    writer = hashlib.sha256(checkpoint.encode("utf-8")).hexdigest()

    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, [F.desc_nulls_last(time)], writer, batch_id)

    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
