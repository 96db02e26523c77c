"""Exact duplicates of texts by a stateful stream.

The stream keeps one row of state per distinct text and never lets it expire: the digest, how many rows had it, and
identifier and place of the row that stays. The state lives in RocksDB on the executors' disks, with its
checkpoint in the shared folder, so a lost executor's state is loaded elsewhere and later files continue it.
Digests only propose hits: the bytes of all texts that share a digest are compared before a row is dropped.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.columns import append_columns
from vitrine.session import shared_dir, stage

#: State on the executors' disks, which takes no more room than it holds: by default every store reserves megabytes in advance.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows of one text that are decided in one share.
ROWS_OF_SHARE = 256
#: Files that one micro-batch takes in.
FILES_PER_BATCH = 1000


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def normalised(df: DataFrame, id_col: str, text_col: str, bytes_too: bool, digest: Callable[[bytes], bytes], keep: list[str] | None = None) -> DataFrame:
    """``digest`` of each text with A-Z in lower case, and the ``bytes`` themselves if asked for."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            low = [t.lower() for t in texts.cast(pa.binary()).to_pylist()]  # bytes: only A-Z change
            out = [pa.array([digest(t) for t in low], pa.binary())]
            return [*out, pa.array(low, pa.binary())] if bytes_too else out

        return work

    fields = [T.StructField("digest", T.BinaryType(), True)]
    if bytes_too:
        fields.append(T.StructField("bytes", T.BinaryType(), True))
    return append_columns(df, text_col, make, fields, keep or [id_col])


def _pattern(path: str) -> str:
    """``path`` as a pattern that matches it alone: a stream takes a pattern for one file too, a plain path only for a folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/[{name[0]}]{name[1:]}" if not any(c in name for c in "*?[]{}") else path


def ingest(spark: SparkSession, path: str, checkpoint: str, id_col: str, text_col: str, digest=None, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Run the stream over the files of ``path`` that ``checkpoint`` has not seen, then stop."""
    static = spark.read.parquet(path)
    source = (
        spark.readStream.schema(static.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(_pattern(path))
        .select(F.col(id_col), F.col(text_col), F.col("_metadata.file_path").alias("__place"))
    )
    hashed = normalised(source, id_col, text_col, False, digest or sha256, [id_col, "__place"])
    state = hashed.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct(id_col, "__place")).alias("kept")
    )
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def retained(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keyed state: ``digest``, ``group_size``, ``keep_id`` and ``place``, the file of the row that stays."""
    state = spark.read.format("statestore").load(checkpoint)
    names = state.schema["value"].dataType.names
    kept = next(n for n in names if isinstance(state.schema["value"].dataType[n].dataType, T.StructType))
    size = next(n for n in names if n != kept)
    inner = state.schema["value"].dataType[kept].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.`{size}`").alias("group_size"),
        F.col(f"value.`{kept}`.`{inner[0]}`").alias("keep_id"),
        F.col(f"value.`{kept}`.`{inner[1]}`").alias("place"),
    )


def _located(spark: SparkSession, table: DataFrame, state: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """The rows that stay of hit digests and lie in files that ``table`` doesn't read, fetched by their place; None without any."""
    own = table.select(F.col("_metadata.file_path").alias("place")).distinct()
    elsewhere = stage(state.where("group_size > 1").join(own, "place", "left_anti").select(F.col("keep_id").alias("__kept"), "place"))
    files = [r.place for r in elsewhere.select("place").distinct().collect()]  # names of files, not rows
    if not files:
        return None
    rows = spark.read.schema(table.schema).parquet(*files).select(id_col, text_col, F.col("_metadata.file_path").alias("__place"))
    found = rows.join(elsewhere, (F.col("__place") == F.col("place")) & F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi")
    return found.select(id_col, text_col)


def duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, digest=sha256) -> DataFrame:
    """``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``digest`` of every row of the files in ``path``.

    Texts are equal when their bytes are, A-Z in lower case; null counts as empty. Of a group the largest id stays;
    a null id is below all others, and rows that repeat an id share its decision. An empty table gives no rows;
    other columns are left out. ``checkpoint`` is the folder of a stream to continue, a new one by default; rows of
    files that it took in before count, also where ``path`` no longer holds these files.

    ``keep_id`` and ``group_size`` are those of the state. The bytes of all hits are compared, those of a row that
    stays in an earlier file being fetched from its place. Should texts that differ share a digest, their bytes decide
    over the rows at hand instead.
    """
    continued = checkpoint is not None
    checkpoint = checkpoint or f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    ingest(spark, path, checkpoint, id_col, text_col, digest)
    state = stage(retained(spark, checkpoint))
    whole = spark.read.parquet(path)
    table = whole.select(id_col, text_col)
    located = _located(spark, whole, state, id_col, text_col) if continued else None
    # The bytes of all hits, one row per distinct text: tasks merge equal copies before anything is shuffled.
    hit = state.where("group_size > 1").select("digest")
    texts = (
        normalised(table if located is None else table.unionByName(located), id_col, text_col, True, digest)
        .join(hit, "digest", "left_semi")
        .groupBy("digest", "bytes")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(id_col).alias("keep_id"))
    )
    several = stage(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    decided = state.select("digest", "keep_id", "group_size").join(several, "digest", "left_anti")
    # A text that a third of the rows hold is decided in as many shares as its rows need.
    hot = stage(decided.where(F.col("group_size") > ROWS_OF_SHARE).select("digest", F.ceil(F.col("group_size") / ROWS_OF_SHARE).cast("int").alias("dealt")))
    shares = F.ceil(F.col("group_size") / ROWS_OF_SHARE).cast("int")
    known = decided.select("digest", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)).alias("share"))
    hashed = normalised(table, id_col, text_col, False, digest).join(hot, "digest", "left")
    share = F.pmod(F.xxhash64(F.col(id_col)), F.coalesce("dealt", F.lit(1))).cast("int")
    rows = hashed.withColumn("share", share).drop("dealt").join(known, ["digest", "share"]).drop("share")
    if not several.isEmpty():  # different texts with one digest are told apart by their bytes
        again = normalised(table, id_col, text_col, True, digest).join(several, "digest", "left_semi")
        rows = rows.unionByName(again.join(texts, ["digest", "bytes"]).drop("bytes"))
    return rows.select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )
