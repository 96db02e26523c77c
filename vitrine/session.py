"""Session settings and staged tables in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables that ``stage`` has written.
_STAGED: list[str] = []


def build_session(app_name: str = "vitrine", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Ranked lists are cut in the map tasks up to this length.
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "100000")
        # Long texts travel to Python tasks in batches of this many rows.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context."""
    context = spark.sparkContext
    if getattr(context, "_has_vitrine", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="vitrine-code-"), "vitrine_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._has_vitrine = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a private one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    created = tempfile.mkdtemp(prefix="vitrine-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that a lost executor re-reads files instead of recomputing, and
    gives the planner the true size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """A mark for ``drop_staged``: how many tables are staged by now."""
    return len(_STAGED)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_staged(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables staged so far, or since a mark, once the results that read them are done; gives their number."""
    dropped = len(_STAGED) - since
    while len(_STAGED) > since:
        delete_path(spark, _STAGED.pop())
    return dropped
