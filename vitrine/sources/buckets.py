"""A stored table in hash buckets of its key, changed bucket by bucket.

Rows lie in ``data/<version>/bucket=<n>``. A manifest names the version of each bucket; a change writes the buckets
that it touches as a new version, then a new manifest. The manifest appears by one rename that fails if another
writer was first, so readers see the table before or after a change, never in between, and no change is lost.
What no manifest names any more is deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.enrich import update_matched
from vitrine.operators.ranking import latest_per_key

_BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another writer changed the table first; the change can be tried again."""


@dataclass(frozen=True)
class Manifest:
    """``versions[bucket]`` is the version that holds it; ``applied`` names the changes that are in, by writer."""

    number: int
    key: str
    buckets: int
    schema: str
    versions: dict[int, str]
    applied: dict[str, int] = field(default_factory=dict)


class BucketStore:
    """A table of one row per ``key`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Files, through the file system of the path.

    def _at(self, *parts: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, *parts: str) -> list[str]:
        fs, target = self._at(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def _write(self, text: str, *parts: str) -> None:
        fs, target = self._at(*parts)
        out = fs.create(target, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    def _read(self, *parts: str) -> str:
        return self.spark.read.text("/".join([self.path, *parts]), wholetext=True).first()[0]

    # Manifests.

    def exists(self) -> bool:
        return bool(self._names("manifests"))

    def manifest(self) -> Manifest:
        """The newest manifest: one small file, a line for each bucket."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        if not names:
            raise FileNotFoundError(f"no table in {self.path}")
        held = json.loads(self._read("manifests", names[-1]))
        return Manifest(held["number"], held["key"], held["buckets"], held["schema"], {int(b): v for b, v in held["versions"].items()}, held["applied"])

    def _publish(self, new: Manifest) -> None:
        draft, name = f"draft-{uuid.uuid4().hex}", f"{new.number:012d}.json"
        text = json.dumps({"number": new.number, "key": new.key, "buckets": new.buckets, "schema": new.schema, "versions": new.versions, "applied": new.applied})
        self._write(text, "drafts", draft)
        fs, source = self._at("drafts", draft)
        _, target = self._at("manifests", name)
        fs.mkdirs(target.getParent())
        # A rename onto a file that is there fails in some file systems and replaces it in others.
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, False)
            raise Conflict(f"{name} is there already")

    # Rows.

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")

    def _put(self, rows: DataFrame, key: str, buckets: int) -> str:
        version = uuid.uuid4().hex
        placed = rows.withColumn(_BUCKET, self._bucket(key, buckets))
        placed.repartition(_BUCKET).sortWithinPartitions(_BUCKET, key).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{version}")
        return version

    def create(self, rows: DataFrame, key: str, buckets: int, newest: Sequence[Column] = ()) -> None:
        """Write the table anew; rows without a key are left out, of several with one key the first by ``newest`` stays."""
        if self.exists():
            raise FileExistsError(self.path)
        single = latest_per_key(rows.where(F.col(key).isNotNull()), [key], [*newest, F.desc(F.to_json(F.struct(*rows.columns)))])
        version = self._put(single, key, buckets)
        self._publish(Manifest(0, key, buckets, rows.schema.json(), dict.fromkeys(self._held(version), version)))

    def _held(self, version: str) -> list[int]:
        return [int(n.split("=")[1]) for n in self._names("data", version) if n.startswith(f"{_BUCKET}=")]

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        held = self.manifest()
        return self._rows(held, held.versions if buckets is None else [b for b in buckets if b in held.versions])

    def _rows(self, held: Manifest, buckets) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(held.schema))
        paths = [f"{self.path}/data/{held.versions[b]}/{_BUCKET}={b}" for b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def look_up(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``; only their buckets are read."""
        held = self.manifest()
        wanted = [r[0] for r in keys.select(self._bucket(held.key, held.buckets)).distinct().collect()]
        return self._rows(held, [b for b in wanted if b in held.versions]).join(keys.select(held.key), held.key, "left_semi")

    def _change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], grow: bool, writer: str | None, number: int | None) -> list[int]:
        held = self.manifest()
        if writer is not None and number is not None and held.applied.get(writer, -1) >= number:
            return []
        # The buckets that the changes touch, at most as many numbers as there are buckets.
        touched = sorted(r[0] for r in changes.where(F.col(held.key).isNotNull()).select(self._bucket(held.key, held.buckets)).distinct().collect())
        if not grow:
            touched = [b for b in touched if b in held.versions]
        applied = held.applied if writer is None else held.applied | {writer: number}
        versions = dict(held.versions)
        if touched:
            version = self._put(apply(self._rows(held, [b for b in touched if b in held.versions]), changes), held.key, held.buckets)
            filled = set(self._held(version))
            for b in touched:
                versions.pop(b, None)
                if b in filled:
                    versions[b] = version
        elif applied == held.applied:
            return []
        self._publish(Manifest(held.number + 1, held.key, held.buckets, held.schema, versions, applied))
        return touched

    def update(self, updates: DataFrame, fields: Sequence[str], newest: Sequence[Column] = (), writer: str | None = None, number: int | None = None) -> list[int]:
        """Replace ``fields`` of the rows whose key an update has; no row comes or goes. Gives the buckets rewritten."""
        key = self.manifest().key
        return self._change(updates, lambda rows, new: update_matched(rows, new, key, fields, newest), False, writer, number)

    def upsert(self, rows: DataFrame, newest: Sequence[Column], writer: str | None = None, number: int | None = None) -> list[int]:
        """Add rows, or replace those of the same key unless these are newer. A ``number`` that ``writer`` has written before is left out."""
        key = self.manifest().key
        merge = lambda old, new: latest_per_key(old.unionByName(new.where(F.col(key).isNotNull()).select(*old.columns)), [key], [*newest, F.desc(F.to_json(F.struct(*old.columns)))])
        return self._change(rows, merge, True, writer, number)

    def delete(self, keys: DataFrame) -> list[int]:
        key = self.manifest().key
        return self._change(keys, lambda rows, gone: rows.join(gone.select(key), key, "left_anti"), False, None, None)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all manifests but the last ``keep`` and the data that none of these names; gives the number of versions deleted."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        used: set[str] = set()
        for name in names[-keep:]:
            used |= set(json.loads(self._read("manifests", name))["versions"].values())
        for name in names[:-keep]:
            fs, target = self._at("manifests", name)
            fs.delete(target, False)
        gone = [v for v in self._names("data") if v not in used]
        for version in gone:
            fs, target = self._at("data", version)
            fs.delete(target, True)
        return len(gone)
