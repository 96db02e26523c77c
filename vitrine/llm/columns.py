"""Append columns computed in Arrow tasks to a table, batch by batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.session import ship_package

#: Bytes of text that are worked on at once inside a task.
SLICE_BYTES = 6 << 20
_TEXT = "__llm_text"


_HELD: dict[object, object] = {}


def release() -> None:
    """Give memory that this Python worker no longer needs back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def held_in_worker(key: object, build: Callable[[], object]):
    """What ``build`` gives, kept in the Python worker for later tasks with the same key.

    A worker outlives a job and serves all operators, so only the last one's is kept.
    """
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = build()
        release()
    return _HELD[key]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(base: str, taken) -> str:
    """A column name that none of ``taken`` has, whatever its case."""
    used = {name.lower() for name in taken}
    while base.lower() in used:
        base += "_"
    return base


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text; a longer text stands alone."""
    start, size = 0, 0
    sizes = pc.binary_length(texts).to_pylist()
    for row, n in enumerate(sizes):
        if size + (n or 0) > limit and row > start:
            yield start, row
            start, size = row, 0
        size += n or 0
    if start < len(sizes):
        yield start, len(sizes)


def append_columns(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``fields`` computed from ``text_col``, ``limit`` bytes of text at once.

    ``make()`` runs once per task and returns a function from an Arrow array of texts (null: empty) to one
    array per field. Existing columns with the name of a field are replaced.
    """
    ship_package(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    text = fresh(_TEXT, [*kept, *new])
    source = df.select(*[F.col(quoted(c)) for c in kept], F.coalesce(F.col(quoted(text_col)), F.lit("")).alias(text))
    schema = T.StructType([*[source.schema[i] for i in range(len(kept))], *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(len(kept))
            for start, stop in slices(texts, limit):
                part = batch.slice(start, stop - start)
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *work(part.column(len(kept)))], names=names)
        release()

    return source.mapInArrow(run, schema)
