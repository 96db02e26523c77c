"""Batch model jobs: the model is a callable of the user's, Spark deals out the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import quality, text
from vitrine.session import ship_package

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]
Describer = Callable[[Sequence[str]], Sequence[dict | None]]


def _call(model: Callable, inputs: list) -> list:
    """Model output per input, None for those it fails on."""
    try:
        return list(model(inputs))
    except Exception:  # one bad input must not fail its batch
        if len(inputs) == 1:
            return [None]
        return [out for one in inputs for out in _call(model, [one])]


def embed(rows: DataFrame, load_model: Callable[[], Embedder], model_key: str, dims: int | None = None) -> DataFrame:
    """Vectors of ``text`` (or image URLs) with a ``status`` per row.

    ``rows(artwork_id, text)``.  ``load_model`` runs once per task.  Blank inputs are
    skipped, inputs the model fails on are failed, neither has a vector.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            blank = batch["text"].isna() | (batch["text"].str.strip() == "")
            vectors = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            wanted = batch.index[~blank]
            for at, vector in zip(wanted, _call(model, batch.loc[wanted, "text"].tolist()) if len(wanted) else []):
                vectors[at] = None if vector is None else np.asarray(vector, dtype=np.float32)[:dims]
            status = np.where(blank, "skipped", np.where(vectors.isna(), "failed", "processed"))
            yield pd.DataFrame({"artwork_id": batch["artwork_id"], "embedding": vectors, "status": status})

    ship_package(rows.sparkSession)
    key_type = rows.schema["artwork_id"].dataType.simpleString()
    done = rows.select("artwork_id", "text").mapInPandas(
        run, f"artwork_id {key_type}, embedding array<float>, status string"
    )
    return done.select(
        "artwork_id",
        "embedding",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit(model_key).alias("model"),
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"),
        "status",
    )


def describe(rows: DataFrame, load_model: Callable[[], Describer], model_key: str) -> DataFrame:
    """Generated descriptions of ``image_url``, checked and normalised, with a ``status``.

    ``rows(artwork_id, image_url)``.  The model gives ``alt_text``, ``long_description``
    and ``emoji_summary``; a record that lacks one is failed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            outputs = [out or {} for out in _call(model, batch["image_url"].tolist())]
            fields = ("alt_text", "long_description", "emoji_summary")
            yield pd.DataFrame(
                {"artwork_id": batch["artwork_id"], **{f: [out.get(f) for out in outputs] for f in fields}}
            )

    ship_package(rows.sparkSession)
    key_type = rows.schema["artwork_id"].dataType.simpleString()
    raw = rows.select("artwork_id", "image_url").mapInPandas(
        run, f"artwork_id {key_type}, alt_text string, long_description string, emoji_summary string"
    )
    return checked_descriptions(raw).withColumns(
        {
            "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            "model": F.lit(model_key),
        }
    )


def checked_descriptions(raw: DataFrame) -> DataFrame:
    """Status, leaks, word count and clean emoji of generated texts."""
    alt, long, emoji = F.col("alt_text"), F.col("long_description"), F.col("emoji_summary")
    found = quality.violations(alt, long)
    return raw.withColumns(
        {
            "status": F.when(quality.is_complete(alt, long, emoji), "processed").otherwise("failed"),
            "violations": found,
            "has_violations": F.size(found) > 0,
            "alt_text_words": quality.word_count(alt),
            "alt_text_length_ok": quality.has_expected_length(alt),
            "shows_people": quality.shows_people(emoji),
            "emoji_summary": text.normalize_emoji_summary(emoji),
        }
    )


def vectors_of(records: DataFrame) -> DataFrame:
    """Long vector table of finished embedding records."""
    return records.where(F.col("embedding").isNotNull()).select(
        F.col("artwork_id").alias("doc_id"), "model", F.col("embedding").alias("vec")
    )


def hashing_embedder(dims: int = 64) -> Callable[[], Embedder]:
    """A deterministic stand-in for a model: signed feature hashing of words."""

    def load() -> Embedder:
        import zlib

        def model(texts: Sequence[str]) -> list[list[float]]:
            vectors = []
            for one in texts:
                vector = np.zeros(dims)
                for word in one.lower().split():
                    code = zlib.crc32(word.encode())
                    vector[code % dims] += 1.0 if code & 0x80000000 else -1.0
                norm = np.linalg.norm(vector)
                vectors.append((vector / norm if norm else vector).tolist())
            return vectors

        return model

    return load
