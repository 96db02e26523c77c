"""A corpus pipeline: quality, language, repeated passages of lines, near duplicates, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import langid, line_chunks, packing, quality, wide_simhash
from vitrine.llm.registered import WORD_VOCABULARY, table, trained
from vitrine.session import delete_path, drop_staged, shared_dir, staged_so_far

#: The columns of the table of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose language is less certain than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: Near duplicates: words of a shingle and the least similarity of their sets.
SHINGLE, SIMILARITY = 5, 0.8


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that are not held out.

    A null text is judged as an empty one; repeated rows stay or go together; labels of other documents count for nothing.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels").where(trained()))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and those without a letter go, repeated rows stay or go together."""
    model = langid.train(docs.where(trained()))
    named = langid.identify(docs, model)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of lines that stood before; ``n_chars`` follows the text."""
    left = line_chunks.remove_passages(docs)
    return left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, and all documents without an id.

    Empty and null texts are one group; of rows that repeat an id one stays.
    """
    return wide_simhash.representatives(docs, shingle=SHINGLE, similarity=SIMILARITY).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a null text is its end token alone."""
    packed = packing.pack_documents(docs, WORD_VOCABULARY)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_language),
    ("line_dedup", remove_passages),
    ("near_dedup", keep_one_of_near_duplicates),
    ("packing", pack),
]
#: Fitted models and packing have no twin in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each is written to the shared folder and read by the next.

    What a stage has staged, and its input, are deleted once its result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        mark = staged_so_far()
        result = stage(spark, docs, sf_dir)
        path = f"{folder}/{number}-{name}"
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        drop_staged(spark, mark)
        if before:
            delete_path(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
