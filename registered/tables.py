"""Views of the test tables as an item collection, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.vectors import truncate
from vitrine.operators.metadata_similarity import Clauses
from vitrine.operators.terms import SearchField, TextIndex

TEXT_MODEL_DIMS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text vectors: the leading components, renormalised."""
    return vectors(spark, sf_dir).withColumn("vec", truncate(F.col("vec"), TEXT_MODEL_DIMS))


def model_vectors(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"jina_v3": text_vectors(spark, sf_dir), "siglip2": vectors(spark, sf_dir)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts; only a table that comes in fewer partitions than there are cores, such as one small file, is dealt out."""
    texts = table(spark, sf_dir, "documents")
    return texts if texts.rdd.getNumPartitions() >= cores(spark) else texts.repartition(cores(spark))


DOCUMENT_FIELDS = [SearchField("text")]


def document_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return TextIndex.of(documents(spark, sf_dir), DOCUMENT_FIELDS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items with structured metadata."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("doc_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_name").alias("medium"),
        F.col("p_type").alias("classification"),
        F.col("p_brand").alias("department"),
        F.substring_index("p_name", " ", 1).alias("culture"),
        F.concat(F.lit("N"), F.pmod(F.col("p_partkey"), F.lit(25))).alias("artistNationality"),
        F.concat(F.col("p_type"), F.lit(" "), F.pmod(F.col("p_size"), F.lit(5))).alias("period"),
        F.concat(F.lit("D"), F.pmod(F.col("p_size"), F.lit(4))).alias("dynasty"),
        (F.lit(1900) + F.col("p_size")).alias("dateBegin"),
        (F.lit(1900) + F.col("p_size") + F.pmod(F.col("p_partkey"), F.lit(8)).cast("int")).alias("dateEnd"),
        F.col("p_retailprice").alias("width"),
        F.col("p_size").cast("double").alias("height"),
    )


ITEMS_SQL = """
items AS (
  SELECT p_partkey AS doc_id, p_name AS title, p_brand AS artist, p_name AS medium,
         p_type AS classification, p_brand AS department, split_part(p_name, ' ', 1) AS culture,
         'N' || (p_partkey % 25) AS artistNationality, p_type || ' ' || (p_size % 5) AS period, 'D' || (p_size % 4) AS dynasty,
         1900 + p_size AS dateBegin, 1900 + p_size + CAST(p_partkey % 8 AS INT) AS dateEnd,
         p_retailprice AS width, CAST(p_size AS DOUBLE) AS height
  FROM part)"""

ITEM_FIELDS = [
    SearchField("title", 3.0),
    SearchField("artist", 2.0),
    SearchField("classification", 1.5, exact=True),
    SearchField("department", 1.0, exact=True),
]
ITEM_CLAUSES = Clauses()


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries, with the vectors of the same number."""
    models = model_vectors(spark, sf_dir)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    for name, vecs in models.items():
        queries = queries.join(vecs.select(F.col("doc_id").alias("query_id"), F.col("vec").alias(f"vec_{name}")), "query_id", "left")
    return queries


# Word tokens in the regular expression dialect of the SQL engine.
WORD_SQL = (
    r"(?:\p{Nd}+(?:[.,;''\x{2018}\x{2019}]\p{Nd}+)*"
    r"|[\p{L}\p{M}_]+(?:[.:\x{B7}''\x{2018}\x{2019}][\p{L}\p{M}_]+)*)+"
)


def tokens_sql(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{WORD_SQL}')"


def cosine_sql(a: str, b: str) -> str:
    """(1 + cos) / 2 in double precision."""
    x, y = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return (
        f"(1 + list_dot_product({x}, {y}) / sqrt(list_dot_product({x}, {x}) * list_dot_product({y}, {y}))) / 2"
    )


IDF_SQL = "ln(1 + (n_docs - df + 0.5) / (df + 0.5))"
SATURATION_SQL = "2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_length))"
