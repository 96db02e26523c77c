"""Fused keyword and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered import keyword_queries as K
from registered import tables as R
from vitrine.plans.search import SearchOptions, explain_hybrid, hybrid_search, multi_mode_search, route

SIZE = 10


def _sources(ranked):
    return ranked.withColumn("sources", F.array_join("sources", ","))


def hybrid_single(spark, sf_dir):
    return _sources(
        hybrid_search(
            R.benchmark_queries(spark, sf_dir),
            R.document_index(spark, sf_dir),
            R.model_vectors(spark, sf_dir),
            ["siglip2"],
            SIZE,
            fuzzy=False,
        )
    )


def hybrid_multi(spark, sf_dir):
    """Both models, each query with its own balance from 0 to 1."""
    queries = R.benchmark_queries(spark, sf_dir).withColumn("balance", F.pmod("query_id", F.lit(11)) / 10)
    ranked = hybrid_search(
        queries, R.document_index(spark, sf_dir), R.model_vectors(spark, sf_dir), ["jina_v3", "siglip2"], SIZE, fuzzy=False
    )
    return _sources(ranked)


def hybrid_fuzzy(spark, sf_dir):
    """Both models as the search page asks: near words count, and each query has its own balance."""
    queries = R.benchmark_queries(spark, sf_dir).withColumn("balance", F.pmod("query_id", F.lit(11)) / 10)
    return _sources(hybrid_search(queries, R.document_index(spark, sf_dir), R.model_vectors(spark, sf_dir), ["jina_v3", "siglip2"], SIZE))


def hybrid_single_fuzzy(spark, sf_dir):
    return _sources(hybrid_search(R.benchmark_queries(spark, sf_dir), R.document_index(spark, sf_dir), R.model_vectors(spark, sf_dir), ["siglip2"], SIZE))


BALANCES = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def hybrid_balance_sweep(spark, sf_dir):
    """Every passage at six balances, one-sided ends included."""
    queries = R.benchmark_queries(spark, sf_dir).withColumn("balance", F.explode(F.array(*map(F.lit, BALANCES))))
    queries = queries.withColumn("query_id", F.concat(F.col("query_id").cast("string"), F.lit("@"), F.round(F.col("balance") * 100).cast("int").cast("string")))
    ranked = hybrid_search(
        queries, R.document_index(spark, sf_dir), R.model_vectors(spark, sf_dir), ["jina_v3"], SIZE, fuzzy=False
    )
    return _sources(ranked)


def rrf_weights(spark, sf_dir):
    """Explanation of each balance that the discounts, times ten, make up."""
    queries = (
        R.table(spark, sf_dir, "lineitem")
        .select(F.round(F.col("l_discount") * 10, 2).alias("balance"))
        .distinct()
        .withColumn("query_id", F.col("balance"))
    )
    explained = explain_hybrid(queries, ["jina_v3", "siglip2"]).select("query_id", "explain.*")
    return explained.select(
        "query_id",
        "note",
        "balance",
        *[F.round(c, 8).alias(c) for c in ("k", "keyword_raw", "keyword_normalized", "semantic_raw", "semantic_normalized", "semantic_per_model")],
        "keyword_threshold",
        F.round(F.col("semantic_thresholds")["jina_v3"], 8).alias("text_threshold"),
        F.round(F.col("semantic_thresholds")["siglip2"], 8).alias("image_threshold"),
    )


def multi_mode(spark, sf_dir):
    options = SearchOptions(mode="both", size=SIZE, balance=0.5)
    return multi_mode_search(
        R.benchmark_queries(spark, sf_dir),
        R.document_index(spark, sf_dir),
        R.model_vectors(spark, sf_dir),
        options,
        fuzzy=False,
    )


def route_queries(spark, sf_dir):
    """Where each user turn goes; numbers count as emoji."""
    turns = R.table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    digits = R.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.col("o_custkey").cast("string").alias("text")
    )
    return turns.unionByName(digits).withColumn("route", route(F.col("text")))


QUERIES = {
    "hybrid_single": hybrid_single,
    "hybrid_multi": hybrid_multi,
    "hybrid_fuzzy": hybrid_fuzzy,
    "hybrid_single_fuzzy": hybrid_single_fuzzy,
    "hybrid_balance_sweep": hybrid_balance_sweep,
    "rrf_weights": rrf_weights,
    "multi_mode": multi_mode,
    "route_queries": route_queries,
}

_FETCH = 2 * SIZE
_THRESHOLD = {"jina_v3": 0.71, "siglip2": 0.58}
_VECTOR = {"jina_v3": "embedding[1:32]", "siglip2": "embedding"}


def _settings(queries: str) -> str:
    return f"""
settings AS (
  SELECT *, pow(1 - balance, 1.5) / (pow(1 - balance, 1.5) + pow(balance, 1.5)) AS keyword_weight,
         pow(balance, 1.5) / (pow(1 - balance, 1.5) + pow(balance, 1.5)) AS semantic_weight,
         20 + (1 - abs(balance - 0.5) * 2) * 40 AS k
  FROM ({queries}) WHERE item_id IN (SELECT vec_id FROM embeddings)),
keyword_list AS (
  SELECT * FROM (
    SELECT s.*, doc_id, score, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, doc_id) AS rank
    FROM matches m JOIN settings s ON s.item_id = m.query_id) WHERE rank <= {_FETCH})"""


def _semantic(model: str) -> str:
    vec = _VECTOR[model]
    return f"""
{model}_list AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT s.*, d.vec_id AS doc_id, round({R.cosine_sql('q.' + vec, 'd.' + vec)}, 6) AS score
      FROM settings s JOIN embeddings q ON q.vec_id = s.item_id CROSS JOIN embeddings d))
  WHERE rank <= {_FETCH})"""


def _fused(models: list[str], mixed: str) -> str:
    lists = [
        f"SELECT query_id, doc_id, 'keyword' AS source, 0 AS source_idx, rank, keyword_weight / (k + rank) AS part "
        f"FROM keyword_list WHERE score >= 10 AND {mixed}"
    ]
    for position, model in enumerate(models, 1):
        lists.append(
            f"SELECT query_id, doc_id, '{model}', {position}, rank, semantic_weight / {len(models)} / (k + rank) "
            f"FROM {model}_list WHERE score >= CASE WHEN balance > 0.8 THEN {_THRESHOLD[model]} "
            f"ELSE {_THRESHOLD[model]} * 0.7 END AND {mixed}"
        )
    return (
        "lists AS (" + " UNION ALL ".join(lists) + f"""),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen, doc_id) AS rank,
         count(*) OVER (PARTITION BY query_id) AS total
  FROM (SELECT query_id, doc_id, round(sum(part), 10) AS score, min(source_idx * 1000000 + rank) AS first_seen,
               string_agg(source, ',' ORDER BY source_idx) AS sources
        FROM lists GROUP BY ALL))"""
    )


def _with(queries: str, models: list[str], mixed: str = "true", fuzzy: bool = False) -> str:
    words = K.keyword_sql(K.DOCUMENT_SQL_FIELDS, "documents", K.BENCHMARK_QUERIES_SQL, fuzzy, K.EXPAND_FUZZY_TEXT_SQL)
    parts = [words, _settings(queries)]
    return "WITH " + ",\n".join(parts + [_semantic(m) for m in models] + [_fused(models, mixed)])


_COLUMNS = "query_id, doc_id, score, CAST(rank AS INT) AS rank"
_HALF = "SELECT item_id, item_id AS query_id, 0.5::DOUBLE AS balance FROM benchmark"
_SWEEP = (
    "SELECT item_id, item_id || '@' || CAST(round(b * 100) AS INT) AS query_id, b AS balance "
    f"FROM benchmark CROSS JOIN (SELECT unnest([{', '.join(map(str, BALANCES))}]::DOUBLE[]) AS b)"
)
_MIXED = "balance > 0.01 AND balance < 0.99"
# Characters a route to the tags may hold besides white space; the tables hold no other emoji.
_EMOJI_SQL = "[0-9#*]"

_OWN_BALANCE = "SELECT item_id, item_id AS query_id, (item_id % 11) / 10.0::DOUBLE AS balance FROM benchmark"

ORACLE = {
    "hybrid_fuzzy": _with(_OWN_BALANCE, ["jina_v3", "siglip2"], fuzzy=True)
    + f" SELECT {_COLUMNS}, total, sources FROM fused WHERE rank <= {SIZE}",
    "hybrid_single_fuzzy": _with(_HALF, ["siglip2"], fuzzy=True) + f" SELECT {_COLUMNS}, total, sources FROM fused WHERE rank <= {SIZE}",
    "hybrid_single": _with(_HALF, ["siglip2"]) + f" SELECT {_COLUMNS}, total, sources FROM fused WHERE rank <= {SIZE}",
    "hybrid_multi": _with(_OWN_BALANCE, ["jina_v3", "siglip2"])
    + f" SELECT {_COLUMNS}, total, sources FROM fused WHERE rank <= {SIZE}",
    "hybrid_balance_sweep": _with(_SWEEP, ["jina_v3"], _MIXED)
    + f"""
SELECT {_COLUMNS}, total, sources FROM fused WHERE rank <= {SIZE}
UNION ALL SELECT {_COLUMNS}, count(*) OVER (PARTITION BY query_id), 'jina_v3' FROM jina_v3_list WHERE balance >= 0.99 AND rank <= {SIZE}
UNION ALL SELECT {_COLUMNS}, (SELECT count(*) FROM matches m WHERE m.query_id = keyword_list.item_id), 'keyword'
FROM keyword_list WHERE balance <= 0.01 AND rank <= {SIZE}""",
    "rrf_weights": """
WITH b AS (SELECT DISTINCT round(l_discount * 10, 2) AS balance FROM lineitem),
raw AS (SELECT balance, pow(1 - balance, 1.5) AS kw, pow(balance, 1.5) AS sem FROM b)
SELECT balance AS query_id, 'weighted rank fusion' AS note, balance,
       round(20 + (1 - abs(balance - 0.5) * 2) * 40, 8) AS k,
       round(kw, 8) AS keyword_raw, round(kw / (kw + sem), 8) AS keyword_normalized,
       round(sem, 8) AS semantic_raw, round(sem / (kw + sem), 8) AS semantic_normalized,
       round(sem / (kw + sem) / 2, 8) AS semantic_per_model, 10.0::DOUBLE AS keyword_threshold,
       round(CASE WHEN balance > 0.8 THEN 0.71::DOUBLE ELSE 0.71::DOUBLE * 0.7 END, 8) AS text_threshold,
       round(CASE WHEN balance > 0.8 THEN 0.58::DOUBLE ELSE 0.58::DOUBLE * 0.7 END, 8) AS image_threshold
FROM raw""",
    "multi_mode": _with(_HALF, ["jina_v3", "siglip2"])
    + f"""
, all_words AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM matches)
SELECT 'keyword' AS mode, {_COLUMNS} FROM all_words WHERE rank <= {SIZE}
UNION ALL SELECT 'jina_v3', {_COLUMNS} FROM jina_v3_list WHERE rank <= {SIZE}
UNION ALL SELECT 'siglip2', {_COLUMNS} FROM siglip2_list WHERE rank <= {SIZE}
UNION ALL SELECT 'hybrid', {_COLUMNS} FROM fused WHERE rank <= {SIZE}""",
    "route_queries": f"""
SELECT conv_id, turn, text,
       CASE WHEN regexp_matches(text, '{_EMOJI_SQL}') AND trim(regexp_replace(text, '{_EMOJI_SQL}', '', 'g')) = ''
            THEN 'tags' ELSE 'keyword' END AS route
FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'
      UNION ALL SELECT o_orderkey, -1::BIGINT, CAST(o_custkey AS VARCHAR) FROM orders)""",
}
