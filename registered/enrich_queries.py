"""Enrichment joins, coverage, updates, query cache and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered import tables as R
from registered import text_queries as X
from vitrine.operators import enrich
from vitrine.operators.lsh import approximate_search
from vitrine.operators.ranking import latest_per_key
from vitrine.plans import jobs, query_cache
from vitrine.sources.registry import with_collection_names
from vitrine.sources.store import index_stats


def enrich_left(spark, sf_dir):
    """Items with vectors of both models and their text, each where present."""
    items = R.items(spark, sf_dir).select("doc_id", "title")
    with_vectors = enrich.attach_vectors(items, R.model_vectors(spark, sf_dir))
    texts = R.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("artwork_id"),
        F.col("source").alias("alt_text"),
        F.col("text").alias("long_description"),
        F.concat(F.lit("🌊"), F.col("doc_id").cast("string")).alias("emoji_summary"),
        F.col("lang").alias("model"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        F.lit(False).alias("has_violations"),
        F.array().cast("array<string>").alias("violations"),
    )
    return enrich.attach_descriptions(with_vectors, texts).select(
        "doc_id",
        "title",
        F.size("embeddings.jina_v3").alias("text_dims"),
        F.size("embeddings.siglip2").alias("image_dims"),
        "visual_alt_text",
        F.md5("visual_long_description").alias("description_md5"),
        F.array_join("visual_emoji_array", " ").alias("emoji"),
        F.col("description_metadata.model").alias("model"),
    )


def coverage(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select("doc_id")
    present = (
        R.vectors(spark, sf_dir).select("doc_id", F.lit("vectors").alias("kind"))
        .unionByName(R.table(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("kind")))
        .unionByName(R.items(spark, sf_dir).select("doc_id", F.lit("metadata").alias("kind")))
    )
    return enrich.coverage(docs, present, ["vectors", "labels", "metadata", "none"])


def backlog_anti(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return enrich.backlog(docs, R.table(spark, sf_dir, "labels"), "doc_id")


def backlog_batch(spark, sf_dir):
    """The next hundred documents to work on."""
    docs = R.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return enrich.backlog(docs, R.table(spark, sf_dir, "labels"), "doc_id", limit=100)


def semi_covered(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return enrich.covered(docs, R.table(spark, sf_dir, "labels"))


def _updates(spark, sf_dir):
    labels = R.table(spark, sf_dir, "labels")
    moved = labels.select((F.col("doc_id") + 500).alias("doc_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    return moved


def matched_update(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return enrich.update_matched(docs, _updates(spark, sf_dir), "doc_id", ["source"])


def update_counts(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents")
    return enrich.update_summary(R.items(spark, sf_dir), docs, _updates(spark, sf_dir), "doc_id")


def latest_record(spark, sf_dir):
    events = R.table(spark, sf_dir, "events")
    return latest_per_key(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])


def run_counters(spark, sf_dir):
    """Documents with a good label are processed, with a bad one failed, without one skipped."""
    docs = R.table(spark, sf_dir, "documents").join(R.table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "processed").when(F.col("quality") == 0, "failed").otherwise("skipped")
    return enrich.status_counts(docs.withColumn("status", status), F.col("toxic") == 1)


def index_size(spark, sf_dir):
    return index_stats(R.table(spark, sf_dir, "documents")).select("documents", "files")


def image_audit(spark, sf_dir):
    """Share of pages with an image, and with a secure address, per kind of check."""
    pages = R.table(spark, sf_dir, "pages")
    checks = [("image", F.col("html").contains("<img")), ("secure", F.col("url").startswith("https://"))]
    parts = [enrich.image_share(pages, test).withColumn("kind", F.lit(name)) for name, test in checks]
    return parts[0].unionByName(parts[1])


def collection_names(spark, sf_dir):
    part = R.table(spark, sf_dir, "part")
    collection = F.when(F.col("p_type") == "SMALL", "met").when(F.col("p_type") == "LARGE", "moma").otherwise(F.lower("p_type"))
    return with_collection_names(part.select("p_partkey", collection.alias("collection")))


NOW = "2024-01-20 12:00:00"


def _log(spark, sf_dir):
    """User turns as the query log; spelling varies in case and outer space."""
    turns = R.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    typed = turns.withColumn("text", F.concat(F.lit("  "), F.lower("text"), F.lit(" \t")))
    both = turns.unionByName(typed.withColumn("turn", F.col("turn") + 1000))
    return both.select("conv_id", "turn", "text")


def _cache(spark, sf_dir):
    """Vectors of conversations by number, stamped by the event of that number."""
    turns = R.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    stamps = R.table(spark, sf_dir, "events").groupBy((F.col("user_id")).alias("conv_id")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    vectors = R.vectors(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), "vec")
    spread = F.expr("timestampadd(DAY, -CAST(conv_id % 15 AS INT), TIMESTAMP '2024-01-20 11:30:00')")
    stamped = turns.join(vectors, "conv_id").join(stamps, "conv_id", "left")
    fresh = stamped.select(
        F.col("text"), F.col("vec").alias("jina_v3"), F.col("vec").alias("siglip2"), F.least(spread, F.coalesce("last", spread)).alias("ts")
    )
    keyed = query_cache.with_key(fresh).drop("text")
    return latest_per_key(keyed, ["cache_key"], [F.desc("ts")])


def query_keys(spark, sf_dir):
    return query_cache.with_key(_log(spark, sf_dir))


def query_cache_ttl(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    found = query_cache.lookup(_log(spark, sf_dir), _cache(spark, sf_dir), now)
    return found.select("conv_id", "turn", "cache_key", "cache_hit", "ts", F.size("jina_v3").alias("dims"))


def queries_to_embed(spark, sf_dir):
    return query_cache.to_embed(_log(spark, sf_dir), _cache(spark, sf_dir), F.lit(NOW).cast("timestamp"))


def query_cache_after_use(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    return query_cache.after_use(_cache(spark, sf_dir), _log(spark, sf_dir), now).select("cache_key", "ts")


def embed_job(spark, sf_dir):
    """Status, size and length of the vectors of every document and of a blank one beside each."""
    docs = R.documents(spark, sf_dir).select(F.col("doc_id").alias("artwork_id"), "text")
    both = docs.unionByName(docs.select((-1 - F.col("artwork_id")).alias("artwork_id"), F.lit("  ").alias("text")))
    done = jobs.embed(both, jobs.hashing_embedder(64), "hashing")
    length = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)), 4)
    return done.select("artwork_id", "model", "dimension", "status", length.alias("norm"))


def embed_counts(spark, sf_dir):
    return enrich.status_counts(embed_job(spark, sf_dir))


def knn_lsh(spark, sf_dir):
    """Approximate neighbours of every vector."""
    vectors = R.vectors(spark, sf_dir)
    return approximate_search(vectors.withColumnRenamed("doc_id", "query_id"), vectors, 10, exclude_self=True)


QUERIES = {
    "enrich_left": enrich_left,
    "coverage": coverage,
    "backlog_anti": backlog_anti,
    "backlog_batch": backlog_batch,
    "semi_covered": semi_covered,
    "matched_update": matched_update,
    "update_counts": update_counts,
    "latest_per_key": latest_record,
    "run_counters": run_counters,
    "index_stats": index_size,
    "image_audit": image_audit,
    "collection_names": collection_names,
    "query_keys": query_keys,
    "query_cache_ttl": query_cache_ttl,
    "queries_to_embed": queries_to_embed,
    "query_cache_after_use": query_cache_after_use,
    "embed_job": embed_job,
    "embed_counts": embed_counts,
    "knn_lsh": knn_lsh,
}

_LOG = """
turns AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
log AS (SELECT * FROM turns UNION ALL SELECT conv_id, turn + 1000, '  ' || lower(text) || ' ' || chr(9) FROM turns)"""


def _key(column: str) -> str:
    return f"'emb:' || md5({X.trim_sql(f'lower({column})')})"


_CACHE = f"""
stamps AS (SELECT user_id AS conv_id, max(ts) AS last FROM events GROUP BY user_id),
entries AS (
  SELECT {_key('text')} AS cache_key, len(embedding) AS dims,
         least(TIMESTAMP '2024-01-20 11:30:00' - to_days(CAST(t.conv_id % 15 AS INT)),
               coalesce(last, TIMESTAMP '2024-01-20 11:30:00' - to_days(CAST(t.conv_id % 15 AS INT)))) AS ts
  FROM turns t JOIN embeddings e ON e.vec_id = t.conv_id LEFT JOIN stamps s ON s.conv_id = t.conv_id),
cache AS (SELECT cache_key, max(ts) AS ts, any_value(dims) AS dims FROM entries GROUP BY cache_key),
live AS (SELECT * FROM cache WHERE epoch(TIMESTAMP '{NOW}') - epoch(ts) < 604800)"""

ORACLE = {
    "enrich_left": """
SELECT p_partkey AS doc_id, p_name AS title, CAST(len(embedding[1:32]) AS INT) AS text_dims, CAST(len(embedding) AS INT) AS image_dims,
       source AS visual_alt_text, md5(text) AS description_md5,
       CASE WHEN text IS NOT NULL THEN '🌊 ' || array_to_string(string_split(CAST(doc_id AS VARCHAR), ''), ' ') END AS emoji, lang AS model
FROM part LEFT JOIN embeddings ON vec_id = p_partkey LEFT JOIN documents ON doc_id = p_partkey""",
    "coverage": """
WITH present AS (
  SELECT vec_id AS doc_id, 'vectors' AS kind FROM embeddings UNION SELECT doc_id, 'labels' FROM labels
  UNION SELECT p_partkey, 'metadata' FROM part),
kinds(kind) AS (VALUES ('vectors'), ('labels'), ('metadata'), ('none'))
SELECT kind, count(d.doc_id) AS matched, (SELECT count(*) FROM documents) AS total,
       round(100.0::DOUBLE * count(d.doc_id) / (SELECT count(*) FROM documents), 1) AS percent
FROM kinds LEFT JOIN present USING (kind) LEFT JOIN documents d ON d.doc_id = present.doc_id GROUP BY kind""",
    "backlog_anti": "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "backlog_batch": """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100""",
    "semi_covered": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "matched_update": """
SELECT d.doc_id, lang, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || CAST(quality AS VARCHAR) ELSE source END AS source, n_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id + 500""",
    "update_counts": """
SELECT CASE WHEN p_partkey IN (SELECT doc_id + 500 FROM labels) AND p_partkey IN (SELECT doc_id FROM documents)
            THEN 'updated' ELSE 'skipped' END AS status, count(*) AS "count"
FROM part GROUP BY 1""",
    "latest_per_key": """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "run_counters": """
SELECT count(*) FILTER (WHERE quality = 1) AS processed, count(*) FILTER (WHERE quality IS NULL) AS skipped,
       count(*) FILTER (WHERE quality = 0) AS failed, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS with_violations
FROM documents LEFT JOIN labels USING (doc_id)""",
    "index_stats": "SELECT count(*) AS documents, 1::BIGINT AS files FROM documents",
    "image_audit": """
SELECT 'image' AS kind, count(*) AS checked, count(*) FILTER (WHERE html LIKE '%<img%') AS with_images,
       round(100 * avg(CASE WHEN html LIKE '%<img%' THEN 1 ELSE 0 END), 1) AS percent FROM pages
UNION ALL
SELECT 'secure', count(*), count(*) FILTER (WHERE url LIKE 'https://%'),
       round(100 * avg(CASE WHEN url LIKE 'https://%' THEN 1 ELSE 0 END), 1) FROM pages""",
    "collection_names": """
SELECT p_partkey, c AS collection,
       CASE c WHEN 'met' THEN 'The Metropolitan Museum of Art' WHEN 'moma' THEN 'Museum of Modern Art' ELSE c END AS collection_name,
       CASE c WHEN 'met' THEN 'The Met' WHEN 'moma' THEN 'MoMA' ELSE c END AS collection_short_name
FROM (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'met' WHEN 'LARGE' THEN 'moma' ELSE lower(p_type) END AS c FROM part)""",
    "query_keys": f"WITH {_LOG} SELECT conv_id, turn, text, {_key('text')} AS cache_key FROM log",
    "query_cache_ttl": f"""
WITH {_LOG}, {_CACHE}
SELECT conv_id, turn, k AS cache_key, ts IS NOT NULL AS cache_hit, ts, CAST(dims AS INT) AS dims
FROM (SELECT conv_id, turn, {_key('text')} AS k FROM log) LEFT JOIN live ON k = cache_key""",
    "queries_to_embed": f"""
WITH {_LOG}, {_CACHE}
SELECT k AS cache_key, min(text) AS text FROM (SELECT text, {_key('text')} AS k FROM log)
WHERE k NOT IN (SELECT cache_key FROM live) GROUP BY k""",
    "query_cache_after_use": f"""
WITH {_LOG}, {_CACHE}
SELECT cache_key, CASE WHEN cache_key IN (SELECT {_key('text')} FROM log)
                        AND epoch(TIMESTAMP '{NOW}') - epoch(ts) > 3600 THEN TIMESTAMP '{NOW}' ELSE ts END AS ts
FROM live""",
    "embed_job": """
SELECT doc_id AS artwork_id, 'hashing' AS model, 64::INT AS dimension, 'processed' AS status, 1.0::DOUBLE AS norm FROM documents
UNION ALL SELECT -1 - doc_id, 'hashing', NULL, 'skipped', NULL FROM documents""",
    "embed_counts": """
SELECT count(*) AS processed, count(*) AS skipped, 0::BIGINT AS failed FROM documents""",
}
