"""Files and stored collections: the given tables written out, read back and looked up; jobs over them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from registered import enrich_queries as E
from registered import tables as R
from vitrine import schemas
from vitrine.operators.knn import semantic_search
from vitrine.plans import jobs, query_cache
from vitrine.session import shared_dir
from vitrine.sources import files, store
from vitrine.sources.buckets import BucketStore
from vitrine.sources.quoted_csv import read_quoted_catalogue
from vitrine.streaming.ingest import ingest_into
from vitrine.streaming.query_keys import needing_vectors, rocksdb_state


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"


def csv_scan(spark, sf_dir):
    """Parts as a catalogue in CSV; a column that the file lacks is empty."""
    path = _folder(spark)
    R.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").write.csv(path, header=True)
    wanted = T.StructType([T.StructField(n, T.StringType()) for n in ("p_partkey", "p_name", "p_brand", "p_missing")])
    return files.read_catalogue(spark, path, wanted, multi_line=False)


_EVENT = "user_id long, event_id long, event_type string"


def _event_lines(spark, sf_dir) -> str:
    """Events as JSON lines, those of a user in one file and in order."""
    path = _folder(spark)
    events = R.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    files.write_jsonl(events.repartition("user_id").sortWithinPartitions("user_id", "event_id"), path)
    return path


def jsonl_last_line(spark, sf_dir):
    return files.read_jsonl(spark, _event_lines(spark, sf_dir), _EVENT, "user_id")


def jsonl_rows(spark, sf_dir):
    """Rows of a file that is there, and of one that is not."""
    path = _event_lines(spark, sf_dir)
    counts = [
        files.read_jsonl(spark, p, _EVENT).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("file"), "rows")
        for name, p in (("events", path), ("missing", f"{path}-none"))
    ]
    return counts[0].unionByName(counts[1])


def image_cache_file(spark, sf_dir):
    """Pages as fetched objects, written to the image cache and read back."""
    pages = R.table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    fetched = pages.select(
        F.col("page_id").cast("string").alias("object_id"),
        F.when(F.col("url").startswith("https://"), F.col("url")).alias("primaryImage"),
        none.alias("primaryImageSmall"), F.col("url").alias("title"), none.alias("artistDisplayName"), none.alias("objectDate"),
        F.lit("2024-01-01").alias("fetched_at"),
    )
    path = _folder(spark)
    files.write_jsonl(files.image_cache_rows(fetched), path)
    return files.read_jsonl(spark, path, schemas.IMAGE_CACHE_RECORD, "object_id").select("object_id", "primaryImage", "title", "hasImage")


def _load(spark, sf_dir) -> tuple[str, dict]:
    """Documents as items; each comes twice and every tenth has no id."""
    path = _folder(spark)
    docs = R.table(spark, sf_dir, "documents")
    named = F.when(F.pmod("doc_id", F.lit(10)) != 0, F.concat(F.lit("d_"), F.col("doc_id")))
    items = docs.select(named.alias("doc_id"), F.struct(F.col("source").alias("collection"), "lang", "n_chars").alias("metadata"))
    counts = store.load_items(items.unionByName(items), path)
    if store.load_items(items, path) is not None:
        raise ValueError("an existing collection was replaced")
    return path, counts


def load_counts(spark, sf_dir):
    """What a load says of itself, next to what the stored table holds."""
    path, counts = _load(spark, sf_dir)
    stored = store.index_stats(spark.read.parquet(path)).select("documents")
    return stored.select("documents", *[F.lit(counts[k]).cast("long").alias(k) for k in ("indexed", "failed")])


def stored_items(spark, sf_dir):
    stored = spark.read.parquet(_load(spark, sf_dir)[0])
    return stored.select("doc_id", "collection", "metadata.lang", "metadata.n_chars")


def stored_item(spark, sf_dir):
    """One item of the stored collection by its id, with its own vector of one model."""
    path = _folder(spark)
    item = store.item_by_id(spark.read.parquet(_load(spark, sf_dir)[0]), "d_7").select("doc_id", "collection")
    store.write_vectors(_long_vectors(spark, sf_dir), path)
    own = store.vector_of(spark.read.parquet(path), "d_7", "siglip2")
    return item.join(own, "doc_id").select("doc_id", "collection", F.size("vec").alias("dims"))


def _long_vectors(spark, sf_dir):
    parts = [
        v.select(F.concat(F.lit("d_"), F.col("doc_id")).alias("doc_id"), F.lit(m).alias("model"), "vec")
        for m, v in R.model_vectors(spark, sf_dir).items()
    ]
    return parts[0].unionByName(parts[1])


def stored_vectors(spark, sf_dir):
    path = _folder(spark)
    store.write_vectors(_long_vectors(spark, sf_dir), path)
    return store.vectors_per_model(spark.read.parquet(path))


def knn_without_direction(spark, sf_dir):
    """Neighbours of every vector, a fifth of which are zero and so match nothing."""
    zero = F.transform("vec", lambda x: x * 0)
    some = R.vectors(spark, sf_dir).withColumn("vec", F.when(F.pmod("doc_id", F.lit(5)) == 0, zero).otherwise(F.col("vec")))
    return semantic_search(some.withColumnRenamed("doc_id", "query_id"), some, 5, spread=R.cores(spark))


def _describer():
    def model(urls):
        text = {"alt_text": "a boat on calm water", "long_description": "green hills behind a boat"}
        return [{**text, "emoji_summary": "🌊"} if url.startswith("https://") else text for url in urls]

    return model


def describe_job(spark, sf_dir):
    """Descriptions of every page; the model leaves out the emoji of insecure ones, which then fail."""
    rows = R.table(spark, sf_dir, "pages").select(F.col("page_id").alias("artwork_id"), F.col("url").alias("image_url"))
    done = jobs.describe(rows, lambda: _describer(), "stand-in")
    return done.select("artwork_id", "status", "has_violations", "alt_text_words", "model")


def embed_missing(spark, sf_dir):
    """Fresh vectors of the queries that the cache does not hold, by two models."""
    now = F.lit(E.NOW).cast("timestamp")
    models = {"jina_v3": jobs.hashing_embedder(16), "siglip2": jobs.hashing_embedder(24)}
    fresh = query_cache.embed_missing(E._log(spark, sf_dir), E._cache(spark, sf_dir), models, now)
    return fresh.select("cache_key", F.size("jina_v3").alias("text_dims"), F.size("siglip2").alias("image_dims"))


def csv_multi_line(spark, sf_dir):
    """Documents as CSV files, one per task, with byte order marks, quotes and line ends in values, read by byte ranges."""
    path = _folder(spark)
    docs = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("\ufeffdoc_id"), "text", "source")
    whole = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    docs.write.options(**whole).csv(path, header=True)
    wanted = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "text", "source", "missing")])
    return read_quoted_catalogue(spark, path, wanted)


def store_updates(spark, sf_dir):
    """A stored collection that is changed twice, a fifth of it deleted and some of it added to."""
    docs = R.table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(None).cast("string").alias("note"), "n_chars")
    stored = BucketStore(spark, _folder(spark))
    stored.create(docs, "doc_id", 16)
    note = lambda n, text: docs.where(F.pmod("doc_id", F.lit(n)) == 0).select("doc_id", F.lit(text).alias("note"))
    stored.update(note(2, "even"), ["note"])
    stored.update(note(3, "third").unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("unknown").alias("note"))), ["note"])
    stored.delete(docs.where(F.pmod("doc_id", F.lit(5)) == 4).select("doc_id"))
    more = docs.where("n_chars % 7 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "source", F.lit("new").alias("note"), "n_chars")
    stored.upsert(more, [F.desc("n_chars")])
    return stored.read()


_TURN = "conv_id long, turn long, role string, n_chars int"


def ingest_stream(spark, sf_dir):
    """Turns that arrive in files, a batch each, into a table of the newest turn of every conversation."""
    turns = R.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("n_chars"))
    arriving = _folder(spark)
    files.write_jsonl(turns.repartition(5, "turn"), arriving)
    stored = BucketStore(spark, _folder(spark))
    stored.create(spark.createDataFrame([], _TURN), "conv_id", 8)
    stream = ingest_into(spark, arriving, _TURN, stored, _folder(spark), "turn", files_per_batch=2)
    stream.awaitTermination()
    return stored.read()


def _asked(spark, sf_dir):
    """The first word of each user turn as a query, two hours apart."""
    turns = R.table(spark, sf_dir, "conversations").where("role = 'user'")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("conv_id") * 5 + F.col("turn")) * 7200)
    return turns.select(F.substring_index("text", " ", 1).alias("text"), at.alias("ts"))


def query_stream(spark, sf_dir):
    """The queries of a stream that need vectors, as each use within the week renews what is there."""
    arriving, out = _folder(spark), _folder(spark)
    _asked(spark, sf_dir).coalesce(1).write.parquet(arriving)
    before = rocksdb_state(spark)
    try:
        asked = spark.readStream.schema("text string, ts timestamp").parquet(arriving)
        sink = needing_vectors(spark, asked).writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark))
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema("cache_key string, text string, ts timestamp").parquet(out)


QUERIES = {
    "csv_multi_line": csv_multi_line,
    "store_updates": store_updates,
    "ingest_stream": ingest_stream,
    "query_stream": query_stream,
    "csv_scan": csv_scan,
    "jsonl_last_line": jsonl_last_line,
    "jsonl_rows": jsonl_rows,
    "image_cache_file": image_cache_file,
    "load_counts": load_counts,
    "stored_items": stored_items,
    "stored_item": stored_item,
    "stored_vectors": stored_vectors,
    "knn_without_direction": knn_without_direction,
    "describe_job": describe_job,
    "embed_missing": embed_missing,
}

ORACLE = {
    "csv_multi_line": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, '' AS missing FROM documents",
    "store_updates": """
SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'third' WHEN doc_id % 2 = 0 THEN 'even' END AS note, n_chars FROM documents WHERE doc_id % 5 <> 4
UNION ALL SELECT doc_id + 1000000, source, 'new', n_chars FROM documents WHERE n_chars % 7 = 0""",
    "ingest_stream": """
SELECT conv_id, turn, role, CAST(length(text) AS INT) AS n_chars FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "query_stream": f"""
WITH RECURSIVE asked AS (
  SELECT {E._key('word')} AS cache_key, word AS text, moment, row_number() OVER (PARTITION BY {E._key('word')} ORDER BY moment, word) AS n
  FROM (SELECT split_part(text, ' ', 1) AS word, 1704067200 + (conv_id * 5 + turn) * 7200 AS moment FROM conversations WHERE role = 'user')),
used AS (
  SELECT cache_key, text, moment, n, moment AS made, true AS passed FROM asked WHERE n = 1
  UNION ALL
  SELECT a.cache_key, a.text, a.moment, a.n, CASE WHEN a.moment - made > 3600 THEN a.moment ELSE made END, a.moment - made >= 604800
  FROM used JOIN asked a ON a.cache_key = used.cache_key AND a.n = used.n + 1)
SELECT cache_key, text, make_timestamp(moment * 1000000)::TIMESTAMP AS ts FROM used WHERE passed""",
    "csv_scan": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, '' AS p_missing FROM part",
    "jsonl_last_line": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "jsonl_rows": "SELECT 'events' AS file, count(*) AS rows FROM events UNION ALL SELECT 'missing', 0::BIGINT",
    "image_cache_file": """
SELECT CAST(page_id AS VARCHAR) AS object_id, CASE WHEN url LIKE 'https://%' THEN url ELSE '' END AS "primaryImage", url AS title,
       url LIKE 'https://%' AS "hasImage" FROM pages""",
    "load_counts": """
SELECT count(*) FILTER (WHERE doc_id % 10 <> 0) AS documents, count(*) FILTER (WHERE doc_id % 10 <> 0) AS indexed,
       2 * count(*) FILTER (WHERE doc_id % 10 = 0) AS failed FROM documents""",
    "stored_items": "SELECT 'd_' || doc_id AS doc_id, source AS collection, lang, n_chars FROM documents WHERE doc_id % 10 <> 0",
    "stored_item": """
SELECT 'd_' || doc_id AS doc_id, source AS collection, CAST(len(embedding) AS INT) AS dims
FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id = 7""",
    "stored_vectors": """
SELECT model, count(*) AS "count" FROM embeddings CROSS JOIN (VALUES ('jina_v3'), ('siglip2')) m(model) GROUP BY model""",
    "knn_without_direction": f"""
WITH directed AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({R.cosine_sql('q.embedding', 'd.embedding')}, 6) AS score
  FROM directed q CROSS JOIN directed d)
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored)
WHERE rank <= 5""",
    "describe_job": """
SELECT page_id AS artwork_id, CASE WHEN url LIKE 'https://%' THEN 'processed' ELSE 'failed' END AS status,
       false AS has_violations, 5::INT AS alt_text_words, 'stand-in' AS model FROM pages""",
    "embed_missing": f"""
WITH {E._LOG}, {E._CACHE}
SELECT DISTINCT k AS cache_key, 16::INT AS text_dims, 24::INT AS image_dims FROM (SELECT {E._key('text')} AS k FROM log)
WHERE k NOT IN (SELECT cache_key FROM live)""",
}
