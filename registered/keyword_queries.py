"""BM25 and fuzzy keyword queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registered import tables as R
from vitrine.operators.bm25 import keyword_search
from vitrine.operators.fuzzy import expand_terms
from vitrine.operators.terms import SearchField, TextIndex, wanted_terms
from vitrine.session import shared_dir


def bm25_topk(spark, sf_dir):
    queries = R.benchmark_queries(spark, sf_dir).select("query_id", "text")
    return keyword_search(queries, R.document_index(spark, sf_dir), 20, fuzzy=False, with_total=True)


def bm25_written_index(spark, sf_dir):
    """The same ranking over an index that was written once: only the postings of the wanted words are read."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    R.document_index(spark, sf_dir).write(path)
    index = TextIndex.read(spark, path, R.DOCUMENT_FIELDS)
    queries = R.benchmark_queries(spark, sf_dir).select("query_id", "text")
    return keyword_search(queries, index, 20, fuzzy=False, with_total=True)


def bm25_fuzzy_text(spark, sf_dir):
    """The search page's own keyword mode over whole texts: words near a query word count too."""
    queries = R.benchmark_queries(spark, sf_dir).select("query_id", "text")
    return keyword_search(queries, R.document_index(spark, sf_dir), 20, with_total=True)


def bm25_fuzzy_written(spark, sf_dir):
    """The same over a written index, whose keys of near words are read by bucket."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    R.document_index(spark, sf_dir).write(path)
    index = TextIndex.read(spark, path, R.DOCUMENT_FIELDS)
    queries = R.benchmark_queries(spark, sf_dir).select("query_id", "text")
    return keyword_search(queries, index, 20, with_total=True)


def _item_queries(spark, sf_dir):
    """Every distinct name, type and brand as a query."""
    part = R.table(spark, sf_dir, "part")
    texts = part.select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("text")).distinct()
    return texts.select(F.col("text").alias("query_id"), "text")


ENRICHED_FIELDS = [*R.ITEM_FIELDS, SearchField("visual_long_description", 0.5)]


def bm25_best_fields(spark, sf_dir):
    index = TextIndex.of(R.items(spark, sf_dir), R.ITEM_FIELDS)
    return keyword_search(_item_queries(spark, sf_dir), index, 20, fuzzy=False)


def bm25_fuzzy(spark, sf_dir):
    index = TextIndex.of(R.items(spark, sf_dir), R.ITEM_FIELDS)
    return keyword_search(_item_queries(spark, sf_dir), index, 20, fuzzy=True)


def bm25_with_descriptions(spark, sf_dir):
    """Names, brands and types next to a description that only some items have."""
    texts = R.documents(spark, sf_dir).select("doc_id", F.col("text").alias("visual_long_description"))
    corpus = R.items(spark, sf_dir).join(texts, "doc_id", "left")
    queries = _item_queries(spark, sf_dir).unionByName(
        R.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    )
    return keyword_search(queries, TextIndex.of(corpus, ENRICHED_FIELDS), 20, fuzzy=False)


def fuzzy_terms(spark, sf_dir):
    """Vocabulary words near every word of the item names and brands."""
    index = TextIndex.of(R.items(spark, sf_dir), R.ITEM_FIELDS)
    values = [(f, F.col("text")) for f in R.ITEM_FIELDS]
    wanted = wanted_terms(_item_queries(spark, sf_dir), values, "query_id").select("field", "query_term").distinct()
    return expand_terms(wanted, index.vocabulary).withColumn("similarity", F.round("similarity", 6))


def field_statistics(spark, sf_dir):
    """Documents and average length per field."""
    texts = R.documents(spark, sf_dir)
    index = TextIndex.of(texts, [SearchField("text"), SearchField("source", exact=True), SearchField("lang", exact=True)])
    words = index.vocabulary.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings")
    )
    return index.stats.withColumn("avg_length", F.round("avg_length", 6)).join(words, "field")


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_written_index": bm25_written_index,
    "bm25_fuzzy_text": bm25_fuzzy_text,
    "bm25_fuzzy_written": bm25_fuzzy_written,
    "bm25_best_fields": bm25_best_fields,
    "bm25_fuzzy": bm25_fuzzy,
    "bm25_with_descriptions": bm25_with_descriptions,
    "fuzzy_terms": fuzzy_terms,
    "field_statistics": field_statistics,
}

_ITEM_QUERIES_SQL = """
queries AS (
  SELECT DISTINCT t AS query_id, t AS text FROM (
    SELECT p_name AS t FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_brand FROM part))"""

BOOSTS_SQL = """
boosts(field, boost, exact) AS (
  VALUES ('title', 3.0::DOUBLE, false), ('artist', 2.0, false), ('classification', 1.5, true),
         ('department', 1.0, true), ('visual_long_description', 0.5, false), ('text', 1.0, false))"""


def corpus_terms_sql(fields: list[tuple[str, str, bool]], relation: str) -> str:
    parts = [
        f"SELECT doc_id, '{name}' AS field, {f'[{column}]' if exact else R.tokens_sql(column)} AS terms "
        f"FROM {relation} WHERE {column} IS NOT NULL"
        for name, column, exact in fields
    ]
    return "terms AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE len(terms) > 0)"


def query_terms_sql(fields: list[tuple[str, str, bool]]) -> str:
    parts = [
        f"SELECT query_id, '{name}' AS field, unnest({'[text]' if exact else R.tokens_sql('text')}) AS query_term FROM queries"
        for name, _, exact in fields
    ]
    return (
        "wanted AS (SELECT query_id, field, query_term, count(*) AS repeats FROM ("
        + " UNION ALL ".join(parts)
        + ") GROUP BY ALL)"
    )


# Word distance stays within AUTO; at most 50 words per query word; their largest df counts for all.
EXPAND_FUZZY_SQL = """
near AS (
  SELECT w.field, w.query_term, v.term, v.df,
         1 - damerau_levenshtein(w.query_term, v.term) / least(length(w.query_term), length(v.term)) AS similarity,
         CAST(damerau_levenshtein(w.query_term, v.term) AS INT) AS edits
  FROM (SELECT DISTINCT field, query_term FROM wanted) w JOIN vocabulary v ON w.field = v.field
  WHERE damerau_levenshtein(w.query_term, v.term)
        <= CASE WHEN length(w.query_term) < 3 THEN 0 WHEN length(w.query_term) < 6 THEN 1 ELSE 2 END),
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY field, query_term ORDER BY similarity DESC, term) AS n
    FROM near WHERE similarity > 0) WHERE n <= 50),
found AS (
  SELECT field, query_term, term, edits, similarity, max(df) OVER (PARTITION BY field, query_term) AS df FROM kept)"""

# The same for texts in several languages. The distance counts bytes, so the letters beyond ASCII that the tables hold
# become one byte each (words are in lower case). An edit changes at most two of a word's letters, so words whose
# sets of letters differ in more than twice the edits need not be compared. A swapped pair may not be edited again, which
# the function allows: two edits with a swap must be a swap and at most one edit before or after it.
_ONE_BYTE_SQL = "translate({}, 'ñêçíäéèöüóß', 'ABCDEFGHIJK')"
_SWAP_SQL = """
len(list_filter(flatten(list_transform(range(1, n), lambda i: [[i, i - 1], [i, i], [i, i + 1]])), lambda p:
  p[2] > 0 AND length(substr(b, p[2], 2)) = 2 AND substr(a, p[1], 2) = reverse(substr(b, p[2], 2))
  AND damerau_levenshtein(substr(a, 1, p[1] - 1), substr(b, 1, p[2] - 1)) + damerau_levenshtein(substr(a, p[1] + 2), substr(b, p[2] + 2)) <= 1)) > 0"""
EXPAND_FUZZY_TEXT_SQL = f"""
letters AS (
  SELECT *, length(one) AS n, CASE WHEN length(one) < 3 THEN 0 WHEN length(one) < 6 THEN 1 ELSE 2 END AS budget,
         CAST(list_reduce(list_transform(list_distinct(string_split(one, '')), lambda c: 1::BIGINT << (ascii(c) % 62)), lambda a, b: a | b) AS BIGINT) AS mask
  FROM (SELECT DISTINCT word, {_ONE_BYTE_SQL.format('word')} AS one
        FROM (SELECT query_term AS word FROM wanted UNION ALL SELECT term FROM vocabulary))),
near AS (
  SELECT field, query_term, term, df, 1 - edits / least(n, m) AS similarity, CAST(edits AS INT) AS edits
  FROM (
    SELECT w.field, w.query_term, v.term, v.df, q.n, q.budget, t.n AS m, damerau_levenshtein(q.one, t.one) AS edits, q.one AS a, t.one AS b
    FROM (SELECT DISTINCT field, query_term FROM wanted) w JOIN letters q ON q.word = w.query_term
    JOIN vocabulary v ON w.field = v.field JOIN letters t ON t.word = v.term
    WHERE abs(q.n - t.n) <= q.budget AND bit_count(xor(q.mask, t.mask)) <= 2 * q.budget)
  WHERE edits <= budget AND (edits < 2 OR levenshtein(a, b) <= 2 OR {_SWAP_SQL})),
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY field, query_term ORDER BY similarity DESC, term) AS n
    FROM near WHERE similarity > 0) WHERE n <= 50),
found AS (
  SELECT field, query_term, term, edits, similarity, max(df) OVER (PARTITION BY field, query_term) AS df FROM kept)"""

EXPAND_EXACT_SQL = """
found AS (SELECT field, term AS query_term, term, 0 AS edits, 1.0::DOUBLE AS similarity, df FROM vocabulary)"""

INDEX_SQL = """
postings AS (
  SELECT doc_id, field, term, dl, count(*) AS tf
  FROM (SELECT doc_id, field, len(terms) AS dl, unnest(terms) AS term FROM terms) GROUP BY ALL),
vocabulary AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
stats AS (SELECT field, count(*) AS n_docs, avg(len(terms)) AS avg_length FROM terms GROUP BY field)"""

MATCH_SQL = f"""
weights AS (
  SELECT query_id, field, term, avg_length, exact,
         sum(boost * {R.IDF_SQL} * similarity * repeats) AS weight
  FROM wanted JOIN found USING (field, query_term) JOIN stats USING (field) JOIN boosts USING (field)
  GROUP BY ALL),
matches AS (
  SELECT query_id, doc_id, round(max(field_score), 6) AS score FROM (
    SELECT query_id, doc_id, field,
           sum(weight * CASE WHEN exact THEN 1.0 ELSE {R.SATURATION_SQL} END) AS field_score
    FROM postings JOIN weights USING (field, term) GROUP BY ALL)
  GROUP BY ALL)"""

DOCUMENT_SQL_FIELDS = [("text", "text", False)]
ITEM_SQL_FIELDS = [
    ("title", "title", False),
    ("artist", "artist", False),
    ("classification", "classification", True),
    ("department", "department", True),
]


def keyword_sql(fields, relation: str, prelude: str, fuzzy: bool, expand: str = EXPAND_FUZZY_SQL) -> str:
    """All CTEs up to ``matches(query_id, doc_id, score)``."""
    return ",\n".join(
        [
            prelude,
            corpus_terms_sql(fields, relation),
            query_terms_sql(fields),
            INDEX_SQL,
            BOOSTS_SQL,
            expand if fuzzy else EXPAND_EXACT_SQL,
            MATCH_SQL,
        ]
    )


BENCHMARK_QUERIES_SQL = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"

_TOP_SQL = """
SELECT query_id, doc_id, score, rank{extra} FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank{count} FROM matches)
WHERE rank <= 20"""
_TOP = _TOP_SQL.format(extra="", count="")
_TOP_TOTAL = _TOP_SQL.format(extra=", total", count=", count(*) OVER (PARTITION BY query_id) AS total")

_ENRICHED_SQL = """
enriched AS (SELECT i.*, d.text AS visual_long_description FROM items i LEFT JOIN documents d USING (doc_id))"""
_ALL_QUERIES_SQL = """
queries AS (SELECT * FROM names UNION ALL SELECT CAST(item_id AS VARCHAR), text FROM benchmark)"""

_FUZZY_TEXT = "WITH " + keyword_sql(DOCUMENT_SQL_FIELDS, "documents", BENCHMARK_QUERIES_SQL, True, EXPAND_FUZZY_TEXT_SQL) + _TOP_TOTAL

ORACLE = {
    "bm25_fuzzy_text": _FUZZY_TEXT,
    "bm25_fuzzy_written": _FUZZY_TEXT,
    "bm25_topk": "WITH " + keyword_sql(DOCUMENT_SQL_FIELDS, "documents", BENCHMARK_QUERIES_SQL, False) + _TOP_TOTAL,
    "bm25_written_index": "WITH " + keyword_sql(DOCUMENT_SQL_FIELDS, "documents", BENCHMARK_QUERIES_SQL, False) + _TOP_TOTAL,
    "bm25_best_fields": "WITH " + keyword_sql(ITEM_SQL_FIELDS, "items", R.ITEMS_SQL + "," + _ITEM_QUERIES_SQL, False) + _TOP,
    "bm25_fuzzy": "WITH " + keyword_sql(ITEM_SQL_FIELDS, "items", R.ITEMS_SQL + "," + _ITEM_QUERIES_SQL, True) + _TOP,
    "bm25_with_descriptions": "WITH "
    + keyword_sql(
        [*ITEM_SQL_FIELDS, ("visual_long_description", "visual_long_description", False)],
        "enriched",
        ",".join([R.ITEMS_SQL, _ENRICHED_SQL, _ITEM_QUERIES_SQL.replace("queries AS", "names AS"), _ALL_QUERIES_SQL]),
        False,
    )
    + _TOP,
    "fuzzy_terms": "WITH "
    + ",\n".join(
        [
            R.ITEMS_SQL,
            _ITEM_QUERIES_SQL,
            corpus_terms_sql(ITEM_SQL_FIELDS, "items"),
            query_terms_sql(ITEM_SQL_FIELDS),
            INDEX_SQL,
            EXPAND_FUZZY_SQL,
        ]
    )
    + " SELECT field, query_term, term, edits, round(similarity, 6) AS similarity, df FROM found",
    "field_statistics": "WITH "
    + corpus_terms_sql([("text", "text", False), ("source", "source", True), ("lang", "lang", True)], "documents")
    + ","
    + INDEX_SQL
    + """
SELECT field, n_docs, round(avg_length, 6) AS avg_length, n_terms, n_postings
FROM stats JOIN (SELECT field, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings FROM vocabulary GROUP BY field) USING (field)""",
}
