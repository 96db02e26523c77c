"""The queries of this subpackage over the shared test tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import bpe, dominance, langid, line_chunks, packing, phrases, quality, runs, simhash, stream_dedup, url_filter, winnow, wordpiece

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trained(id_col: str = "doc_id"):
    """True for the rows that models may learn from."""
    return ~held_out(id_col)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels").where(trained()))
    scored = quality.score(documents, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.compare_edited(table(spark, sf_dir, "documents"))
    digest = lambda marks: F.md5(F.concat_ws(",", F.col(marks).cast("array<string>")).cast("binary"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("marks").alias("fingerprint"),
        digest("edited_marks").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_chunks.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "removed_lines", "text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.where(trained()))
    named = langid.identify(documents, model, keep=["doc_id"])
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(BYTE_VOCABULARY, encoding="utf-8") as file:
        pieces = bpe.BpeModel(file.read()).pieces
    return wordpiece.count_pieces(table(spark, sf_dir, "documents"), pieces, keep=["doc_id"])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_dedup.duplicates(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _with_planted_runs(documents: DataFrame) -> DataFrame:
    """The documents' texts; in those that their id's CRC-32 chooses, words from a chosen one on repeat with a chosen period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    chosen = chosen.select("doc_id", "text", "words", n.alias("n"), g.alias("g"), F.when(n > 0, g % F.greatest(n, F.lit(1))).cast("long").alias("a"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    first, rest = F.col("a").cast("int"), (F.col("n") - F.col("a")).cast("int")
    turns = F.ceil(rest / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", first + 1, period), turns)), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), first), tail), " ")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_runs(_with_planted_runs(table(spark, sf_dir, "documents")), keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", longest.alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = dominance.pack_whole(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_url_filter": op2_url_filter,
    "op3_winnowing": op3_winnowing,
    "op4_simhash": op4_simhash,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_language": op8_language,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_phrases": op13_phrases,
}
ORACLE: dict[str, str] = {
    "op10_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY low)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(low) AS text_sha256
FROM t JOIN g USING (low)""",
    "op13_phrases": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
), f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 10
), total AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1
), cuts AS (
  SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, ws FROM c
), rated AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, x.n AS l, y.n AS r, (1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')
), least AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase) WHERE NOT (k = 2 AND coalesce(100 * most >= 50 * a, false))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n AS n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""",
}
