"""Scalar text functions over strings built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered import tables as R
from vitrine.functions import quality
from vitrine.functions import text as T
from vitrine.plans.jobs import checked_descriptions

_DATES = """
CASE o_orderkey % 7 WHEN 0 THEN y || '-' || CAST(o_custkey % 9000 + 1000 AS STRING) WHEN 1 THEN 'ca. ' || y || '–' || y
  WHEN 2 THEN y WHEN 3 THEN 'ca. ' || y WHEN 4 THEN y || '-97' WHEN 5 THEN CAST(o_orderkey AS STRING) || 'th century' ELSE '' END"""
_DATES_SQL = _DATES.replace("STRING", "VARCHAR")


def extract_year(spark, sf_dir):
    orders = R.table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate").cast("string"))
    dated = orders.select("o_orderkey", F.expr(_DATES).alias("date"))
    begin, end = T.extract_years(F.col("date"))
    return dated.select("o_orderkey", "date", begin.alias("year_begin"), end.alias("year_end"))


_SIZES = "'  ' || CAST(p_size AS STRING) || '  x ' || CAST(p_partkey AS STRING) || '.5″  (' || p_name || '′)\t '"


def clean_dimensions(spark, sf_dir):
    part = R.table(spark, sf_dir, "part").select("p_partkey", F.expr(_SIZES).alias("raw"))
    return part.select("p_partkey", T.clean_dimensions(F.col("raw")).alias("clean"))


_MEASURES = (
    "CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) || '.25 x ' || CAST(p_partkey AS STRING) || ' cm' "
    "WHEN 1 THEN CAST(p_size AS STRING) || ' × ' || CAST(p_partkey AS STRING) || ' x 3.5 in' "
    "ELSE 'Diameter: ' || CAST(p_size AS STRING) || '.5 cm' END"
)


def parse_dimensions(spark, sf_dir):
    part = R.table(spark, sf_dir, "part").select("p_partkey", F.expr(_MEASURES).alias("raw"))
    return part.select("p_partkey", T.parse_dimensions(F.col("raw")).alias("d")).select("p_partkey", "d.*")


_TAGS = "p_name || '| ' || p_type || ' || | ' || p_brand || '|'"


def split_tags(spark, sf_dir):
    part = R.table(spark, sf_dir, "part").select("p_partkey", F.expr(_TAGS).alias("raw"))
    return part.select("p_partkey", T.join_tags(F.col("raw")).alias("tags"))


_NUMBERS = (
    "CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS STRING) || '.75 cm' WHEN 1 THEN '(' || CAST(p_size AS STRING) || ')' "
    "WHEN 2 THEN '-' || CAST(p_partkey AS STRING) WHEN 3 THEN ' ' || CAST(p_partkey AS STRING) || 'th' "
    "WHEN 4 THEN '.5e1' ELSE p_brand END"
)


def prefix_numbers(spark, sf_dir):
    part = R.table(spark, sf_dir, "part").select("p_partkey", F.expr(_NUMBERS).alias("raw"))
    return part.select(
        "p_partkey",
        T.prefix_int(F.col("raw")).alias("whole"),
        F.abs(T.prefix_int(F.col("raw"))).alias("unsigned"),
        T.prefix_float(F.col("raw")).alias("decimal"),
    )


def first_replace(spark, sf_dir):
    """Thumbnail of a URL that holds the size once, twice or not at all."""
    urls = R.table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.col("url"), F.expr("repeat('/1024x1024', CAST(page_id % 3 AS INT))")).alias("url")
    )
    return urls.select("page_id", T.thumbnail_url(F.col("url")).alias("thumbnail"))


_EMOJI = (
    "CASE event_type WHEN 'view' THEN '⛰️, 🌊 ' WHEN 'click' THEN '🧔‍♂️2' WHEN 'purchase' THEN '🇫🇷,👍🏽' "
    "WHEN 'error' THEN '1️⃣ x ☠️' ELSE 'no ' END || CAST(user_id AS STRING)"
)


def emoji_tokens(spark, sf_dir):
    """Emoji code points, whole emoji, and whether people or faces are shown."""
    events = R.table(spark, sf_dir, "events").select("event_id", F.expr(_EMOJI).alias("raw"))
    return events.select(
        "event_id",
        F.array_join(T.emoji_points(F.col("raw")), " ").alias("points"),
        T.normalize_emoji_summary(F.col("raw")).alias("summary"),
        quality.shows_people(F.col("raw")).alias("people"),
        T.is_emoji_only(F.col("raw")).alias("emoji_only"),
    )


def leak_check(spark, sf_dir):
    docs = R.documents(spark, sf_dir)
    found = quality.leaks(F.col("text"))
    return docs.select("doc_id", F.array_join(found, "|").alias("violations"), (F.size(found) > 0).alias("has_violations"))


def word_count_check(spark, sf_dir):
    turns = R.table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id",
        "turn",
        quality.word_count(F.col("text")).alias("words"),
        quality.has_expected_length(F.col("text")).alias("length_ok"),
    )


def description_check(spark, sf_dir):
    """Passages as alt texts next to the document of the same number."""
    alt = R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("artwork_id"), F.col("text").alias("alt_text"))
    raw = R.documents(spark, sf_dir).select(
        F.col("doc_id").alias("artwork_id"), F.col("text").alias("long_description"), F.concat(F.lit("🌊, "), "source").alias("emoji_summary")
    ).join(alt, "artwork_id", "left")
    return checked_descriptions(raw).select(
        "artwork_id",
        "status",
        F.array_join("violations", "|").alias("violations"),
        "has_violations",
        "alt_text_words",
        "emoji_summary",
    )


def word_tokens(spark, sf_dir):
    """Word count and distinct words of every document."""
    docs = R.documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return docs.select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).alias("n_distinct"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


QUERIES = {
    "extract_year": extract_year,
    "clean_dimensions": clean_dimensions,
    "parse_dimensions": parse_dimensions,
    "split_tags": split_tags,
    "prefix_numbers": prefix_numbers,
    "first_replace": first_replace,
    "emoji_tokens": emoji_tokens,
    "leak_check": leak_check,
    "word_count_check": word_count_check,
    "description_check": description_check,
    "word_tokens": word_tokens,
}

# White space in the SQL engine's dialect.
SPACE_SQL = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_text(expression: str) -> str:
    return expression.replace("STRING", "VARCHAR")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def leaks_sql(column: str) -> str:
    found = ", ".join(f"regexp_extract({column}, '(?i)\\b{p}\\b')" for p in quality.LEAK_PATTERNS)
    return f"list_filter([{found}], lambda x: x <> '')"


def trim_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def words_sql(column: str) -> str:
    return f"CAST(len(regexp_split_to_array({column}, '{SPACE_SQL}+')) AS INT)"


def years_sql(column: str) -> tuple[str, str]:
    span = r"(\d{4})[–-](\d{4})"
    pieces = [
        f"TRY_CAST(CASE WHEN regexp_matches({column}, '{span}') THEN regexp_extract({column}, '{span}', {g}) "
        f"ELSE regexp_extract({column}, '\\d{{4}}') END AS INT)"
        for g in (1, 2)
    ]
    return pieces[0], pieces[1]


def clean_dimensions_sql(column: str) -> str:
    return f"trim(translate(regexp_replace({column}, '{SPACE_SQL}+', ' ', 'g'), '″′', '\"'''))"


def join_tags_sql(column: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split({column}, '|'), "
        f"lambda t: {trim_sql('t')}), lambda t: t <> ''), ', ')"
    )


def prefix_int_sql(column: str) -> str:
    return f"TRY_CAST(regexp_extract({column}, '^{SPACE_SQL}*([-+]?\\d+)', 1) AS INT)"


def prefix_float_sql(column: str) -> str:
    return f"TRY_CAST(regexp_extract({column}, '^{SPACE_SQL}*([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)', 1) AS DOUBLE)"


def emoji_summary_sql(column: str) -> str:
    packed = f"regexp_replace({column}, ',|{SPACE_SQL}', '', 'g')"
    return f"array_to_string(regexp_extract_all({packed}, '{_quoted(T.emoji_sequence())}'), '')"


_BY = rf"{SPACE_SQL}*[x×]{SPACE_SQL}*"
_NUMBER = r"(\d+(?:\.\d+)?)"
_HWD = rf"{_NUMBER}{_BY}{_NUMBER}{SPACE_SQL}*(?:[x×]{SPACE_SQL}*{_NUMBER})?"
_BEGIN, _END = years_sql("date")
_PEOPLE = "|".join([*quality.PERSON_EMOJI, *quality.FACE_EMOJI])


ORACLE = {
    "extract_year": f"""
SELECT o_orderkey, date, {_BEGIN} AS year_begin, {_END} AS year_end
FROM (SELECT o_orderkey, {_DATES_SQL} AS date FROM (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders))""",
    "clean_dimensions": f"SELECT p_partkey, {clean_dimensions_sql('raw')} AS clean FROM (SELECT p_partkey, {sql_text(_SIZES)} AS raw FROM part)",
    "parse_dimensions": "SELECT p_partkey, "
    + ", ".join(
        f"TRY_CAST(regexp_extract(raw, '{pattern}', {group}) AS DOUBLE) AS {name}"
        for name, pattern, group in (
            ("height", _HWD, 1),
            ("width", _HWD, 2),
            ("depth", _HWD, 3),
            ("diameter", rf"(?i)diameter(?::|{SPACE_SQL})+{_NUMBER}", 1),
        )
    )
    + f" FROM (SELECT p_partkey, {sql_text(_MEASURES)} AS raw FROM part)",
    "split_tags": f"SELECT p_partkey, {join_tags_sql('raw')} AS tags FROM (SELECT p_partkey, {_TAGS} AS raw FROM part)",
    "prefix_numbers": f"""
SELECT p_partkey, {prefix_int_sql('raw')} AS whole, abs({prefix_int_sql('raw')}) AS unsigned, {prefix_float_sql('raw')} AS "decimal"
FROM (SELECT p_partkey, {sql_text(_NUMBERS)} AS raw FROM part)""",
    "first_replace": """
SELECT page_id, regexp_replace(url || repeat('/1024x1024', CAST(page_id % 3 AS INT)), '1024x1024', '400x400') AS thumbnail FROM pages""",
    "emoji_tokens": f"""
SELECT event_id, array_to_string(regexp_extract_all(raw, '{T.emoji_class()}'), ' ') AS points,
       {emoji_summary_sql('raw')} AS summary, regexp_matches(raw, '{_PEOPLE}') AS people,
       regexp_matches(raw, '{T.emoji_class()}') AND {trim_sql(f"regexp_replace(raw, '{T.emoji_class()}', '', 'g')")} = '' AS emoji_only
FROM (SELECT event_id, {sql_text(_EMOJI)} AS raw FROM events)""",
    "leak_check": f"""
SELECT doc_id, array_to_string(v, '|') AS violations, len(v) > 0 AS has_violations
FROM (SELECT doc_id, {leaks_sql('text')} AS v FROM documents)""",
    "word_count_check": f"""
SELECT conv_id, turn, {words_sql('text')} AS words, {words_sql('text')} BETWEEN 10 AND 20 AS length_ok FROM conversations""",
    "description_check": f"""
SELECT artwork_id, CASE WHEN alt <> '' AND long <> '' THEN 'processed' ELSE 'failed' END AS status,
       array_to_string(v, '|') AS violations, len(v) > 0 AS has_violations, words AS alt_text_words, {emoji_summary_sql('emoji')} AS emoji_summary
FROM (SELECT doc_id AS artwork_id, b.text AS alt, d.text AS long, '🌊, ' || source AS emoji, {words_sql('b.text')} AS words,
             list_concat({leaks_sql('b.text')}, {leaks_sql('d.text')}) AS v
      FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id)""",
    "word_tokens": f"""
SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {R.tokens_sql('text')} AS t FROM documents)""",
}
