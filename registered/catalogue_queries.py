"""Raw catalogue rows, built from the tables, normalised and composed to text."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered import tables as R
from registered import text_queries as X
from vitrine.schemas import SOURCE1_CSV, SOURCE2_CSV
from vitrine.sources import normalize as N

# Raw column -> expression over part joined with supplier, nation and region.
FIRST = {
    "Object ID": "CAST(p_partkey AS STRING)",
    "Object Number": "p_brand || '.' || CAST(p_size AS STRING)",
    "Is Highlight": "CASE WHEN p_size = 1 THEN 'TRUE' ELSE 'False' END",
    "Is Timeline Work": "CASE WHEN p_size = 2 THEN 'True' ELSE '' END",
    "Is Public Domain": "CASE WHEN p_size <= 40 THEN 'True' ELSE 'False' END",
    "Gallery Number": "CASE WHEN p_size > 25 THEN CAST(p_size AS STRING) ELSE ' ' END",
    "Department": "r_name",
    "AccessionYear": "CAST(1900 + p_size AS STRING) || '-x'",
    "Object Name": "'Painting'",
    "Title": "CASE WHEN p_size = 7 THEN '' ELSE p_name END",
    "Culture": "n_name",
    "Period": "CASE WHEN p_size > 30 THEN 'late' ELSE '' END",
    "Dynasty": "''",
    "Reign": "CASE WHEN p_size > 45 THEN 'long' ELSE '' END",
    "Artist Display Name": "CASE WHEN p_size = 9 THEN '' ELSE s_name END",
    "Artist Display Bio": "n_name || ', born ' || CAST(1800 + p_size AS STRING)",
    "Artist Role": "'Maker'",
    "Artist Nationality": "n_name",
    "Artist Begin Date": "CAST(1800 + p_size AS STRING) || '  '",
    "Artist End Date": "CASE WHEN p_size > 20 THEN '9999' ELSE '' END",
    "Artist Gender": "''",
    "Object Date": "CASE p_size % 4 WHEN 0 THEN 'ca. ' || CAST(1850 + p_size AS STRING) WHEN 1 THEN CAST(1850 + p_size AS STRING) || '–1960' "
    "WHEN 2 THEN 'undated' ELSE '' END",
    "Medium": "'Oil on ' || p_name",
    "Dimensions": "CAST(p_size AS STRING) || '  x  12 in. (3′ 4″)'",
    "Credit Line": "'Gift of ' || s_name",
    "City": "CASE WHEN p_size > 10 THEN 'City ' || CAST(p_size AS STRING) ELSE '' END",
    "Country": "n_name",
    "Region": "r_name",
    "Classification": "CASE p_type WHEN 'PROMO' THEN 'Prints' WHEN 'SMALL' THEN 'PAINTINGS' ELSE 'Paintings' END",
    "Link Resource": "CASE WHEN p_size = 3 THEN ' ' ELSE 'http://example.org/' || CAST(p_partkey AS STRING) END",
    "Tags": "p_name || '| ' || p_type || '||'",
}
SECOND = {
    "ObjectID": "CAST(p_partkey AS STRING)",
    "Title": "CASE WHEN p_size = 7 THEN '' ELSE p_name END",
    "Artist": "CASE WHEN p_size = 9 THEN '' ELSE s_name END",
    "ConstituentID": "CAST(s_suppkey AS STRING)",
    "ArtistBio": "n_name || ', ' || CAST(1900 + p_size AS STRING)",
    "Nationality": "n_name",
    "BeginDate": "CASE p_size % 3 WHEN 0 THEN '-' || CAST(1900 + p_size AS STRING) WHEN 1 THEN '(' || CAST(1900 + p_size AS STRING) || ')' ELSE '0' END",
    "EndDate": "CASE WHEN p_size > 20 THEN '2000' ELSE '' END",
    "Gender": "'Other'",
    "Date": "CAST(1900 + p_size AS STRING) || '-' || CAST(1910 + p_size AS STRING)",
    "Medium": "p_type || ' print'",
    "Dimensions": "CAST(p_size AS STRING) || '″  x 4″'",
    "CreditLine": "'Gift of ' || s_name",
    "AccessionNumber": "p_brand",
    "Classification": "p_type",
    "Department": "r_name",
    "DateAcquired": "'2001-01-01'",
    "Cataloged": "CASE WHEN p_size > 5 THEN 'Y' ELSE 'N' END",
    "URL": "CASE WHEN p_size = 4 THEN '' ELSE 'http://example.org/' || CAST(p_partkey AS STRING) END",
    "ImageURL": "CASE WHEN p_size = 3 THEN ' ' ELSE 'http://example.org/i/1024x1024/' || CAST(p_partkey AS STRING) || '/1024x1024.jpg' END",
    "OnView": "CASE p_size % 4 WHEN 0 THEN 'Y' WHEN 1 THEN '1' WHEN 2 THEN 'true' ELSE 'y' END",
    "Height (cm)": "CAST(p_size AS STRING) || '.5'",
    "Width (cm)": "CAST(p_retailprice AS STRING)",
    "Depth (cm)": "CASE WHEN p_size > 30 THEN '1.25 approx' ELSE '' END",
}


def _rows(spark, sf_dir):
    part = R.table(spark, sf_dir, "part")
    supplier = R.table(spark, sf_dir, "supplier")
    nation = R.table(spark, sf_dir, "nation")
    region = R.table(spark, sf_dir, "region")
    makers = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    # A part's maker has the number of its size.
    return part.join(makers, F.col("p_size") - 1 == F.col("s_suppkey"), "left").na.fill(
        {"s_name": "", "n_name": "", "r_name": "", "s_suppkey": -1}
    )


def _raw(spark, sf_dir, schema, columns):
    rows = _rows(spark, sf_dir)
    return rows.select(*[F.expr(columns.get(n, "''")).alias(n) for n in schema.names])


def _cache(spark, sf_dir):
    """Pages as fetched image records by number; some have no small image, some none at all."""
    return R.table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("object_id"),
        F.when(F.pmod("page_id", F.lit(5)) == 0, "").otherwise(F.col("url")).alias("primaryImage"),
        F.when(F.pmod("page_id", F.lit(3)) == 0, "").otherwise(F.concat("url", F.lit("/small"))).alias("primaryImageSmall"),
        (F.pmod("page_id", F.lit(5)) != 0).alias("hasImage"),
    )


_SHOWN = (
    "title artist date medium dimensions creditLine collection collectionId sourceUrl department classification culture period "
    "artistBio artistNationality artistBeginDate artistEndDate dateBegin dateEnd isHighlight isPublicDomain onView"
).split()


def _flat(items, extra, more=()):
    return items.select(
        "doc_id",
        *[F.col(f"metadata.{c}").alias(c) for c in [*_SHOWN, *more]],
        *[F.col("metadata.additionalData")[c].alias(c) for c in extra],
        F.col("image.url").alias("url"),
        F.col("image.thumbnailUrl").alias("thumbnail"),
    )


def normalize_first(spark, sf_dir):
    items = N.normalize_source1(_raw(spark, sf_dir, SOURCE1_CSV, FIRST), _cache(spark, sf_dir))
    return _flat(items, ["objectNumber", "accessionYear", "isTimelineWork", "tags", "reign", "city"])


def normalize_second(spark, sf_dir):
    items = N.normalize_source2(_raw(spark, sf_dir, SOURCE2_CSV, SECOND))
    sizes = ["width", "height", "depth", "diameter"]
    flat = _flat(items, ["accessionNumber", "cataloged", "dateAcquired"], sizes)
    return flat.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in sizes})


def limit_before_images(spark, sf_dir):
    """A scan limit of the first source counts rows that turn out to have no image."""
    raw = _raw(spark, sf_dir, SOURCE1_CSV, FIRST)
    return N.normalize_source1(raw, _cache(spark, sf_dir), limit=60).select("doc_id")


def limit_after_images(spark, sf_dir):
    return N.normalize_source2(_raw(spark, sf_dir, SOURCE2_CSV, SECOND), limit=60).select("doc_id")


def _descriptions(spark, sf_dir, collection):
    return R.table(spark, sf_dir, "documents").select(
        F.concat(F.lit(f"{collection}_"), F.col("doc_id").cast("string")).alias("artwork_id"),
        F.when(F.col("lang") == "de", "").otherwise(F.col("source")).alias("alt_text"),
        F.col("text").alias("long_description"),
    )


def _digested(texts):
    return texts.select("artwork_id", "title", "artist", "has_description", F.length("text").alias("length"), F.md5("text").alias("digest"))


def compose_first(spark, sf_dir):
    raw = N.eligible_source1(_raw(spark, sf_dir, SOURCE1_CSV, FIRST))
    return _digested(N.texts_to_embed(raw, "met", _descriptions(spark, sf_dir, "met"), N.SOURCE1_LABELS, "Object ID"))


def compose_second(spark, sf_dir):
    raw = _raw(spark, sf_dir, SOURCE2_CSV, SECOND)
    return _digested(N.texts_to_embed(raw, "moma", _descriptions(spark, sf_dir, "moma"), N.SOURCE2_LABELS, "ObjectID"))


def image_cache_summary(spark, sf_dir):
    """Cache entries, those with an image, and eligible rows by availability."""
    cache = _cache(spark, sf_dir)
    audited = N.eligible_source1(_raw(spark, sf_dir, SOURCE1_CSV, FIRST), need_link=False).select(F.col("Object ID").alias("object_id"))
    state = audited.join(cache, "object_id", "left")
    return state.agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count("hasImage").alias("cached"),
        F.count_if(F.coalesce("hasImage", F.lit(False))).alias("with_image"),
    )


QUERIES = {
    "normalize_first": normalize_first,
    "normalize_second": normalize_second,
    "limit_before_images": limit_before_images,
    "limit_after_images": limit_after_images,
    "compose_text": compose_first,
    "compose_text_second": compose_second,
    "image_cache_summary": image_cache_summary,
}


def _raw_sql(name: str, columns: dict[str, str]) -> str:
    listed = ", ".join(f'{X.sql_text(e)} AS "{n}"' for n, e in columns.items())
    return f"""
{name} AS (
  SELECT {listed}
  FROM (SELECT p.*, coalesce(s_name, '') AS s_name, coalesce(n_name, '') AS n_name, coalesce(r_name, '') AS r_name,
               coalesce(s_suppkey, -1) AS s_suppkey
        FROM part p LEFT JOIN (supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        ON p_size - 1 = s_suppkey))"""


_CACHE_SQL = """
image_cache AS (
  SELECT CAST(page_id AS VARCHAR) AS object_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS main,
         CASE WHEN page_id % 3 = 0 THEN '' ELSE url || '/small' END AS small, page_id % 5 <> 0 AS has_image FROM pages)"""
_ELIGIBLE = """lower("Classification") = 'paintings' AND lower("Is Public Domain") = 'true'"""
_LINKED = _ELIGIBLE + """ AND trim("Link Resource") <> ''"""
_B1, _E1 = X.years_sql('"Object Date"')
_B2, _E2 = X.years_sql('"Date"')


def _labelled(labels, extra) -> str:
    parts = [
        f"CASE WHEN v{i} <> '' THEN '{label}: ' || v{i} END" for i, label in enumerate([l for l, _ in labels] + [l for l, _ in extra])
    ]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '. ')"


def _compose_sql(raw: str, columns, labels, collection: str, key: str, artist: str, where: str) -> str:
    values = [X.join_tags_sql('"Tags"') if label == "Tags" else f'"{column}"' for label, column in labels]
    values += ["CASE WHEN lang = 'de' THEN '' ELSE source END", "text"]
    listed = ", ".join(f"{v} AS v{i}" for i, v in enumerate(values))
    return f"""
WITH {_raw_sql(raw, columns)},
valued AS (
  SELECT '{collection}_' || "{key}" AS artwork_id, "Title" AS title,
         CASE WHEN "{artist}" = '' THEN 'Unknown' ELSE "{artist}" END AS artist, doc_id IS NOT NULL AS has_description, {listed}
  FROM {raw} LEFT JOIN documents ON CAST(doc_id AS VARCHAR) = "{key}" {where})
SELECT artwork_id, title, artist, has_description, CAST(length(t) AS INT) AS length, md5(t) AS digest
FROM (SELECT *, {_labelled(labels, N.DESCRIPTION_LABELS)} AS t FROM valued)"""


ORACLE = {
    "normalize_first": f"""
WITH {_raw_sql('first_rows', FIRST)}, {_CACHE_SQL}
SELECT 'met_' || "Object ID" AS doc_id, CASE WHEN "Title" = '' THEN 'Untitled' ELSE "Title" END AS title,
       CASE WHEN "Artist Display Name" = '' THEN 'Unknown' ELSE "Artist Display Name" END AS artist, "Object Date" AS date,
       "Medium" AS medium, {X.clean_dimensions_sql('"Dimensions"')} AS dimensions, "Credit Line" AS "creditLine", 'met' AS collection,
       "Object ID" AS "collectionId", "Link Resource" AS "sourceUrl", "Department" AS department, "Classification" AS classification,
       "Culture" AS culture, "Period" AS period, "Artist Display Bio" AS "artistBio", "Artist Nationality" AS "artistNationality",
       {X.prefix_int_sql('"Artist Begin Date"')} AS "artistBeginDate", {X.prefix_int_sql('"Artist End Date"')} AS "artistEndDate",
       {_B1} AS "dateBegin", {_E1} AS "dateEnd", lower("Is Highlight") = 'true' AS "isHighlight", true AS "isPublicDomain",
       trim("Gallery Number") <> '' AS "onView", "Object Number" AS "objectNumber",
       CAST({X.prefix_int_sql('"AccessionYear"')} AS VARCHAR) AS "accessionYear", CAST("Is Timeline Work" = 'True' AS VARCHAR) AS "isTimelineWork",
       {X.join_tags_sql('"Tags"')} AS tags, "Reign" AS reign, "City" AS city,
       CASE WHEN small = '' THEN main ELSE small END AS url, CASE WHEN small = '' THEN main ELSE small END AS thumbnail
FROM first_rows JOIN image_cache ON object_id = "Object ID" WHERE has_image AND {_LINKED}""",
    "normalize_second": f"""
WITH {_raw_sql('second_rows', SECOND)}
SELECT 'moma_' || "ObjectID" AS doc_id, CASE WHEN "Title" = '' THEN 'Untitled' ELSE "Title" END AS title,
       CASE WHEN "Artist" = '' THEN 'Unknown' ELSE "Artist" END AS artist, "Date" AS date, "Medium" AS medium,
       {X.clean_dimensions_sql('"Dimensions"')} AS dimensions, "CreditLine" AS "creditLine", 'moma' AS collection,
       "ObjectID" AS "collectionId", CASE WHEN "URL" = '' THEN 'https://www.moma.org/collection/works/' || "ObjectID" ELSE "URL" END AS "sourceUrl",
       "Department" AS department, "Classification" AS classification, CAST(NULL AS VARCHAR) AS culture, CAST(NULL AS VARCHAR) AS period,
       "ArtistBio" AS "artistBio", "Nationality" AS "artistNationality", abs({X.prefix_int_sql('"BeginDate"')}) AS "artistBeginDate",
       abs({X.prefix_int_sql('"EndDate"')}) AS "artistEndDate", {_B2} AS "dateBegin", {_E2} AS "dateEnd", false AS "isHighlight",
       true AS "isPublicDomain", "OnView" IN ('Y', '1', 'true') AS "onView",
       round(CAST(CAST({X.prefix_float_sql('"Width (cm)"')} AS FLOAT) AS DOUBLE), 4) AS width,
       round(CAST(CAST({X.prefix_float_sql('"Height (cm)"')} AS FLOAT) AS DOUBLE), 4) AS height,
       round(CAST(CAST({X.prefix_float_sql('"Depth (cm)"')} AS FLOAT) AS DOUBLE), 4) AS depth, CAST(NULL AS DOUBLE) AS diameter,
       "AccessionNumber" AS "accessionNumber", CAST("Cataloged" = 'Y' AS VARCHAR) AS cataloged, "DateAcquired" AS "dateAcquired",
       "ImageURL" AS url, regexp_replace("ImageURL", '1024x1024', '400x400') AS thumbnail
FROM second_rows WHERE trim("ImageURL") <> ''""",
    "limit_before_images": f"""
WITH {_raw_sql('first_rows', FIRST)}, {_CACHE_SQL}
SELECT 'met_' || "Object ID" AS doc_id
FROM (SELECT * FROM first_rows WHERE {_LINKED} ORDER BY CAST("Object ID" AS BIGINT) LIMIT 60) JOIN image_cache ON object_id = "Object ID"
WHERE has_image""",
    "limit_after_images": f"""
WITH {_raw_sql('second_rows', SECOND)}
SELECT 'moma_' || "ObjectID" AS doc_id FROM second_rows WHERE trim("ImageURL") <> '' ORDER BY CAST("ObjectID" AS BIGINT) LIMIT 60""",
    "compose_text": _compose_sql("first_rows", FIRST, [(l, c) for l, c in N.SOURCE1_LABELS], "met", "Object ID", "Artist Display Name", f"WHERE {_LINKED}"),
    "compose_text_second": _compose_sql("second_rows", SECOND, N.SOURCE2_LABELS, "moma", "ObjectID", "Artist", ""),
    "image_cache_summary": f"""
WITH {_raw_sql('first_rows', FIRST)}, {_CACHE_SQL}
SELECT count(*) AS eligible, count(has_image) AS cached, count(*) FILTER (WHERE has_image) AS with_image
FROM first_rows LEFT JOIN image_cache ON object_id = "Object ID" WHERE {_ELIGIBLE}""",
}
