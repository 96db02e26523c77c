"""Raw catalogue rows to the unified item: filters, defaults and typed metadata."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import constants as C
from vitrine.functions import text as T
from vitrine.schemas import METADATA

# Unified field -> raw column, for plain strings that default to empty.
SOURCE1_STRINGS = {
    "date": "Object Date",
    "medium": "Medium",
    "creditLine": "Credit Line",
    "department": "Department",
    "classification": "Classification",
    "culture": "Culture",
    "period": "Period",
    "dynasty": "Dynasty",
    "artistBio": "Artist Display Bio",
    "artistNationality": "Artist Nationality",
    "artistGender": "Artist Gender",
}
SOURCE1_EXTRA = {
    "objectNumber": "Object Number",
    "objectName": "Object Name",
    "galleryNumber": "Gallery Number",
    "artistULAN": "Artist ULAN URL",
    "artistWikidata": "Artist Wikidata URL",
    "objectWikidata": "Object Wikidata URL",
    "rightsAndReproduction": "Rights and Reproduction",
    "reign": "Reign",
    "portfolio": "Portfolio",
    "artistRole": "Artist Role",
    "city": "City",
    "state": "State",
    "county": "County",
    "country": "Country",
    "region": "Region",
    "subregion": "Subregion",
    "locale": "Locale",
}
SOURCE2_STRINGS = {
    "date": "Date",
    "medium": "Medium",
    "creditLine": "CreditLine",
    "department": "Department",
    "classification": "Classification",
    "artistBio": "ArtistBio",
    "artistNationality": "Nationality",
    "artistGender": "Gender",
}
SOURCE2_EXTRA = {
    "accessionNumber": "AccessionNumber",
    "dateAcquired": "DateAcquired",
    "constituentId": "ConstituentID",
}
SOURCE2_SIZES = {
    "width": "Width (cm)",
    "height": "Height (cm)",
    "depth": "Depth (cm)",
    "diameter": "Diameter (cm)",
    "weight": "Weight (kg)",
}


def _raw(name: str) -> Column:
    return F.col(f"`{name}`")


def _strings(mapping: Mapping[str, str]) -> dict[str, Column]:
    return {field: T.or_default(_raw(column), "") for field, column in mapping.items()}


def _extra(mapping: Mapping[str, str], **more: Column) -> Column:
    values = {**{key: _raw(column) for key, column in mapping.items()}, **more}
    return F.create_map(*[x for key, value in values.items() for x in (F.lit(key), value.cast("string"))])


def _metadata(values: Mapping[str, Column]) -> Column:
    """Struct of the unified metadata, NULL for fields a source does not have."""
    fields = []
    for name, kind in (part.strip().split(" ", 1) for part in METADATA.replace("map<string, string>", "map<string;string>").split(",")):
        value = values.get(name, F.lit(None))
        fields.append(value.cast(kind.replace(";", ",")).alias(name))
    return F.struct(*fields)


def eligible_source1(raw: DataFrame, need_link: bool = True) -> DataFrame:
    """Public-domain paintings, with a link unless only availability is audited."""
    rows = raw.where((F.lower(_raw("Classification")) == "paintings") & T.is_true(_raw("Is Public Domain")))
    return rows.where(~T.is_blank(_raw("Link Resource"))) if need_link else rows


def with_cached_image(rows: DataFrame, cache: DataFrame, key: str = "Object ID") -> DataFrame:
    """Inner join with the image cache; the small rendition is preferred."""
    images = cache.where(F.col("hasImage") & (F.col("primaryImage") != "")).select(
        F.col("object_id").alias("_image_key"),
        F.coalesce(F.nullif("primaryImageSmall", F.lit("")), "primaryImage").alias("image_url"),
    )
    return rows.join(images, _raw(key) == F.col("_image_key")).drop("_image_key")


def normalize_source1(raw: DataFrame, image_cache: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of the first catalogue.  A limit counts rows before the image filter."""
    rows = eligible_source1(raw)
    if limit:
        rows = rows.orderBy(_raw("Object ID").try_cast("long"), _raw("Object ID")).limit(limit)
    rows = with_cached_image(rows, image_cache)
    begin, end = T.extract_years(_raw("Object Date"))
    key = _raw("Object ID")
    accession = T.prefix_int(_raw("AccessionYear"))
    metadata = _metadata(
        {
            **_strings(SOURCE1_STRINGS),
            "id": T.namespaced_id("met", key),
            "title": T.or_default(_raw("Title"), C.UNTITLED),
            "artist": T.or_default(_raw("Artist Display Name"), C.UNKNOWN_ARTIST),
            "dimensions": T.clean_dimensions(T.or_default(_raw("Dimensions"), "")),
            "collection": F.lit("met"),
            "collectionId": key,
            "sourceUrl": T.or_default(
                _raw("Link Resource"), F.concat(F.lit("https://www.metmuseum.org/art/collection/search/"), key)
            ),
            "artistBeginDate": T.prefix_int(_raw("Artist Begin Date")),
            "artistEndDate": T.prefix_int(_raw("Artist End Date")),
            "dateBegin": begin,
            "dateEnd": end,
            "isHighlight": T.is_true(_raw("Is Highlight")),
            "isPublicDomain": T.is_true(_raw("Is Public Domain")),
            "onView": ~T.is_blank(_raw("Gallery Number")),
            "additionalData": _extra(
                SOURCE1_EXTRA,
                accessionYear=accession,
                isTimelineWork=T.is_true(_raw("Is Timeline Work")),
                tags=T.join_tags(_raw("Tags")),
            ),
        }
    )
    return _item(rows, metadata, F.col("image_url"), F.col("image_url"))


def normalize_source2(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of the second catalogue.  A limit counts rows after the image filter."""
    rows = raw.where(~T.is_blank(_raw("ImageURL")))
    if limit:
        rows = rows.orderBy(_raw("ObjectID").try_cast("long"), _raw("ObjectID")).limit(limit)
    begin, end = T.extract_years(_raw("Date"))
    key = _raw("ObjectID")
    metadata = _metadata(
        {
            **_strings(SOURCE2_STRINGS),
            **{field: T.prefix_float(_raw(column)) for field, column in SOURCE2_SIZES.items()},
            "id": T.namespaced_id("moma", key),
            "title": T.or_default(_raw("Title"), C.UNTITLED),
            "artist": T.or_default(_raw("Artist"), C.UNKNOWN_ARTIST),
            "dimensions": T.clean_dimensions(T.or_default(_raw("Dimensions"), "")),
            "collection": F.lit("moma"),
            "collectionId": key,
            "sourceUrl": T.or_default(_raw("URL"), F.concat(F.lit("https://www.moma.org/collection/works/"), key)),
            "artistBeginDate": F.abs(T.prefix_int(_raw("BeginDate"))),
            "artistEndDate": F.abs(T.prefix_int(_raw("EndDate"))),
            "dateBegin": begin,
            "dateEnd": end,
            "isHighlight": F.lit(False),
            "isPublicDomain": F.lit(True),
            "onView": F.coalesce(_raw("OnView").isin("Y", "1", "true"), F.lit(False)),
            "additionalData": _extra(SOURCE2_EXTRA, cataloged=F.coalesce(_raw("Cataloged") == "Y", F.lit(False))),
        }
    )
    return _item(rows, metadata, _raw("ImageURL"), T.thumbnail_url(_raw("ImageURL")))


def _item(rows: DataFrame, metadata: Column, url: Column, thumbnail: Column) -> DataFrame:
    return rows.select(
        metadata.alias("metadata"), F.struct(url.alias("url"), thumbnail.alias("thumbnailUrl")).alias("image")
    ).select(F.col("metadata.id").alias("doc_id"), "metadata", "image")


# Label -> raw column, in the order in which the text to embed names them.
# Label and column of each part of a text, in order.
SOURCE1_LABELS = (
    ("Title", "Title"),
    ("Artist", "Artist Display Name"),
    ("Date", "Object Date"),
    ("Medium", "Medium"),
    ("Type", "Classification"),
    ("Department", "Department"),
    ("Culture", "Culture"),
    ("Period", "Period"),
    ("Dynasty", "Dynasty"),
    ("Reign", "Reign"),
    ("Nationality", "Artist Nationality"),
    ("Artist bio", "Artist Display Bio"),
    ("Artist role", "Artist Role"),
    ("Country", "Country"),
    ("Region", "Region"),
    ("City", "City"),
    ("Dimensions", "Dimensions"),
    ("Credit", "Credit Line"),
    ("Tags", "Tags"),
)
SOURCE2_LABELS = (
    ("Title", "Title"),
    ("Artist", "Artist"),
    ("Date", "Date"),
    ("Medium", "Medium"),
    ("Type", "Classification"),
    ("Department", "Department"),
    ("Nationality", "Nationality"),
    ("Artist bio", "ArtistBio"),
    ("Dimensions", "Dimensions"),
    ("Credit", "CreditLine"),
)
DESCRIPTION_LABELS = (("Visual description", "alt_text"), ("Detailed description", "long_description"))


def compose_text(labels: tuple[tuple[str, str], ...]) -> Column:
    """Text to embed from a raw row left-joined with its description."""
    fields = [(label, T.join_tags(_raw(c)) if label == "Tags" else _raw(c)) for label, c in labels]
    return T.labelled_text(fields + [(label, F.col(c)) for label, c in DESCRIPTION_LABELS])


def texts_to_embed(raw: DataFrame, collection: str, descriptions: DataFrame, labels: tuple[tuple[str, str], ...], key: str) -> DataFrame:
    """``artwork_id, text, title, artist, has_description`` of every raw row."""
    described = descriptions.select("artwork_id", "alt_text", "long_description", F.lit(True).alias("has_description"))
    rows = raw.withColumn("artwork_id", T.namespaced_id(collection, _raw(key))).join(described, "artwork_id", "left")
    artist = dict(labels)["Artist"]
    return rows.select(
        "artwork_id",
        compose_text(labels).alias("text"),
        _raw("Title").alias("title"),
        T.or_default(_raw(artist), C.UNKNOWN_ARTIST).alias("artist"),
        F.coalesce("has_description", F.lit(False)).alias("has_description"),
    )


def image_from_any(image: Column) -> Column:
    """An image given as a bare URL becomes the image struct."""
    return F.struct(image.alias("url"), F.lit(None).cast("string").alias("thumbnailUrl"))
