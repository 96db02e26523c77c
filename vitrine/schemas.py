"""Typed schemas of the inputs and of the unified item, and the small registries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# Column names of the first catalogue file.
SOURCE1_CSV = _strings(
    "Object Number", "Is Highlight", "Is Timeline Work", "Is Public Domain", "Object ID", "Gallery Number",
    "Department", "AccessionYear", "Object Name", "Title", "Culture", "Period", "Dynasty", "Reign", "Portfolio",
    "Constituent ID", "Artist Role", "Artist Prefix", "Artist Display Name", "Artist Display Bio", "Artist Suffix",
    "Artist Alpha Sort", "Artist Nationality", "Artist Begin Date", "Artist End Date", "Artist Gender",
    "Artist ULAN URL", "Artist Wikidata URL", "Object Date", "Object Begin Date", "Object End Date", "Medium",
    "Dimensions", "Credit Line", "Geography Type", "City", "State", "County", "Country", "Region", "Subregion",
    "Locale", "Locus", "Excavation", "River", "Classification", "Rights and Reproduction", "Link Resource",
    "Object Wikidata URL", "Metadata Date", "Repository", "Tags", "Tags AAT URL", "Tags Wikidata URL",
)

# Column names of the second catalogue file.
SOURCE2_CSV = _strings(
    "Title", "Artist", "ConstituentID", "ArtistBio", "Nationality", "BeginDate", "EndDate", "Gender", "Date",
    "Medium", "Dimensions", "CreditLine", "AccessionNumber", "Classification", "Department", "DateAcquired",
    "Cataloged", "ObjectID", "URL", "ImageURL", "OnView", "Height (cm)", "Width (cm)", "Depth (cm)",
    "Diameter (cm)", "Weight (kg)", "Duration (sec.)",
)

_RECORD_META = "struct<title string, artist string, collection string, has_image boolean, has_description boolean>"

EMBEDDING_RECORD = (
    "artwork_id string, embedding array<float>, timestamp string, model string, dimension int, "
    f"metadata {_RECORD_META}"
)

DESCRIPTION_RECORD = (
    "artwork_id string, alt_text string, long_description string, emoji_summary string, has_violations boolean, "
    "violations array<string>, timestamp string, model string, "
    "metadata struct<title string, artist string, date string, medium string, collection string>"
)

IMAGE_CACHE_RECORD = (
    "object_id string, primaryImage string, primaryImageSmall string, title string, artistDisplayName string, "
    "objectDate string, hasImage boolean, fetched_at string"
)

METADATA = (
    "id string, title string, artist string, date string, medium string, dimensions string, creditLine string, "
    "collection string, collectionId string, sourceUrl string, department string, classification string, "
    "culture string, period string, dynasty string, artistBio string, artistNationality string, "
    "artistBeginDate int, artistEndDate int, artistGender string, dateBegin int, dateEnd int, width float, "
    "height float, depth float, diameter float, weight float, isHighlight boolean, isPublicDomain boolean, "
    "onView boolean, additionalData map<string, string>"
)

ITEM = f"doc_id string, metadata struct<{METADATA}>, image struct<url string, thumbnailUrl string>"

EMBEDDINGS = "doc_id string, model string, vec array<float>"

QUERY_CACHE = "cache_key string, jina_v3 array<float>, siglip2 array<float>, ts timestamp"


@dataclass(frozen=True)
class Collection:
    id: str
    display_name: str
    short_name: str
    website: str
    color: str


COLLECTIONS = {
    "moma": Collection("moma", "Museum of Modern Art", "MoMA", "https://www.moma.org", "#000000"),
    "met": Collection("met", "The Metropolitan Museum of Art", "The Met", "https://www.metmuseum.org", "#E4002B"),
}


@dataclass(frozen=True)
class EmbeddingModel:
    key: str
    name: str
    dimension: int
    supports_image: bool


EMBEDDING_MODELS = {
    "jina_v3": EmbeddingModel("jina_v3", "Text Embeddings", 768, False),
    "siglip2": EmbeddingModel("siglip2", "Image Embeddings", 768, True),
}
