"""Queries over the shared test tables, each with its SQL twin where SQL can say it."""

from registered import (
    catalogue_queries,
    enrich_queries,
    hybrid_queries,
    keyword_queries,
    similarity_queries,
    storage_queries,
    text_queries,
    vector_queries,
)

MODULES = (
    vector_queries,
    keyword_queries,
    hybrid_queries,
    similarity_queries,
    text_queries,
    enrich_queries,
    catalogue_queries,
    storage_queries,
)
