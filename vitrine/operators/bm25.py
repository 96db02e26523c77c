"""BM25 keyword ranking over boosted fields, the best field of a document counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import constants as C
from vitrine.operators.blocktopk import dense_topk
from vitrine.operators.features import FeatureScorer
from vitrine.operators.terms import TextIndex, candidate_terms, wanted_terms, weighted_features
from vitrine.session import stage


def keyword_search(
    queries: DataFrame,
    index: TextIndex,
    size: int = C.DEFAULT_SIZE,
    fuzzy: bool = True,
    with_total: bool = False,
    max_expansions: int | None = C.MAX_EXPANSIONS,
    **options,
) -> DataFrame:
    """Ranked list ``query_id, doc_id, score, rank`` (and ``total`` matches).

    ``queries(query_id, text)``; equal texts are searched once, under the least of their ids,
    so no text rides along with the candidates.  Documents are scored where they lie, only the
    best of each task are shuffled.  ``max_expansions`` bounds the words near a query word
    (None: all of them).
    """
    texts = queries.groupBy("text").agg(F.min("query_id").alias("search_id"))
    values = [(f, F.col("text")) for f in index.fields]
    wanted = wanted_terms(texts, values, "search_id")
    near = [f.name for f in index.fields] if fuzzy else []
    features = stage(weighted_features(wanted, index, near, max_expansions))
    ranked = dense_topk(
        candidate_terms(index, features),
        features,
        FeatureScorer(index.fields, best_field=True),
        size,
        with_total=with_total,
        **options,
    )
    columns = ["query_id", "doc_id", "score", "rank", *(["total"] if with_total else [])]
    asked = queries.select("query_id", "text").join(texts, "text")
    return asked.join(ranked.withColumnRenamed("query_id", "search_id"), "search_id").select(*columns)
