"""Search plans: hybrid fusion, query routing and all modes side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import constants as C
from vitrine.functions import scoring, text
from vitrine.operators.bm25 import keyword_search
from vitrine.operators.fusion import as_list, fuse
from vitrine.operators.knn import semantic_search
from vitrine.operators.ranking import add_total
from vitrine.operators.tags import tag_search
from vitrine.operators.terms import TextIndex
from vitrine.schemas import EMBEDDING_MODELS
from vitrine.session import stage

DEFAULT_BALANCE = 0.5


@dataclass(frozen=True)
class SearchOptions:
    """What one request asks for; the defaults are those of the search page."""

    keyword: bool = True
    hybrid: bool = True
    mode: str = "image"
    balance: float = DEFAULT_BALANCE
    include_descriptions: bool = True
    models: tuple[str, ...] = tuple(EMBEDDING_MODELS)
    size: int = C.DEFAULT_SIZE
    route_emoji: bool = True
    model_fallback: bool = False
    knn: dict = field(default_factory=dict)

    @staticmethod
    def from_params(params: Mapping[str, str]) -> SearchOptions:
        """Options of a page address: switches are on unless ``false``, all models by default."""
        named = params.get("models")
        wanted = named.split(",") if named else list(EMBEDDING_MODELS)
        return SearchOptions(
            keyword=params.get("keyword") != "false",
            hybrid=params.get("hybrid") != "false",
            mode=params.get("hybridMode") or "image",
            balance=float(params.get("hybridBalance") or DEFAULT_BALANCE),
            include_descriptions=params.get("includeDescriptions") != "false",
            models=tuple(m for m in EMBEDDING_MODELS if m in wanted),
        )


def hybrid_models(mode: str, selected: Sequence[str], fallback: bool = False) -> list[str]:
    """Models a hybrid mode runs on; with ``fallback`` any selected model of the same kind."""
    if mode == "both":
        return [m for m in EMBEDDING_MODELS if m in selected]
    wanted, image = {"text": ("jina_v3", False), "image": ("siglip2", True)}[mode]
    if wanted in selected:
        return [wanted]
    if fallback:
        return [m for m in selected if m in EMBEDDING_MODELS and EMBEDDING_MODELS[m].supports_image == image][:1]
    return []


def route(query_text: Column, options_emoji: bool = True) -> Column:
    """``tags`` for a query of emoji only, else ``keyword``."""
    if not options_emoji:
        return F.lit("keyword")
    return F.when(text.is_emoji_only(query_text), "tags").otherwise("keyword")


def _with_balance(queries: DataFrame, default: float = DEFAULT_BALANCE) -> DataFrame:
    balance = F.col("balance") if "balance" in queries.columns else F.lit(None)
    return queries.withColumn("balance", F.coalesce(balance.cast("double"), F.lit(default)))


def explain_hybrid(queries: DataFrame, models: Sequence[str]) -> DataFrame:
    """``query_id, explain``: balance, k, weights and thresholds behind a hybrid ranking."""
    queries = _with_balance(queries)
    balance = F.col("balance")
    single = len(models) == 1
    semantic_only = F.lit(single) & (balance >= C.PURE_SEMANTIC_BALANCE)
    keyword_only = F.lit(single) & (balance <= C.PURE_KEYWORD_BALANCE)

    def side(raw: Column, normalized: Column, when_semantic: float) -> tuple[Column, Column]:
        fixed = F.when(semantic_only, when_semantic).when(keyword_only, 1 - when_semantic)
        return F.coalesce(fixed, raw), F.coalesce(fixed, normalized)

    raw_keyword, raw_semantic = scoring.raw_weights(balance)
    norm_keyword, norm_semantic = scoring.balance_weights(balance)
    keyword, semantic = side(raw_keyword, norm_keyword, 0.0), side(raw_semantic, norm_semantic, 1.0)
    note = F.when(semantic_only, "semantic only").when(keyword_only, "keyword only").otherwise("weighted rank fusion")
    thresholds = F.create_map(
        *[x for m in models for x in (F.lit(m), scoring.semantic_threshold(F.lit(C.THRESHOLDS[m]), balance))]
    )
    return queries.select(
        "query_id",
        F.struct(
            note.alias("note"),
            balance.alias("balance"),
            F.when(semantic_only | keyword_only, F.lit(float(C.RRF_K))).otherwise(scoring.dynamic_k(balance)).alias("k"),
            keyword[0].alias("keyword_raw"),
            keyword[1].alias("keyword_normalized"),
            semantic[0].alias("semantic_raw"),
            semantic[1].alias("semantic_normalized"),
            (semantic[1] / len(models)).alias("semantic_per_model"),
            F.lit(C.THRESHOLDS["keyword"]).alias("keyword_threshold"),
            thresholds.alias("semantic_thresholds"),
            F.array(*[F.lit(m) for m in models]).alias("models"),
        ).alias("explain"),
    )


def semantic_lists(queries: DataFrame, vectors: Mapping[str, DataFrame], models: Sequence[str], size: int, **knn) -> dict[str, DataFrame]:
    """One vector ranking per model."""
    return {
        m: semantic_search(queries.select("query_id", F.col(f"vec_{m}").alias("vec")), vectors[m], size, **knn)
        for m in models
    }


def hybrid_search(
    queries: DataFrame,
    index: TextIndex,
    vectors: Mapping[str, DataFrame],
    models: Sequence[str],
    size: int = C.DEFAULT_SIZE,
    fuzzy: bool = True,
    keyword_ranked: DataFrame | None = None,
    semantic_ranked: Mapping[str, DataFrame] | None = None,
    knn: Mapping | None = None,
    max_expansions: int | None = C.MAX_EXPANSIONS,
) -> DataFrame:
    """Keyword and vector lists of each query, fused by its balance.

    ``queries(query_id, text, balance, vec_<model>…)``; ``vectors[model](doc_id, vec)``.
    With one model the ends of the balance run one side only and keep its scores and its
    total (all keyword matches, or the vectors listed); with several, a query without a vector for a model simply has no list for it.
    """
    single = len(models) == 1
    models = [m for m in models if f"vec_{m}" in queries.columns and m in vectors]
    if not models:  # nothing to fuse with: no hits, as for a query without a vector
        ids = queries.schema["query_id"].dataType.simpleString()
        docs = index.doc_id_type()
        none = f"query_id {ids}, doc_id {docs}, score double, rank int, total long, sources array<string>"
        return queries.sparkSession.createDataFrame([], none)
    queries = _with_balance(queries)
    have = [F.col(f"vec_{m}").isNotNull() for m in models]
    available = sum((h.cast("int") for h in have[1:]), have[0].cast("int"))
    asked = queries.withColumn("n_models", available).where("n_models > 0")
    if keyword_ranked is None:
        asked = stage(asked)  # every list reads it, vectors and all
    settings = asked.select("query_id", "balance", "n_models")
    fetch = size * C.FUSION_FETCH

    if keyword_ranked is None:
        keyword_ranked = keyword_search(
            asked.select("query_id", "text"), index, fetch, fuzzy, with_total=single, max_expansions=max_expansions
        )
    keyword = keyword_ranked.join(settings, "query_id")
    if semantic_ranked is None:
        semantic_ranked = semantic_lists(asked, vectors, models, fetch, **(knn or {}))
    semantic = {m: semantic_ranked[m].join(settings, "query_id") for m in models}

    balance = F.col("balance")
    k = scoring.dynamic_k(balance)
    keyword_weight, semantic_weight = scoring.balance_weights(balance)
    semantic_only, keyword_only = balance >= C.PURE_SEMANTIC_BALANCE, balance <= C.PURE_KEYWORD_BALANCE
    mixed = ~semantic_only & ~keyword_only if single else F.lit(True)

    lists = [
        as_list(keyword.where(mixed), "keyword", 0, keyword_weight, k, F.lit(C.THRESHOLDS["keyword"])),
    ]
    for position, (model, ranked) in enumerate(semantic.items(), 1):
        threshold = scoring.semantic_threshold(F.lit(C.THRESHOLDS[model]), balance)
        lists.append(
            as_list(ranked.where(mixed), model, position, semantic_weight / F.col("n_models"), k, threshold)
        )
    fused = fuse(lists, size)
    if not single:
        return fused

    def one_sided(ranked: DataFrame, condition: Column, source: str) -> DataFrame:
        own = ranked.where(condition & (F.col("rank") <= size))
        if "total" not in own.columns:
            own = add_total(own)
        return own.select("query_id", "doc_id", "score", "rank", "total", F.array(F.lit(source)).alias("sources"))

    return fused.unionByName(one_sided(semantic[models[0]], semantic_only, models[0])).unionByName(
        one_sided(keyword, keyword_only, "keyword")
    )


def multi_mode_search(
    queries: DataFrame,
    index: TextIndex,
    vectors: Mapping[str, DataFrame],
    options: SearchOptions | None = None,
    tags: DataFrame | None = None,
    fuzzy: bool = True,
    max_expansions: int | None = C.MAX_EXPANSIONS,
) -> DataFrame:
    """Keyword (or tag), each model and hybrid results side by side: ``query_id, mode, doc_id, score, rank``.

    ``tags(doc_id, tags)`` serves the queries made of emoji only.
    """
    options = options or SearchOptions()
    if not options.include_descriptions:
        index = index.without(C.DESCRIPTION_BOOSTS)
    queries = stage(_with_balance(queries, options.balance))
    columns = ["query_id", "doc_id", "score", "rank"]
    found: list[DataFrame] = []
    selected = [m for m in options.models if m in vectors and f"vec_{m}" in queries.columns]
    to_tags = route(F.col("text"), options.route_emoji and tags is not None) == "tags"
    words = keyword_search(
        queries.select("query_id", "text"), index, options.size * C.FUSION_FETCH, fuzzy, max_expansions=max_expansions
    )
    if options.keyword:
        plain = words.join(queries.where(~to_tags).select("query_id"), "query_id", "left_semi")
        found.append(plain.where(F.col("rank") <= options.size).select(F.lit("keyword").alias("mode"), *columns))
        if tags is not None and options.route_emoji:
            emoji = queries.where(to_tags).select("query_id", text.emoji_points(F.col("text")).alias("tags"))
            found.append(tag_search(emoji, tags, options.size).select(F.lit("keyword").alias("mode"), *columns))
    # Twice the size serves the fusion, its first half is the model's own list.
    near = semantic_lists(queries, vectors, selected, options.size * C.FUSION_FETCH, **options.knn)
    for model, ranked in near.items():
        found.append(ranked.where(F.col("rank") <= options.size).select(F.lit(model).alias("mode"), *columns))
    hybrid_on = hybrid_models(options.mode, selected, options.model_fallback) if options.hybrid else []
    if hybrid_on:
        ranked = hybrid_search(
            queries, index, vectors, hybrid_on, options.size, fuzzy, keyword_ranked=words, semantic_ranked=near
        )
        found.append(ranked.select(F.lit("hybrid").alias("mode"), *columns))
    if not found:
        raise ValueError("the options ask for no search at all")
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result
