"""Scores, boosts, weights and thresholds a result depends on."""

# Score thresholds per ranked list.
THRESHOLDS = {
    "keyword": 10.0,
    "jina_v3": 0.71,
    "siglip2": 0.58,
    "similarity": 0.55,
    "metadata": 2.0,
}

# Below this balance the semantic threshold is relaxed by the factor.
STRICT_BALANCE = 0.8
LENIENT_FACTOR = 0.7

# A single-model hybrid query at the ends of the balance runs one side only.
PURE_SEMANTIC_BALANCE = 0.99
PURE_KEYWORD_BALANCE = 0.01

# Reciprocal rank fusion.
RRF_K = 60
RRF_K_MIN = 20
RRF_K_RANGE = 40
WEIGHT_EXPONENT = 1.5
FUSION_FETCH = 2
# Candidates of an approximate vector search per result.
CANDIDATES = 4

# Okapi BM25 as the public Lucene defaults have it.
BM25_K1 = 1.2
BM25_B = 0.75

# Keyword search fields: name -> boost.
TEXT_BOOSTS = {"title": 3.0, "artist": 2.0, "medium": 1.0, "date": 1.0}
KEYWORD_BOOSTS = {"classification": 1.5, "artistNationality": 1.0, "department": 1.0}
DESCRIPTION_BOOSTS = {"visual_alt_text": 0.8, "visual_long_description": 0.5}

# Metadata similarity clauses.
METADATA_WEIGHTS = {
    "artist": 10.0,
    "date": 7.0,
    "medium": 6.0,
    "classification": 5.0,
    "department": 4.0,
    "culture": 4.0,
    "artistNationality": 4.0,
    "dimensions": 3.0,
    "period": 3.0,
    "dynasty": 3.0,
}
UNKNOWN_ARTIST = "Unknown"
UNTITLED = "Untitled"
DECAY_SCALE_YEARS = 25.0
DECAY_AT_SCALE = 0.5
SIZE_TOLERANCE = 0.2

# Combined similarity.
COMBINED_WEIGHTS = {"jina_v3": 0.35, "siglip2": 0.35, "metadata": 0.3}
COMBINED_MODEL_WEIGHT = 0.35
COMBINED_METADATA_WEIGHT = 0.3

# Fuzzy matching: AUTO edit budget by length, and the most expansions of one term.
FUZZY_ONE_EDIT_LENGTH = 3
FUZZY_TWO_EDIT_LENGTH = 6
MAX_EXPANSIONS = 50

DEFAULT_SIZE = 20
SIMILAR_VIEW_SIZE = 12
FACET_SIZE = 1000

# Query-vector cache.
CACHE_PREFIX = "emb:"
CACHE_TTL_SECONDS = 7 * 24 * 3600
CACHE_REFRESH_SECONDS = 3600

# Generated alt text.
ALT_TEXT_MIN_WORDS = 10
ALT_TEXT_MAX_WORDS = 20

# Ranked scores are single-precision on the server side; six decimals keep them
# comparable across engines, ties then fall to the document id.
SCORE_DIGITS = 6
# Fused scores differ by far less than a rank's worth, so they keep more digits.
FUSED_DIGITS = 10
