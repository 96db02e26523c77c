"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine import constants as C


def idf(n_docs: Column, df: Column) -> Column:
    """BM25 inverse document frequency, always positive."""
    return F.log(1 + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def dynamic_k(balance: Column) -> Column:
    """RRF constant: 60 at balance 0.5, falling to 20 at either end."""
    return F.lit(C.RRF_K_MIN) + (1 - F.abs(balance - 0.5) * 2) * F.lit(C.RRF_K_RANGE)


def raw_weights(balance: Column) -> tuple[Column, Column]:
    """Unnormalised (keyword, semantic) weights of a balance."""
    return F.pow(1 - balance, F.lit(C.WEIGHT_EXPONENT)), F.pow(balance, F.lit(C.WEIGHT_EXPONENT))


def balance_weights(balance: Column) -> tuple[Column, Column]:
    """(keyword, semantic) weights that sum to one."""
    keyword, semantic = raw_weights(balance)
    return keyword / (keyword + semantic), semantic / (keyword + semantic)


def rrf(weight: Column, k: Column, rank0: Column) -> Column:
    """Reciprocal rank contribution of a 0-based rank."""
    return weight / (k + rank0 + 1)


def semantic_threshold(base: Column, balance: Column) -> Column:
    """Strict above balance 0.8, otherwise relaxed."""
    return F.when(balance > C.STRICT_BALANCE, base).otherwise(base * C.LENIENT_FACTOR)


def truthy(number: Column) -> Column:
    """NULL where a number is missing or zero."""
    return F.nullif(number, F.lit(0))


def center_year(begin: Column, end: Column) -> Column:
    """Half-up mean of both years, or whichever of them is present and not zero."""
    b, e = truthy(begin), truthy(end)
    return F.coalesce(F.floor((b + e) / 2 + 0.5).cast("int"), b, e)


def gauss_decay(year: Column, origin: Column) -> Column:
    """0.5 at 25 years from the origin; a missing year counts as no distance."""
    distance = (year - origin) / F.lit(C.DECAY_SCALE_YEARS)
    return F.coalesce(F.pow(F.lit(C.DECAY_AT_SCALE), distance * distance), F.lit(1.0))


def within_tolerance(value: Column, origin: Column) -> Column:
    """Relative range predicate: 80 % to 120 % of the origin."""
    return value.between(origin * (1 - C.SIZE_TOLERANCE), origin * (1 + C.SIZE_TOLERANCE))
