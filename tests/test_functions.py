"""Scalar functions on rows worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from vitrine import constants as C
from vitrine.functions import quality, scoring
from vitrine.functions import text as T
from vitrine.functions import vectors as V


def one(spark, value, *columns, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    row = df.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


X = F.col("x")


@pytest.mark.parametrize(
    "date, expected",
    [
        ("1950-1960", (1950, 1960)),
        ("1950–1960", (1950, 1960)),
        ("ca. 1950–1960", (1950, 1960)),
        ("1889", (1889, 1889)),
        ("ca. 1900", (1900, 1900)),
        ("1950-60", (1950, 1950)),
        ("19th century", (None, None)),
        ("", (None, None)),
        (None, (None, None)),
        ("12345", (1234, 1234)),
    ],
)
def test_years(spark, date, expected):
    assert one(spark, date, *T.extract_years(X)) == expected


@pytest.mark.parametrize(
    "raw, expected", [("  20  x 30″  (5′) ", "20 x 30\" (5')"), ("a   b", "a b"), ("", "")]
)
def test_clean_dimensions(spark, raw, expected):
    assert one(spark, raw, T.clean_dimensions(X)) == expected


def test_parse_dimensions(spark):
    assert tuple(one(spark, "50.5 x 40 x 3 cm", T.parse_dimensions(X))) == (50.5, 40.0, 3.0, None)
    assert tuple(one(spark, "Diameter: 12.5 cm", T.parse_dimensions(X))) == (None, None, None, 12.5)
    assert tuple(one(spark, "10 × 20", T.parse_dimensions(X))) == (10.0, 20.0, None, None)


@pytest.mark.parametrize("raw, expected", [("(1841)", None), ("1841", 1841), ("-1841", -1841), (" 7th", 7), ("99999999999", None)])
def test_prefix_int(spark, raw, expected):
    assert one(spark, raw, T.prefix_int(X)) == expected


@pytest.mark.parametrize("raw, expected", [("12.5 cm", 12.5), (".5e1", 5.0), ("x1", None), ("3.", 3.0)])
def test_prefix_float(spark, raw, expected):
    assert one(spark, raw, T.prefix_float(X)) == expected


def test_tags_thumbnail_defaults(spark):
    assert one(spark, "Men| Horses ||Trees", T.join_tags(X)) == "Men, Horses, Trees"
    assert one(spark, "a/1024x1024/1024x1024", T.thumbnail_url(X)) == "a/400x400/1024x1024"
    assert one(spark, "plain", T.thumbnail_url(X)) == "plain"
    assert one(spark, "", T.or_default(X, "Untitled")) == "Untitled"
    assert one(spark, None, T.or_default(X, "Untitled")) == "Untitled"
    assert one(spark, "7", T.namespaced_id("met", X)) == "met_7"


def test_cache_key(spark):
    assert one(spark, "  Woman ", T.cache_key(X)) == "emb:56609ab6ba04048adc2cbfafbe745e10"


@pytest.mark.parametrize(
    "raw, points",
    [("🧔‍♂️2", ["🧔", "♂", "2"]), ("no", []), ("⛰️🌊", ["⛰", "🌊"])],
)
def test_emoji_points(spark, raw, points):
    assert one(spark, raw, T.emoji_points(X)) == points


@pytest.mark.parametrize("raw, only", [("1889", True), ("🌊 🌊", True), ("⛰️", False), ("sea 🌊", False), ("", False), (None, False)])
def test_emoji_only(spark, raw, only):
    assert one(spark, raw, T.is_emoji_only(X)) is only


@pytest.mark.parametrize(
    "raw, summary",
    [("⛰️, 🌊, x", "⛰️🌊"), ("🧔‍♂️ 🇫🇷", "🧔‍♂️🇫🇷"), ("1️⃣ 2", "1️⃣"), ("👍🏽!", "👍🏽"), ("none", "")],
)
def test_emoji_summary(spark, raw, summary):
    assert one(spark, raw, T.normalize_emoji_summary(X)) == summary


def test_leaks(spark):
    assert one(spark, "In the 1960s a painter", quality.leaks(X)) == ["1960s", "painter"]
    assert one(spark, "A red boat on water", quality.leaks(X)) == []
    assert one(spark, "Erased opera", quality.leaks(X)) == []
    assert one(spark, "FROM THE museum", quality.leaks(X)) == ["FROM THE", "museum"]
    assert one(spark, "a 1900", quality.violations(X, X)) == ["1900", "1900"]


def test_words_and_people(spark):
    assert one(spark, " a b", quality.word_count(X)) == 3
    assert one(spark, " ".join("abcdefghij"), quality.has_expected_length(X)) is True
    assert one(spark, "one", quality.has_expected_length(X)) is False
    assert one(spark, "🌊👩", quality.shows_people(X)) is True
    assert one(spark, "🌊", quality.shows_people(X)) is False


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Don't stop 3.14, foo_bar!", ["don't", "stop", "3.14", "foo_bar"]),
        ("wi-fi a.1 a1.5", ["wi", "fi", "a", "1", "a1.5"]),
        ("漢字 kana", ["漢", "字", "kana"]),
        ("", []),
        ("x" * 30000 + "1a" * 10000, ["x" * 30000 + "1a" * 10000]),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, text, T.tokens(X)) == tokens


@pytest.mark.parametrize(
    "balance, k, keyword, semantic, first",
    [
        (0.0, 20, 1, 0, 0.04761905),
        (0.25, 40, 0.838610, 0.161390, 0.02045389),
        (0.5, 60, 0.5, 0.5, 0.00819672),
        (0.75, 40, 0.161390, 0.838610, 0.00393635),
        (1.0, 20, 0, 1, 0),
    ],
)
def test_balance(spark, balance, k, keyword, semantic, first):
    kw, sem = scoring.balance_weights(X)
    got = one(spark, balance, scoring.dynamic_k(X), kw, sem, scoring.rrf(kw, scoring.dynamic_k(X), F.lit(0)), kind="double")
    assert got == pytest.approx((k, keyword, semantic, first), abs=1e-6)


def test_years_between(spark):
    df = spark.createDataFrame([(1900, 1951), (0, 1900), (None, 1900), (0, 0)], "b int, e int")
    assert [r[0] for r in df.select(scoring.center_year(F.col("b"), F.col("e"))).collect()] == [1926, 1900, 1900, None]
    assert one(spark, 1925, scoring.gauss_decay(X, F.lit(1900)), kind="int") == pytest.approx(0.5)
    assert one(spark, None, scoring.gauss_decay(X, F.lit(1900)), kind="int") == 1.0
    assert one(spark, 0.81, scoring.within_tolerance(X, F.lit(1.0)), kind="double") is True
    assert one(spark, 1.21, scoring.within_tolerance(X, F.lit(1.0)), kind="double") is False


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], V.l2_norm(X), kind="array<float>") == 5.0
    assert one(spark, [3.0, 4.0, 9.0], V.truncate(X, 2), kind="array<float>") == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], V.normalize(X), kind="array<float>") is None
    assert one(spark, [1.0, 0.0], V.cosine_score(X, F.array(F.lit(0.0), F.lit(2.0))), kind="array<float>") == 0.5
    assert one(spark, [0.0], V.has_direction(X), kind="array<float>") is False


def test_idf_positive(spark):
    value = one(spark, 10, scoring.idf(F.lit(10), X), kind="int")
    assert value == pytest.approx(math.log(1 + 0.5 / 10.5))
    assert C.BM25_K1 == 1.2
