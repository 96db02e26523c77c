"""Catalogue text functions: years, sizes, tags, numbers, tokens and emoji."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine import constants as C

# White space as the catalogue rules see it: wider than Java's own \s.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NOT_SPACE = SPACE.replace("[", "[^", 1)

# Word tokens after the Unicode segmentation rules: letters, digits and
# underscores run on, some punctuation joins letters or digits on both sides, an
# ideograph or hiragana letter stands alone.  Possessive, so long junk stays linear.
_ALONE = r"\p{IsHan}\p{IsHiragana}"
_LETTER = rf"[a-z_[\p{{L}}\p{{M}}&&[^{_ALONE}]]]"
_JOIN_LETTERS = r"[.:\u00B7'\u2018\u2019\u2024\u2027\uFE13\uFE52\uFE55\uFF07\uFF0E\uFF1A]"
_JOIN_DIGITS = r"[.,;'\u2018\u2019\u2024\u066C\uFE10\uFE14\uFE50\uFE52\uFE54\uFF07\uFF0C\uFF0E\uFF1B]"
_DIGIT = r"[0-9\p{Nd}]"
TOKEN = (
    rf"(?:{_LETTER}++(?:{_JOIN_LETTERS}{_LETTER}++)*+"
    rf"|{_DIGIT}++(?:{_JOIN_DIGITS}{_DIGIT}++)*+)++"
    rf"|[{_ALONE}]"
)


def trim_space(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(col: Column) -> Column:
    """True for NULL and for white space only."""
    return ~F.coalesce(col.rlike(NOT_SPACE), F.lit(False))


def or_default(col: Column, default: Column | str) -> Column:
    """The default where a string is NULL or empty."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(col, F.lit("")), fallback)


def is_true(col: Column) -> Column:
    return F.coalesce(F.lower(col) == "true", F.lit(False))


def extract_years(date: Column) -> tuple[Column, Column]:
    """(begin, end): both ends of ``1950-1960``, else the first four digits twice."""
    # The year patterns.
    span = r"(\d{4})[–-](\d{4})"
    first = F.regexp_extract(date, span, 1)
    last = F.regexp_extract(date, span, 2)
    single = F.regexp_extract(date, r"\d{4}", 0)
    begin = F.when(first != "", first).otherwise(single)
    end = F.when(last != "", last).otherwise(single)
    return begin.try_cast("int"), end.try_cast("int")


def clean_dimensions(text: Column) -> Column:
    """Single spaces, straight quotes."""
    return F.trim(F.translate(F.regexp_replace(text, f"{SPACE}+", " "), "″′", "\"'"))


def parse_dimensions(text: Column) -> Column:
    """Struct of height, width, depth and diameter read from free text."""
    # The number and size patterns.
    number = r"(\d+(?:\.\d+)?)"
    by = rf"{SPACE}*[x×]{SPACE}*"
    sizes = rf"{number}{by}{number}{SPACE}*(?:[x×]{SPACE}*{number})?"

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("double")

    return F.struct(
        part(sizes, 1).alias("height"),
        part(sizes, 2).alias("width"),
        part(sizes, 3).alias("depth"),
        part(rf"(?i)diameter(?::|{SPACE})+{number}", 1).alias("diameter"),
    )


def prefix_int(text: Column) -> Column:
    """Leading integer of a string, NULL when it does not start with one."""
    return F.regexp_extract(text, rf"^{SPACE}*([-+]?\d+)", 1).try_cast("int")


def prefix_float(text: Column) -> Column:
    """Leading decimal number of a string, NULL when it does not start with one."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    return F.regexp_extract(text, rf"^{SPACE}*({number})", 1).try_cast("double")


def join_tags(text: Column) -> Column:
    """``A| B ||C`` becomes ``A, B, C``."""
    trimmed = F.transform(F.split(text, r"\|"), trim_space)
    return F.array_join(F.filter(trimmed, lambda t: t != ""), ", ")


def replace_first(text: Column, old: str, new: str) -> Column:
    """Literal replacement of the first occurrence only."""
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, F.lit(new), at, F.lit(len(old)))).otherwise(text)


def thumbnail_url(url: Column) -> Column:
    return replace_first(url, "1024x1024", "400x400")


def namespaced_id(collection: str, key: Column) -> Column:
    return F.concat(F.lit(f"{collection}_"), key)


def tokens(text: Column) -> Column:
    """Lower-cased word tokens, neither stemmed nor stopped."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def cache_key(query: Column) -> Column:
    """Key of a query in the vector cache; spelling variants in case and outer space share it."""
    return F.concat(F.lit(C.CACHE_PREFIX), F.md5(trim_space(F.lower(query))))


def labelled_text(fields: Sequence[tuple[str, Column]]) -> Column:
    """``Label: value. Label: value`` over the values that are present."""
    return F.concat_ws(". ", *[F.when(value != "", F.concat(F.lit(f"{label}: "), value)) for label, value in fields])


# --- emoji -----------------------------------------------------------------


@cache
def _property_class(prop: str, ascii_too: bool = True) -> str:
    """Inner part of a character class for a Unicode property Java has no name for."""
    low = 0 if ascii_too else 0x80
    points = [ord(ch) for ch in regex.findall(rf"\p{{{prop}}}", "".join(map(chr, (*range(low, 0xD800), *range(0xE000, 0x20000)))))]
    spans: list[list[int]] = []
    for point in points:
        if spans and spans[-1][1] == point - 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)


def emoji_class() -> str:
    """Single emoji code point: digits, ``#`` and ``*`` included, joiners excluded."""
    return f"[{_property_class('Emoji')}]"


def emoji_sequence() -> str:
    """Whole emoji: flag, keycap, tag sequence, or elements held by joiners."""
    flag = r"[\x{1F1E6}-\x{1F1FF}]{2}"
    keycap = r"[0-9#*]\x{FE0F}?\x{20E3}"
    element = rf"[{_property_class('Emoji', ascii_too=False)}](?:\x{{FE0F}}|[\x{{1F3FB}}-\x{{1F3FF}}])?"
    tags = r"(?:[\x{E0020}-\x{E007E}]+\x{E007F})?"
    return rf"{flag}|{keycap}|{element}{tags}(?:\x{{200D}}{element})*"


# Where an emoji can start at all: settles most characters without a look at the long class.
_MAYBE_EMOJI = r"(?=[0-9#*\xA9\xAE\x{203C}-\x{1FFFF}])"


def _quick(pattern: str) -> str:
    return f"{_MAYBE_EMOJI}(?:{pattern})"


def emoji_points(text: Column) -> Column:
    """Every emoji code point of a text, in order."""
    return F.regexp_extract_all(text, F.lit(_quick(emoji_class())), F.lit(0))


def is_emoji_only(text: Column) -> Column:
    """At least one emoji and nothing but white space besides."""
    rest = F.regexp_replace(text, _quick(emoji_class()), "")
    return F.coalesce(text.rlike(_quick(emoji_class())) & is_blank(rest), F.lit(False))


def normalize_emoji_summary(text: Column) -> Column:
    """Whole emoji only, without commas and white space."""
    packed = F.regexp_replace(text, f",|{SPACE}", "")
    return F.array_join(F.regexp_extract_all(packed, F.lit(_quick(emoji_sequence())), F.lit(0)), "")


def has_any_emoji(text: Column, emoji: Sequence[str]) -> Column:
    """True where one of the given emoji occurs."""
    return F.coalesce(text.rlike(_quick("|".join(emoji))), F.lit(False))


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Value of a small fixed dictionary, the key itself where it is unknown."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), key)
