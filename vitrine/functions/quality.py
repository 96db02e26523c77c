"""Checks on generated descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine import constants as C
from vitrine.functions import text as T

# Wording that gives away catalogue data, in reporting order.
LEAK_PATTERNS = (
    r"\d{4}s?",
    r"(century|period|dynasty|era)",
    r"(american|european|african|asian|chinese|japanese|indian)",
    r"(artist|painter|sculptor|creator|maker)",
    r"created by",
    r"made in",
    r"from the",
    r"(museum|collection|gallery)",
    r"(oil painting|watercolor|bronze sculpture|marble)",
)

# People and faces a summary should avoid.
PERSON_EMOJI = "👤 👥 👨 👩 👶 👧 👦 👴 👵 🧑 👮 👷 💂 🕵 👳 👱 🧔 👸 🤴".split()
FACE_EMOJI = (
    "😀 😃 😄 😁 😊 😇 🙂 😉 😌 😍 🥰 😘 😗 😙 😚 😋 😛 😜 🤪 😝 🤑 🤗 🤭 🤫 🤔 🤐 😐 😑 😶 😏 😒 🙄 😬 🤥 "
    "😔 😪 🤤 😴 😷 🤒 🤕 🤢 🤮 🤧 😵 🤯 🤠 😎 🤓 🧐 😕 😟 🙁 ☹️ 😮 😯 😲 😳 😦 😧 😨 😰 😥 😢 😭 😱 😖 😣 "
    "😞 😓 😩 😫 🥱 😤 😡 😠 🤬 😈 👿 💀 ☠️ 💩 🤡 👹 👺 👻 👽 👾 🤖 😺 😸 😹 😻 😼 😽 🙀 😿 😾"
).split()

# The patterns mean a boundary of ASCII words, which Java's own word boundary is not.
_WORD_START = r"(?<![A-Za-z0-9_])"
_WORD_END = r"(?![A-Za-z0-9_])"


def leaks(text: Column) -> Column:
    """First match of every leak pattern, in pattern order."""
    found = [F.regexp_extract(text, f"(?i){_WORD_START}{p}{_WORD_END}", 0) for p in LEAK_PATTERNS]
    return F.filter(F.array(*found), lambda hit: hit != "")


def violations(alt_text: Column, long_text: Column) -> Column:
    """Leaks of both texts one after the other, repeats kept."""
    return F.concat(leaks(alt_text), leaks(long_text))


def word_count(text: Column) -> Column:
    return F.size(F.split(text, f"{T.SPACE}+"))


def has_expected_length(text: Column) -> Column:
    return word_count(text).between(C.ALT_TEXT_MIN_WORDS, C.ALT_TEXT_MAX_WORDS)


def is_complete(*texts: Column) -> Column:
    """All required texts are present and not empty."""
    ok = F.lit(True)
    for text in texts:
        ok = ok & F.coalesce(text != "", F.lit(False))
    return ok


def shows_people(emoji_summary: Column) -> Column:
    return T.has_any_emoji(emoji_summary, [*PERSON_EMOJI, *FACE_EMOJI])
