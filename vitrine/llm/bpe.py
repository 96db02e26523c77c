"""Byte-pair encoding and decoding of whole texts with a given byte-level vocabulary.

The distinct pieces of a part of the table are laid out in one sequence of symbols. An index maps each pair of
neighbouring symbols to all its positions; the active ranks are applied in ascending order, and each merge
updates the lists of the pairs beside it. Pieces that came before are looked up.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm.columns import append_columns, held_in_worker
from vitrine.llm.units import LatinCut, MixedTexts, UnitCache, ragged, sums, whole_texts

# The pattern that splits text before the merges, with the white space of Unicode spelled out.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same split for ASCII letters and digits and the letters of Latin-1.
_LETTERS, _DIGITS, _LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", re.compile("[\x00-\x7f\xa1-ÿ]*")
_PLAIN_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\t-\r {_LETTERS}{_DIGITS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


_SPACES = {b"", *(bytes([c]) for c in (9, 10, 11, 12, 13, 32))}
#: Distinct pieces that share one index: enough for its overhead, few enough for the processor's caches.
PIECES_AT_ONCE = 4096
#: Places of a symbol in the code of a pair.
SHIFT = 24


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and its byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class BpeModel:
    """Vocabulary, merges and special tokens of a byte-level tokenizer file (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        self.ids = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        size = max([*self.ids.values(), *self.specials.values()]) + 1
        self.pieces = [b""] * size
        for token, i in self.ids.items():
            self.pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.specials.items():
            self.pieces[i] = token.encode()
        names = {b: c for c, b in letters.items()}
        self.byte_ids = np.array([self.ids[names[b]] for b in range(256)], dtype=np.int64)
        #: (left, right, merged) by rank, and the rank of left << SHIFT | right.
        self.rules: list[tuple[int, int, int]] = []
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rules.append((self.ids[a], self.ids[b], self.ids[a + b]))
            self.ranks.setdefault(self.ids[a] << SHIFT | self.ids[b], rank)
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.find = regex.compile(PIECES).findall

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        return _PLAIN_PIECES.findall(text) if _LATIN.fullmatch(text) else self.find(text)

    def parts(self, text: str) -> list[tuple[str, int]]:
        """The pieces of a text with -1, and its special tokens with their ids."""
        if self.special_pattern is None:
            return [(p, -1) for p in self.split(text)]
        out, at = [], 0
        for match in self.special_pattern.finditer(text):
            out += [(p, -1) for p in self.split(text[at : match.start()])]
            out.append((match.group(), self.specials[match.group()]))
            at = match.end()
        return out + [(p, -1) for p in self.split(text[at:])]


def apply_merges(model: BpeModel, pieces: list[bytes]) -> list[list[int]]:
    """The ids of each piece, by the pair occurrence index over all of them.

    Every merge makes a symbol whose own merges have higher ranks, so ascending ranks over all pieces give each
    piece what merging its lowest pair again and again would.
    """
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    laid = model.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    n = len(laid)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = lengths > 0
    before[bounds[:-1][filled]] = -1
    after[bounds[1:][filled] - 1] = -1
    # Index: rank of a pair -> positions of its left symbols.
    positions: dict[int, list[int]] = {}
    get = model.ranks.get
    places = np.flatnonzero(after >= 0)
    codes = laid[places] << SHIFT | laid[places + 1]
    order = np.argsort(codes, kind="stable")
    distinct, firsts = np.unique(codes[order], return_index=True)
    ends = [*firsts[1:].tolist(), len(order)]
    for code, first, end in zip(distinct.tolist(), firsts.tolist(), ends):
        if (rank := get(code)) is not None:
            positions[rank] = places[order[first:end]].tolist()
    symbols, after, before = laid.tolist(), after.tolist(), before.tolist()
    active = list(positions)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, merged = model.rules[rank]
        held = positions.pop(rank)
        if left == right:  # of overlapping pairs the leftmost merges
            held.sort()
        base = merged << SHIFT
        for at in held:
            if symbols[at] != left:
                continue
            other = after[at]
            if other < 0 or symbols[other] != right:
                continue
            symbols[at], symbols[other] = merged, -1
            after[at] = end = after[other]
            if end >= 0:
                before[end] = at
                if (found := get(base | symbols[end])) is not None:
                    if (known := positions.get(found)) is not None:
                        known.append(at)
                    else:
                        positions[found] = [at]
                        heapq.heappush(active, found)
            start = before[at]
            if start >= 0 and (found := get(symbols[start] << SHIFT | merged)) is not None:
                if (known := positions.get(found)) is not None:
                    known.append(start)
                else:
                    positions[found] = [start]
                    heapq.heappush(active, found)
    return [[s for s in symbols[a:b] if s >= 0] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


class Encoder:
    """Ids of whole texts; pieces that were met before are not merged again."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.plain = UnitCache(self.encode_units, LatinCut(spaces=True))
        self.sequences = MixedTexts(self.plain, UnitCache(self.encode_texts, whole_texts, max_units=1), b"<|").sequences

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of one kind of character after white space."""
        pieces, counts = [], []
        for unit in units:
            if unit.isalnum() or (unit[:1] == b" " and unit[1:2] not in _SPACES and b"'" not in unit):
                pieces.append(unit)
                counts.append(1)
            else:
                some = self.model.split(unit.decode("utf-8"))
                pieces += [p.encode("utf-8") for p in some]
                counts.append(len(some))
        ids, sizes = self.merge(pieces)
        return ids, sums(sizes, np.concatenate([[0], np.cumsum(counts)]))

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts with any characters and special tokens."""
        values, lengths = [], []
        for text in texts:
            parts = self.model.parts(text.decode("utf-8"))
            ids, sizes = self.merge([p.encode("utf-8") for p, special in parts if special < 0])
            ends = iter(np.cumsum(sizes).tolist())
            start, found = 0, []
            for _, special in parts:
                if special >= 0:
                    found.append([special])
                else:
                    stop = next(ends)
                    found.append(ids[start:stop])
                    start = stop
            values += found
            lengths.append(sum(map(len, found)))
        return np.concatenate([np.zeros(0, dtype=np.int64), *values]), np.array(lengths, dtype=np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[bytes, int] = {}
        rows = np.array([number.setdefault(p, len(number)) for p in pieces], dtype=np.int64)
        distinct, ids = list(number), []
        for first in range(0, len(distinct), PIECES_AT_ONCE):
            ids += apply_merges(self.model, distinct[first : first + PIECES_AT_ONCE])
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        flat = np.array([i for some in ids for i in some], dtype=np.int64)
        return flat[ragged((np.cumsum(sizes) - sizes)[rows], sizes[rows])], sizes[rows]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.sequences(texts)


class Decoder:
    """Texts of ids: the bytes of all ids, read as UTF-8 with U+FFFD for what is not."""

    def __init__(self, model: BpeModel):
        self.lengths = np.array([len(p) for p in model.pieces], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(model.pieces), dtype=np.uint8)

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        raw = self.data[ragged(self.starts[ids], lengths)].tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def coders(key: int, text: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a vocabulary, built once per worker."""

    def build() -> tuple[Encoder, Decoder]:
        model = BpeModel(text)
        return Encoder(model), Decoder(model)

    return held_in_worker(("bpe", key), build)


def encode_decode(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids`` (array of int) of each whole text and ``decoded``, the text of these ids.

    ``vocabulary`` is the path of a tokenizer file on the driver; tasks get its content by broadcast, which is as
    large as the file. Special tokens that a text spells out get their own ids. A null text counts as empty and
    gives no ids; repeated rows each get theirs; an empty table gives no rows; columns of these two names are
    replaced.
    """
    with open(vocabulary, encoding="utf-8") as source:
        shared = df.sparkSession.sparkContext.broadcast(source.read())
    key = hash(shared.value)

    def make():
        encode, decode = coders(key, shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, offsets = encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            return [lists, pa.array(decode(ids, offsets), pa.string())]

        return work

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()), True), T.StructField("decoded", T.StringType(), True)]
    return append_columns(df, text_col, make, fields, keep)
