"""Token ids of whole texts under a word-level byte-pair vocabulary, for packing.

Distinct lower-cased pieces are merged together in rounds: each round merges the lowest pair of every piece.
Whatever is not plain Latin text goes to the tokenizer library itself, unit by unit.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from vitrine.llm.bpe import BpeModel
from vitrine.llm.columns import held_in_worker
from vitrine.llm.units import LatinCut, MixedTexts, UnitCache, ragged, sums

_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
#: No other characters, and nothing that may begin a special token.
_PLAIN = re.compile("(?:[\x00-;=-\x7f\xa1-ÿ]|<(?!\\|))*")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\t-\r {_LETTERS}{_DIGITS}]+")
_NONE = np.int64(1 << 40)


class PairTable:
    """Rank of a pair by open addressing."""

    def __init__(self, ranks: dict[int, int], bits: int = 19):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.codes = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, _NONE, dtype=np.int64)
        codes = np.fromiter(ranks, dtype=np.int64, count=len(ranks))
        values = np.fromiter(ranks.values(), dtype=np.int64, count=len(ranks))
        for at, code, rank in zip(self._places(codes).tolist(), codes.tolist(), values.tolist()):
            while self.codes[at] >= 0:
                at = (at + 1) & self.mask
            self.codes[at], self.ranks[at] = code, rank

    def _places(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self._places(codes)
        held = self.codes[at]
        out = np.where(held == codes, self.ranks[at], _NONE)
        open_ = np.flatnonzero((held != codes) & (held >= 0))
        while len(open_):
            at = (at if len(at) == len(open_) else at[open_]) + 1 & self.mask
            held, wanted = self.codes[at], codes[open_]
            hit = held == wanted
            out[open_[hit]] = self.ranks[at[hit]]
            left = ~hit & (held >= 0)
            open_, at = open_[left], at[left]
        return out


class WordTokens:
    """``sequences(texts)`` gives the ids of all texts and their offsets."""

    def __init__(self, text: str):
        self.text, self._library = text, None
        model = BpeModel(text)
        self.table = PairTable(model.ranks)
        self.merged = np.array([m for _, _, m in model.rules], dtype=np.int64)
        self.bytes = model.byte_ids
        names = {i: t for t, i in model.ids.items()}
        self.last = np.array([model.ids[names[i] + model.suffix] for i in model.byte_ids.tolist()], dtype=np.int64)
        plain = UnitCache(self.encode_plain, LatinCut(lower=True, digits=True))
        self.sequences = MixedTexts(plain, UnitCache(self.encode_units, max_units=100_000), b"<|").sequences

    @property
    def library(self):
        """The tokenizer library's own, for what isn't plain Latin text; loaded when first needed."""
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.text)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        symbols = self.bytes[raw]
        symbols[np.cumsum(lengths) - 1] = self.last[raw[np.cumsum(lengths) - 1]]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            inner = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inner] = self.table(symbols[inner] << 24 | symbols[inner + 1])
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            lowest = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
            busy = lowest < _NONE
            if not busy.all():
                done.append((owner[~busy], symbols[~busy]))
                owner, symbols, rank, lowest = owner[busy], symbols[busy], rank[busy], lowest[busy]
            hit = rank == lowest
            chained = hit.copy()
            chained[1:] &= hit[:-1]
            if chained.any():  # overlapping pairs merge from the left
                at = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~chained, at, 0))
                hit &= (at - begin) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.zeros(0, dtype=np.int64), lengths
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        return np.concatenate([s for _, s in done])[order], np.bincount(owners, minlength=len(pieces))

    def encode_plain(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Units are pieces, but for those with an apostrophe."""
        held = [i for i, u in enumerate(units) if b"'" in u]
        if not held:
            return self.merge(units)
        pieces, counts = [[u] for u in units], np.ones(len(units), dtype=np.int64)
        for i in held:
            pieces[i] = [p.encode("utf-8") for p in _PIECES.findall(units[i].decode("utf-8"))]
            counts[i] = len(pieces[i])
        ids, sizes = self.merge([p for some in pieces for p in some])
        return ids, sums(sizes, np.concatenate([[0], np.cumsum(counts)]))

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        others: list[str] = []
        rows: list[int] = []  # the pieces of all units; a unit for the library is -1, -2, ...
        counts = []
        for unit in units:
            text = unit.decode("utf-8")
            before = len(rows)
            if _PLAIN.fullmatch(text):
                rows += [number.setdefault(piece, len(number)) for piece in _PIECES.findall(text.lower())]
            else:
                others.append(text)
                rows.append(-len(others))
            counts.append(len(rows) - before)
        ids, sizes = self.merge([p.encode("utf-8") for p in number]) if number else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if others:
            more = [e.ids for e in self.library.encode_batch(others[::-1], add_special_tokens=False)]
            ids = np.concatenate([ids, *[np.array(m, dtype=np.int64) for m in more]])
            sizes = np.concatenate([sizes, [len(m) for m in more]]).astype(np.int64)
        which = np.array(rows, dtype=np.int64)  # -1 is the last of the list, as the library's units stand reversed
        starts = np.cumsum(sizes) - sizes
        each = sizes[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        bounds = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return ids[ragged(starts[which], each)].astype(np.int32), np.diff(bounds)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.sequences(texts)


def word_tokens(key: int, text: str) -> WordTokens:
    """The tokens of a vocabulary, built once per worker."""
    return held_in_worker(("words", key), lambda: WordTokens(text))
