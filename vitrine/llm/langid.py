"""Language of whole texts: words first, then ever shorter character n-grams.

A known word scores by its log frequency in each language. An unknown one falls back to the longest n-grams of it
that are known, four characters first, then three, two and one.

The counts of all words and of all n-grams in them are tables. The most frequent words are broadcast, which settles
most of a text in one pass; its other words are rated once for all texts by joins with the tables, so every word counts
whatever the table's size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.columns import fresh, held_in_worker, quoted, release, slices
from vitrine.llm.units import LatinCut, MixedTexts, UnitCache, sums
from vitrine.session import ship_package, stage

ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
#: Most (language, word) pairs that are broadcast; the others are joined. It decides where a word is looked up, not its score.
CAPACITY = 250_000
#: Most n-grams that are broadcast to rate unknown words; more of them are joined, longest first.
GRAM_CAPACITY = 500_000
#: Distinct words that a counting task holds before it hands on its counts.
_HELD = 300_000
_SMOOTHING = 0.5


def words_of(unit: bytes) -> list[str]:
    """Runs of letters in lower case."""
    return regex.findall(r"\p{L}+", unit.decode("utf-8").lower())


def gram_codes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of the words between blanks, and how many each word has.

    A code holds 16 bits of each character.
    """
    text = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64) & np.uint64(0xFFFF)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    counts = np.maximum(lengths - order + 1, 0)
    starts = np.cumsum(lengths) - lengths
    ends = np.cumsum(counts)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
    codes = np.zeros(len(at), dtype=np.uint64)
    for i in range(order):
        codes = codes << np.uint64(16) | text[at + i]
    return codes.view(np.int64), counts


def count_words(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``lang``, ``word`` and their number ``n`` over all rows with a language, in parts that are still to be added up."""
    ship_package(df.sparkSession)
    source = df.where(F.col(quoted(lang_col)).isNotNull()).select(
        F.col(quoted(lang_col)).cast("string").alias("lang"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        number: dict[str, int] = {}

        def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, counts = [], []
            for unit in units:
                found = words_of(unit)
                for word in found:
                    if word not in number:
                        number[word] = len(names)
                        names.append(word)
                    ids.append(number[word])
                counts.append(len(found))
            return np.array(ids, dtype=np.int32), np.array(counts, dtype=np.int64)

        caches = UnitCache(encode, LatinCut(lower=True, letters=True)), UnitCache(encode)
        texts_of = MixedTexts(*caches).sequences
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, held in counts.items():
                seen = np.flatnonzero(held)
                words = pa.array([names[i] for i in seen.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), words, pa.array(held[seen])], names=["lang", "word", "n"])
            counts.clear()
            names.clear()
            number.clear()
            for cache in caches:
                cache.clear()

        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                langs = np.array(part.column(0).to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    ids, _ = texts_of(part.column(1).filter(pa.array(langs == lang)))
                    found = np.bincount(ids, minlength=len(names)) if len(ids) else np.zeros(len(names), dtype=np.int64)
                    held = counts.get(lang, np.zeros(0, dtype=np.int64))
                    total = np.zeros(max(len(found), len(held)), dtype=np.int64)
                    total[: len(held)] += held
                    total[: len(found)] += found
                    counts[lang] = total
                if len(names) > _HELD:
                    yield from flush()
        yield from flush()

    return source.mapInArrow(run, "lang string, word string, n long")


@dataclass
class Model:
    """Counts per language: ``words(word, n)`` and ``grams(level, code, n)``, where ``n`` has a number for each language.

    ``totals[0]`` and ``kinds[0]`` are the words of each language and the distinct words of all, ``totals[k]`` and
    ``kinds[k]`` those of the n-grams of ``k`` characters. ``top`` holds the scores of the most frequent words.
    """

    languages: list[str]
    words: DataFrame
    grams: DataFrame
    totals: dict[int, list[int]]
    kinds: dict[int, int]
    top: tuple[list[str], np.ndarray]


def count_grams(words: DataFrame, n_languages: int) -> DataFrame:
    """``level, code, n`` of the n-grams of all words, each word counting as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n = batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, n_languages)
            for order in ORDERS:
                codes, each = gram_codes(names, order)
                sort = np.argsort(codes, kind="stable")
                codes, rows = codes[sort], np.repeat(np.arange(len(names)), each)[sort]
                begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, dtype=np.int64)
                added = np.add.reduceat(n[rows], begin, axis=0) if len(codes) else n[:0]
                columns = [pa.array(np.full(len(begin), order, dtype=np.int32)), pa.array(codes[begin]), *[pa.array(added[:, i]) for i in range(n_languages)]]
                yield pa.RecordBatch.from_arrays(columns, names=["level", "code", *[f"n{i}" for i in range(n_languages)]])

    parts = words.select("word", "n").mapInArrow(run, ", ".join(["level int, code long", *[f"n{i} long" for i in range(n_languages)]]))
    return parts.groupBy("level", "code").agg(F.array(*[F.sum(f"n{i}") for i in range(n_languages)]).cast("array<bigint>").alias("n"))


def _score(n, total, kinds):
    """Smoothed log frequency."""
    return F.log((n + F.lit(_SMOOTHING)) / (F.lit(float(total)) + F.lit(_SMOOTHING) * (kinds + 1)))


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", capacity: int = CAPACITY) -> Model:
    """A model of all rows with a language: the counts of all their words and of the n-grams of these words.

    What comes to the driver is one row per language and level of frequency, and at most ``capacity`` of the most
    frequent words.
    """
    languages = sorted(r[0] for r in df.select(F.col(quoted(lang_col)).cast("string")).distinct().collect() if r[0] is not None)
    each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)) for lang in languages]
    words = stage(count_words(df, lang_col, text_col).groupBy("word").agg(F.array(*each).cast("array<bigint>").alias("n")))
    grams = stage(count_grams(words, len(languages)))
    numbers = [F.sum(F.get("n", F.lit(i))) for i in range(len(languages))]
    totals, kinds = {k: [0] * len(languages) for k in (0, *ORDERS)}, dict.fromkeys((0, *ORDERS), 0)
    for k, *row in [(0, *words.agg(F.count(F.lit(1)), *numbers).first()), *grams.groupBy("level").agg(F.count(F.lit(1)), *numbers).collect()]:
        kinds[k], totals[k] = row[0], [x or 0 for x in row[1:]]
    level = F.floor(F.log2(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)) * 8).cast("int")
    least, held = None, 0
    for one in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += one["count"]
        if held > capacity:
            break
        least = one.level
    top = words.where(F.lit(False) if least is None else level >= least).toArrow()
    flat = top["n"].combine_chunks().flatten().to_numpy().reshape(-1, len(languages)) if top.num_rows and languages else np.zeros((0, len(languages)))
    size = np.array(totals[0], dtype=np.float64) + _SMOOTHING * (kinds[0] + 1)
    return Model(languages, words, grams, totals, kinds, (top["word"].to_pylist(), np.log((flat + _SMOOTHING) / size)))


def rate_words(words: DataFrame, model: Model, gram_capacity: int = GRAM_CAPACITY) -> DataFrame:
    """``words(word)`` with ``scores``, one for each language.

    An unknown word has the mean of its n-grams of the longest kind of which the model knows any; without any it is left out.
    The n-grams are broadcast if they are no more than ``gram_capacity``, and joined otherwise.
    """
    n = len(model.languages)
    joined = words.join(model.words, "word", "left")
    known = joined.where(F.col("n").isNotNull()).select("word", F.array(*[_score(F.get("n", F.lit(i)), model.totals[0][i], model.kinds[0]) for i in range(n)]).alias("scores"))
    left = joined.where(F.col("n").isNull()).select("word")
    if sum(model.kinds[k] for k in ORDERS) <= gram_capacity:
        return known.unionByName(_rate_here(left, model))
    left = stage(left)
    for order in ORDERS:
        found = stage(_rate_by_join(left, model, order))
        known, left = known.unionByName(found), left.join(found, "word", "left_anti")
    return known


def _rate_here(words: DataFrame, model: Model) -> DataFrame:
    """Unknown words by n-grams that every task holds."""
    table = model.grams.toArrow()
    level, code = table["level"].to_numpy(), table["code"].to_numpy()
    counts = table["n"].combine_chunks().flatten().to_numpy().reshape(len(code), -1)
    held = {}
    for k in ORDERS:
        rows = np.flatnonzero(level == k)
        rows = rows[np.argsort(code[rows])]
        size = np.array(model.totals[k], dtype=np.float64) + _SMOOTHING * (model.kinds[k] + 1)
        held[k] = code[rows], np.log((counts[rows] + _SMOOTHING) / size)
    shared = words.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            out, left = np.zeros((len(names), len(model_languages))), np.arange(len(names))
            for order in ORDERS:
                known, scores = grams[order]
                if not len(left) or not len(known):
                    continue
                codes, each = gram_codes([names[i] for i in left.tolist()], order)
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = known[at] == codes
                bounds = np.concatenate([[0], np.cumsum(each)])
                hits = sums(hit.astype(np.int64), bounds)
                total = sums(np.where(hit[:, None], scores[at], 0.0), bounds)
                some = hits > 0
                out[left[some]] = total[some] / hits[some, None]
                left = left[~some]
            kept = np.ones(len(names), dtype=bool)
            kept[left] = False
            values = out[kept]
            bounds = np.arange(len(values) + 1, dtype=np.int32) * len(model_languages)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.ravel()))], names=["word", "scores"])

    model_languages = list(model.languages)
    return words.mapInArrow(run, "word string, scores array<double>")


def _rate_by_join(words: DataFrame, model: Model, order: int) -> DataFrame:
    """Unknown words that have a known n-gram of ``order`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, each = gram_codes(batch.column(0).to_pylist(), order)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), each))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(codes)], names=["word", "code"])

    known = model.grams.where(F.col("level") == order).select("code", "n")
    hits = words.mapInArrow(run, "word string, code long").join(known, "code")
    means = [F.avg(_score(F.get("n", F.lit(i)), model.totals[order][i], model.kinds[order])) for i in range(len(model.languages))]
    return hits.groupBy("word").agg(F.array(*means).alias("scores"))


class Reader:
    """Texts as sums of the scores of frequent words, and the other words with their numbers."""

    def __init__(self, top: tuple[list[str], np.ndarray]):
        self.place = {w: i for i, w in enumerate(top[0])}
        self.scores = top[1]
        self.caches = UnitCache(self.encode, LatinCut(lower=True, letters=True)), UnitCache(self.encode, max_units=50_000)
        self.texts = MixedTexts(*self.caches)
        self.names: list[str] = []
        self.number: dict[str, int] = {}

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of frequent words; the others count down from -1."""
        ids, counts = [], []
        for unit in units:
            found = words_of(unit)
            for word in found:
                at = self.place.get(word)
                if at is None:
                    at = self.number.get(word)
                    if at is None:
                        self.names.append(word)
                        at = self.number[word] = -len(self.names)
                ids.append(at)
            counts.append(len(found))
        return np.array(ids, dtype=np.int32), np.array(counts, dtype=np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        """Sums of scores, number of words and the other words of each text."""
        if len(self.names) > _HELD:
            self.names, self.number = [], {}
            for cache in self.caches:
                cache.clear()
        ids, offsets = self.texts.sequences(texts)
        ids = ids.astype(np.int64)
        total = np.zeros((len(texts), self.scores.shape[1]))
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        for first in range(0, len(ids), 500_000):
            part, at = ids[first : first + 500_000], owner[first : first + 500_000]
            seen = part >= 0
            for i in range(total.shape[1]):
                total[:, i] += np.bincount(at[seen], weights=self.scores[part[seen], i], minlength=len(texts))
        rare = np.flatnonzero(ids < 0)
        pairs, n = np.unique(owner[rare] << 32 | (-1 - ids[rare]), return_counts=True)
        bounds = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)).astype(np.int32)
        words = pa.array([self.names[i] for i in (pairs & 0xFFFFFFFF).tolist()], pa.string())
        items = pa.StructArray.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])
        return total, np.diff(offsets), pa.ListArray.from_arrays(pa.array(bounds), items)


def _read(df: DataFrame, model: Model, text_col: str, kept: list[str], names: dict[str, str]) -> DataFrame:
    """The columns ``kept`` with a number, sums of scores, number of words and other words of each row."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.top)
    key = uuid.uuid4().hex
    source = df.select(*[F.col(quoted(c)) for c in kept], F.coalesce(F.col(quoted(text_col)), F.lit("")).alias(names["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = held_in_worker(key, lambda: Reader(shared.value))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, stop in slices(texts):
                total, n, others = read(texts.slice(start, stop - start))
                bounds = np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]
                sums_ = pa.ListArray.from_arrays(pa.array(bounds), pa.array(total.ravel(), pa.float64()))
                columns = [batch.column(i).slice(start, stop - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, sums_, pa.array(n, pa.int64()), others], names=[*kept, names["sums"], names["n"], names["others"]])
        release()

    fields = [T.StructField(names["sums"], T.ArrayType(T.DoubleType())), T.StructField(names["n"], T.LongType())]
    others = T.StructField(names["others"], T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])))
    schema = T.StructType([*[source.schema[i] for i in range(len(kept))], *fields, others])
    return source.mapInArrow(run, schema).withColumn(names["row"], F.monotonically_increasing_id())


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (0 to 1) of each whole text.

    The score is the share of the best language in the likelihoods, per square root of the number of words. A
    null text or one without a letter is ``und`` with score 0, and so is every text if the model has seen no
    language; ties go to the first language by name; repeated rows get equal results; an empty table gives no
    rows; columns of these two names are replaced. The rows are written once to the shared folder with the sums
    of their frequent words.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    columns = [F.col(quoted(c)) for c in kept]
    if not model.languages:
        return df.select(*columns, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names: dict[str, str] = {}
    for name in ("text", "sums", "n", "others", "row", "total", "odds"):
        names[name] = fresh(f"__lang_{name}", [*kept, *names.values()])
    read = stage(_read(df, model, text_col, kept, names))
    places = range(len(model.languages))
    others = read.select(F.col(names["row"]).alias("row"), F.inline(names["others"]))
    # Words that a model does not broadcast are rated once, however many texts hold them.
    rated = stage(rate_words(others.select("word").distinct(), model))
    more = others.join(rated, "word").groupBy("row").agg(F.array(*[F.sum(F.get("scores", F.lit(i)) * F.col("n")) for i in places]).alias("more"))
    rows = read.drop(names["others"]).join(more.withColumnRenamed("row", names["row"]).withColumnRenamed("more", names["total"]), names["row"], "left")
    sums_, extra = F.col(names["sums"]), F.col(names["total"])
    total = F.array(*[(F.get(sums_, F.lit(i)) + F.coalesce(F.get(extra, F.lit(i)), F.lit(0.0))) / F.sqrt(F.greatest(F.col(names["n"]), F.lit(1))) for i in places])
    rows = rows.withColumn(names["total"], total)
    top = F.array_max(names["total"])
    odds = F.aggregate(names["total"], F.lit(0.0), lambda s, x: s + F.exp(x - top))
    seen = F.col(names["n"]) > 0
    best = F.element_at(F.lit(model.languages), F.array_position(names["total"], top).cast("int"))
    return rows.select(*columns, F.when(seen, best).otherwise(UNKNOWN).alias("lang_pred"), F.when(seen, 1 / odds).otherwise(0.0).alias("score"))
