"""Quality of whole texts: random-indexing word vectors, pooled per text, and a small network with calibrated odds.

Every word has a fixed random index vector. The vector of a word is the sum of the index vectors around all its
occurrences in the whole table, so words that stand in the same company point the same way; sums of whole numbers
don't depend on how the table is divided. A text is the mean of its words' vectors, and a two-layer network
fitted on a bounded sample of labelled texts maps it to a probability, which a temperature calibrates.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.columns import append_columns, held_in_worker, quoted, slices
from vitrine.llm.units import LatinCut, MixedTexts, UnitCache, sums
from vitrine.session import ship_package, stage

#: Words beyond the vocabulary share the vectors of their shape, in so many groups by hash: seven shapes (lower
#: case, title, upper case, mixed, digits, marks, other).
GROUPS = 64
SHAPED = 7 * GROUPS
_TOKENS = regex.compile(r"[\p{L}\p{M}']+|\p{N}+|[^\s\p{L}\p{M}\p{N}']+")


@dataclass
class Settings:
    """``sample_rows`` bounds the labelled texts that are learnt from, ``vocabulary`` the words with own vectors."""

    sample_rows: int = 8000
    vocabulary: int = 4096
    dimensions: int = 64
    window: int = 2
    hidden: int = 32
    epochs: int = 60
    rate: float = 0.01
    seed: int = 7


@dataclass
class Model:
    words: list[str]
    vectors: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def shaped(word: str) -> int:
    """The row of a word beyond the vocabulary."""
    return _shape(word) * GROUPS + zlib.crc32(word.encode("utf-8")) % GROUPS


def _shape(word: str) -> int:
    if word.isalpha():
        if word.islower():
            return 0
        if word.isupper() and len(word) > 1:
            return 2
        return 1 if word.istitle() else 3
    if word.isdigit():
        return 4
    return 5 if not any(c.isalnum() for c in word) else 6


class Words:
    """Numbers of the words of texts: shaped rows first, then the vocabulary."""

    def __init__(self, vocabulary: list[str]):
        self.number = {w: SHAPED + i for i, w in enumerate(vocabulary)}
        plain = UnitCache(self.encode_plain, LatinCut(), max_units=300_000)
        self.sequences = MixedTexts(plain, UnitCache(self.encode, max_units=50_000)).sequences

    def encode_plain(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self._of(u.decode("utf-8")) for u in units], dtype=np.int32), np.ones(len(units), dtype=np.int64)

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [_TOKENS.findall(u.decode("utf-8")) for u in units]
        return np.array([self._of(w) for some in found for w in some], dtype=np.int32), np.array([len(s) for s in found], dtype=np.int64)

    def _of(self, word: str) -> int:
        held = self.number.get(word)
        return shaped(word) if held is None else held


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """``word`` and ``n`` over all texts."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in _TOKENS.findall(text):
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) > 300_000:
                yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return _texts(df, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def index_vectors(rows: int, dimensions: int, seed: int) -> np.ndarray:
    """Sparse random vectors: a sixth of the places hold 1 or -1."""
    draw = np.random.default_rng(seed).integers(0, 12, size=(rows, dimensions))
    return ((draw == 0).astype(np.int64) - (draw == 1)).astype(np.float32)


def word_vectors(df: DataFrame, vocabulary: list[str], settings: Settings, text_col: str) -> np.ndarray:
    """Vectors of the shaped rows and the vocabulary from their company in all texts of ``df``."""
    ship_package(df.sparkSession)
    rows = SHAPED + len(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    dimensions, window, seed = settings.dimensions, settings.window, settings.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        index = index_vectors(rows, dimensions, seed)
        total = np.zeros((rows, dimensions), dtype=np.int64)
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                ids, offsets = words.sequences(batch.column(0).slice(start, stop - start))
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                pairs = []
                for step in range(1, window + 1):
                    near = owner[step:] == owner[:-step]
                    pairs.append((ids[step:].astype(np.int64) * rows + ids[:-step])[near])
                codes, n = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                for codes_, by in ((codes, codes % rows), (codes, codes // rows)):
                    order = np.argsort(by, kind="stable")
                    other = (codes_ // rows + codes_ % rows - by)[order]
                    mine = by[order]
                    firsts = np.flatnonzero(np.diff(mine, prepend=-1))
                    for a, b in zip(range(0, len(firsts), 32), range(32, len(firsts) + 32, 32)):
                        low = firsts[a]
                        high = firsts[b] if b < len(firsts) else len(mine)
                        part = index[other[low:high]] * n[order[low:high], None].astype(np.float64)
                        total[mine[firsts[a:b]]] += np.add.reduceat(part, firsts[a:b] - low, axis=0).astype(np.int64)
        used = np.flatnonzero(total.any(axis=1))
        flat = pa.array(total[used].ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * dimensions), flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), lists], names=["word", "company"])

    parts = _texts(df, text_col).mapInArrow(run, "word long, company array<long>")
    summed = parts.groupBy("word").agg(F.array(*[F.sum(F.col("company")[i]) for i in range(dimensions)]).alias("company"))
    vectors = np.zeros((rows, dimensions), dtype=np.float64)
    for row in summed.collect():  # one row per word of the vocabulary
        vectors[row.word] = row.company
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(norms, 1e-9)).astype(np.float32)


class Pooler:
    """Mean and spread of the word vectors of texts, how alike neighbours are, and the log of the length."""

    def __init__(self, words: list[str], vectors: np.ndarray):
        self.words, self.vectors = Words(words), vectors

    def __call__(self, texts: pa.Array) -> np.ndarray:
        ids, offsets = self.words.sequences(texts)
        size = self.vectors.shape[1]
        out = np.zeros((len(texts), 2 * size + 3))
        n = np.diff(offsets)
        step = 50_000
        for first in range(0, len(ids), step):  # a long text is added up in parts
            last = min(first + step, len(ids))
            bounds = np.clip(offsets, first, last) - first
            vectors = self.vectors[ids[first:last]]
            out[:, :size] += sums(vectors, bounds)
            out[:, size : 2 * size] += sums(vectors**2, bounds)
            # Cosine with the word before; the first word of a text has none.
            before = ids[np.maximum(np.arange(first, last) - 1, 0)]
            cosine = np.einsum("ij,ij->i", vectors, self.vectors[before])
            same = (before == ids[first:last]).astype(np.float64)
            inner = np.ones(last - first, dtype=bool)
            begins = offsets[:-1][(offsets[:-1] >= first) & (offsets[:-1] < last)] - first
            inner[begins] = False
            out[:, -3] += sums(cosine * inner, bounds)
            out[:, -2] += sums(same * inner, bounds)
        out[:, :-1] /= np.maximum(n, 1)[:, None]
        out[:, size : 2 * size] = np.sqrt(np.maximum(out[:, size : 2 * size] - out[:, :size] ** 2, 0))
        out[:, -1] = np.log1p(n)
        return out


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    mean, scale, w1, b1, w2, b2 = layers
    hidden = np.tanh(((x - mean) / scale) @ w1 + b1)
    return hidden, hidden @ w2 + b2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_network(x: np.ndarray, y: np.ndarray, settings: Settings) -> tuple[list[np.ndarray], float]:
    """Weights of the network by Adam on four fifths of the rows, and the temperature by the last fifth."""
    random = np.random.default_rng(settings.seed)
    order = random.permutation(len(x))
    held = order[: len(x) // 5] if len(x) >= 50 else order
    used = order[len(x) // 5 :] if len(x) >= 50 else order
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    w1 = random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], settings.hidden))
    layers = [mean, scale, w1, np.zeros(settings.hidden), random.normal(0, 0.1, settings.hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    step = 0
    z = (x - mean) / scale
    for _ in range(settings.epochs):
        for batch in np.array_split(random.permutation(used), max(1, len(used) // 128)):
            hidden, out = _forward(x[batch], layers)
            error = (_sigmoid(out) - y[batch]) / len(batch)
            back = np.outer(error, layers[4]) * (1 - hidden**2)
            grads = {2: z[batch].T @ back, 3: back.sum(axis=0), 4: hidden.T @ error, 5: np.array([error.sum()])}
            step += 1
            for i, g in grads.items():
                g = g + 1e-4 * layers[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                layers[i] = layers[i] - settings.rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    logits = _forward(x[held], layers)[1]
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    # Targets keep a little doubt for the number of rows, else separable rows would make every score certain.
    ones = y[held].sum()
    target = np.where(y[held] > 0, (ones + 1) / (ones + 2), 1 / (len(held) - ones + 2))
    losses = [np.mean(np.logaddexp(0, logits / t) - target * logits / t) for t in choices]
    return layers, float(choices[int(np.argmin(losses))])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", settings: Settings | None = None) -> Model:
    """A model of the texts of ``df`` that ``labels`` (``id_col``, ``label_col``: 0 or 1) marks.

    Labels are learnt from at most ``settings.sample_rows`` of their rows, those with the smallest hash of the id;
    word vectors come from all texts of ``df``. Without a usable label every text scores one half.
    """
    settings = settings or Settings()
    marked = labels.where(F.col(quoted(label_col)).isin(0, 1)).select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(label_col)).alias("__label"))
    chosen = stage(marked.orderBy(F.xxhash64("__id"), "__id", "__label").limit(settings.sample_rows))
    own = df.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("text"))
    sample = stage(own.join(F.broadcast(chosen), "__id"))  # at most sample_rows ids
    counts = count_words(sample, "text").orderBy(F.desc("n"), "word").limit(settings.vocabulary).collect()
    vocabulary = [r.word for r in counts]
    model = Model(vocabulary, word_vectors(df, vocabulary, settings, text_col))
    rows = _pooled(sample, model).toPandas()
    if rows.empty:
        return model
    rows = rows.sort_values(["__id", "__label"], kind="stable")
    model.layers, model.temperature = fit_network(np.array(rows["pooled"].tolist()), rows["__label"].to_numpy(dtype=np.float64), settings)
    return model


def _pooled(sample: DataFrame, model: Model) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def make():
        pool = Pooler(shared.value.words, shared.value.vectors)

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = pool(texts)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * rows.shape[1]
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))]

        return work

    return append_columns(sample, "text", make, [T.StructField("pooled", T.ArrayType(T.DoubleType()), True)], ["__id", "__label"])


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``score``, the probability of label 1 for each whole text, and ``predicted`` (1 from ``threshold`` on).

    A null text is an empty one, whose pooled vector is zero; repeated rows score alike; an empty table gives no
    rows; columns of these two names are replaced. The broadcast model is bounded by its settings.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value
        pool = held_in_worker(held.key, lambda: Pooler(held.words, held.vectors))

        def work(texts: pa.Array) -> list[pa.Array]:
            if held.layers:
                odds = _sigmoid(_forward(pool(texts), held.layers)[1] / held.temperature)
            else:
                odds = np.full(len(texts), 0.5)
            return [pa.array(odds, pa.float64()), pa.array((odds >= threshold).astype(np.int32))]

        return work

    fields = [T.StructField("score", T.DoubleType(), True), T.StructField("predicted", T.IntegerType(), True)]
    return append_columns(df, text_col, make, fields, keep)
