"""URL filter: rules first, then the ratio of two character language models.

Whole URLs that rules accept or reject train one smoothed variable-order Markov model each. Where no rule fits, the
difference of the log-likelihoods per character, calibrated on URLs that were kept out of the models, decides.

The counts of all contexts stay a table. What a place of a text adds to the difference depends on its gram alone, the
byte and the ``ORDER`` bytes before it; so the distinct grams of the texts are rated order by order, by joins with the
counts in which a key meets no more rows than there are bytes, and each text sums the rates of its grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.columns import fresh, quoted, slices
from vitrine.llm.units import ragged, text_bytes
from vitrine.session import ship_package, stage

ORDER = 5
#: Most continuations of contexts that a model of ``train`` holds; ``judge`` has no such bound.
CAPACITY = 400_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in how many URLs is kept out of the models, and the steps in which their differences are counted.
_HELD_OUT, _STEPS = 5, 64
#: Bits of a byte in a gram (0: before and after the text), and the unit in which rates are summed exactly.
_SYMBOL, _UNIT = 9, 1e-9
#: Texts that meet one copy of a gram's rate; a gram of more texts has as many copies as they need.
TEXTS_OF_COPY = 20_000


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (``verdict``, ``rule``), or null.

    A rule (verdict, host and path) fits its host and the hosts below it where the path starts with its own. The
    list is part of the query; of equally long rules the first stands.
    """
    fitting = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        name = name.translate(str.maketrans(_UPPER, _LOWER))
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        fitting.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    none = F.lit(None).cast("struct<verdict:string,rule:string>")
    return F.coalesce(*fitting, none)


def _contexts(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For orders 0 to ``ORDER`` the hashes of context and of context with the next byte at every place, and the
    offsets of the texts. A text begins after ``ORDER`` blanks and ends with one more."""
    data, offsets = text_bytes(texts)
    lengths = np.diff(offsets) + 1
    ends = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.zeros(int(ends[-1]) + ORDER * len(lengths), dtype=np.uint64)
    begins = ends[:-1] + ORDER * np.arange(1, len(lengths) + 1)
    flat[ragged(begins, lengths - 1)] = data.astype(np.uint64) + np.uint64(1)
    at = ragged(begins, lengths)
    out, context = [], np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for order in range(ORDER + 1):
            if order:
                context = (context ^ flat[at - order]) * np.uint64(0x9E3779B97F4A7C15)
                context ^= context >> np.uint64(29)
            mine = context + np.uint64(order)
            both = (mine ^ (flat[at] << np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mine.view(np.int64), (both ^ (both >> np.uint64(31))).view(np.int64)))
    return out, ends


def count_contexts(df: DataFrame) -> DataFrame:
    """``verdict``, ``context``, ``code`` and ``n`` of the columns ``verdict`` and ``text``."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1), 1 << 20):
                part = batch.slice(start, stop - start)
                verdicts = np.array(part.column(0).to_pylist(), dtype=object)
                for verdict in sorted(set(verdicts)):
                    levels, _ = _contexts(part.column(1).filter(pa.array(verdicts == verdict)))
                    context, code = (np.concatenate(x) for x in zip(*levels))
                    distinct, first, n = np.unique(code, return_index=True, return_counts=True)
                    names = pa.array([verdict] * len(n), pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(context[first]), pa.array(distinct), pa.array(n)], names=["verdict", "context", "code", "n"])

    counted = df.select("verdict", "text").mapInArrow(run, "verdict string, context long, code long, n long")
    return counted.groupBy("verdict", "context", "code").agg(F.sum("n").alias("n"))


class Markov:
    """A model with the smoothing of Witten and Bell: each context leaves as much to the shorter one as it has
    different continuations."""

    def __init__(self, contexts: np.ndarray, codes: np.ndarray, n: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.n = codes[order], n[order]
        self.contexts, inverse = np.unique(contexts, return_inverse=True)
        self.total = np.bincount(inverse, weights=n, minlength=len(self.contexts))
        self.kinds = np.bincount(inverse, minlength=len(self.contexts)).astype(np.float64)

    def logs(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log-probability of the byte at every place."""
        p = np.full(len(levels[0][0]), 1 / 257)
        for context, code in levels:
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            seen = self.contexts[at] == context
            found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            n = np.where(self.codes[found] == code, self.n[found], 0)
            p = np.where(seen, (n + self.kinds[at] * p) / (self.total[at] + self.kinds[at]), p)
        return np.log(p)


def train(df: DataFrame, capacity: int = CAPACITY) -> dict[str, Markov]:
    """Models of the verdicts ``allow`` and ``block`` from the columns ``verdict`` and ``text`` of all rows.

    All contexts are counted; the most frequent ``capacity`` continuations of each verdict come to the driver.
    """
    counts = stage(count_contexts(df))
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy("verdict", level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
    models = {}
    for verdict in sorted({r.verdict for r in levels}):
        least, held = None, 0
        for r in sorted((r for r in levels if r.verdict == verdict), key=lambda r: -r.level):
            held += r.rows
            if held > capacity:
                break
            least = r.level
        if least is not None:
            rows = counts.where((F.col("verdict") == verdict) & (level >= least)).select("context", "code", "n").toArrow()
            models[verdict] = Markov(*(rows[c].to_numpy() for c in ("context", "code", "n")))
    return models


def grams_of(df: DataFrame) -> DataFrame:
    """The grams of ``text`` and their number ``n``, next to the other columns; one more row than ``text`` has bytes
    if all are different."""
    ship_package(df.sparkSession)
    others = [c for c in df.columns if c != "text"]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("text"), 1 << 20):
                part = batch.slice(start, stop - start)
                data, offsets = text_bytes(part.column("text"))
                lengths = np.diff(offsets) + 1
                ends = np.concatenate([[0], np.cumsum(lengths)])
                flat = np.zeros(int(ends[-1]) + ORDER * len(lengths), dtype=np.int64)
                begins = ends[:-1] + ORDER * np.arange(1, len(lengths) + 1)
                flat[ragged(begins, lengths - 1)] = data.astype(np.int64) + 1
                at = ragged(begins, lengths)
                gram = sum(flat[at - order] << (_SYMBOL * order) for order in range(ORDER + 1))
                row = np.repeat(np.arange(len(lengths)), lengths)
                by = np.lexsort((gram, row))
                gram, row = gram[by], row[by]
                first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])))
                n = np.diff(np.append(first, len(gram)))
                kept = [part.column(c).take(pa.array(row[first])) for c in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(gram[first]), pa.array(n)], names=[*others, "gram", "n"])

    return df.mapInArrow(run, schema)


def rated(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """``gram`` and ``rate`` of the distinct ``grams``: log-probability of the last byte under ``allow`` less that
    under ``block``, with the smoothing of ``Markov``; ``counts`` has ``gram``, ``allow`` and ``block``."""
    sides, shorter = ("allow", "block"), None
    for order in range(ORDER + 1):
        gram = F.col("gram").bitwiseAND((1 << (_SYMBOL * (order + 1))) - 1)
        suffix = F.col("gram").bitwiseAND((1 << (_SYMBOL * order)) - 1)
        mine = counts.groupBy(gram.alias("gram")).agg(*[F.sum(s).alias(s) for s in sides])
        contexts = mine.groupBy(F.shiftright("gram", _SYMBOL).alias("context")).agg(
            *[F.sum(s).alias(f"{s}_total") for s in sides], *[F.count_if(F.col(s) > 0).cast("double").alias(f"{s}_kinds") for s in sides]
        )
        asked = grams.select(gram.alias("gram")).distinct().withColumn("context", F.shiftright("gram", _SYMBOL)).withColumn("suffix", suffix)
        found = asked.join(mine, "gram", "left").join(contexts, "context", "left")
        if shorter is None:
            found = found.select("*", *[F.lit(1 / 257).alias(f"{s}_p") for s in sides])
        else:
            found = found.join(shorter.withColumnRenamed("gram", "suffix"), "suffix")
        p = [
            F.when(F.col(f"{s}_total") > 0, (F.coalesce(s, F.lit(0)) + F.col(f"{s}_kinds") * F.col(f"{s}_p")) / (F.col(f"{s}_total") + F.col(f"{s}_kinds")))
            .otherwise(F.col(f"{s}_p")).alias(f"{s}_p")
            for s in sides
        ]
        shorter = stage(found.select("gram", *p))
    return shorter.select("gram", (F.log("allow_p") - F.log("block_p")).alias("rate"))


def text_differences(texts: DataFrame) -> DataFrame:
    """``difference`` of the distinct ``texts`` with ``verdict``, ``out`` and ``n``, how often each is there.

    Texts with a verdict that are not ``out`` train the models, as often as they are there.
    """
    texts = stage(texts.withColumn("id", F.monotonically_increasing_id()))
    weight = lambda side: F.when((F.col("verdict") == side) & ~F.col("out"), F.col("n")).otherwise(0).alias(side)
    grams = stage(grams_of(texts.select("id", weight("allow"), weight("block"), "text")))
    learnt = grams.where("allow > 0 OR block > 0")
    counts = stage(learnt.groupBy("gram").agg(*[F.sum(F.col("n") * F.col(s)).alias(s) for s in ("allow", "block")]))
    held = counts.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    if not held.allow or not held.block:
        return texts.select("text", "verdict", "out", "n", F.lit(0.0).alias("difference"))
    distinct = stage(grams.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / TEXTS_OF_COPY).cast("int").alias("copies")))
    hot = stage(distinct.where("copies > 1").withColumnRenamed("copies", "dealt"))
    rates = rated(distinct.select("gram"), counts).join(distinct, "gram").select(
        "gram", F.round(F.col("rate") / _UNIT).cast("long").alias("rate"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")
    )
    dealt = grams.join(hot, "gram", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("dealt", F.lit(1))).cast("int"))
    each = dealt.join(rates, ["gram", "salt"])
    total = each.groupBy("id").agg((F.sum(F.col("n") * F.col("rate")) * _UNIT / F.sum("n")).alias("difference"))
    return texts.join(total, "id").select("text", "verdict", "out", "n", "difference")


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset of the log-odds of ``allow`` by ``difference`` of ``n`` rows each, both verdicts weighing the same.

    Only counts per step of the difference, which is bounded by the models, come to the driver.
    """
    step = F.floor(F.col("difference") * _STEPS).cast("int")
    rows = scored.groupBy("verdict", step.alias("step")).agg(F.sum("n").alias("n")).collect()
    x = np.array([(r.step + 0.5) / _STEPS for r in rows])
    y = np.array([r.verdict == "allow" for r in rows], dtype=np.float64)
    n = np.array([r.n for r in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    for side in (0.0, 1.0):
        n[y == side] /= n[y == side].sum()
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps on the weighted logistic loss with a small ridge
        p = 0.5 * (1 + np.tanh(0.5 * (slope * x + offset)))
        gradient = np.array([(n * (p - y) * x).sum() + 1e-3 * slope, (n * (p - y)).sum() + 1e-6 * offset])
        weight = n * p * (1 - p)
        curve = np.array([[(weight * x * x).sum() + 1e-3, (weight * x).sum()], [(weight * x).sum(), weight.sum() + 1e-6]])
        move = np.linalg.solve(curve, gradient)
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(slope), float(offset)


def judge(df: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every URL.

    ``rules`` are pairs of ``allow`` or ``block`` and host with path. ``score`` is the calibrated probability of
    ``allow`` by the models, which read the whole URL; it decides from ``threshold`` on where no rule fits, so also for null and empty URLs.
    With URLs of one verdict only there is nothing to compare and scores are one half. Repeated rows are judged
    alike, an empty table gives no rows, columns of these names are replaced.
    """
    new = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in (keep or df.columns) if c.lower() not in new]
    names = ("host", "path", "rule", "text", "found_text", "found_verdict", "difference")
    host, path, rule, text, found_text, found_verdict, difference = (fresh(f"__url_{n}", df.columns) for n in names)
    rows = df.select(*[F.col(quoted(c)) for c in kept], host_of(F.col(quoted(url_col))).alias(host), path_of(F.col(quoted(url_col))).alias(path), F.coalesce(F.col(quoted(url_col)), F.lit("")).alias(text))
    rows = rows.withColumn(rule, rule_for(F.col(host), F.col(path), rules))
    verdict = F.col(f"{rule}.verdict")
    out = F.pmod(F.xxhash64("text"), F.lit(_HELD_OUT)) == 0
    texts = rows.groupBy(F.col(text).alias("text"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n")).withColumn("out", out)
    found = stage(text_differences(texts))
    slope, offset = calibrate(found.where(F.col("verdict").isNotNull() & F.col("out")))
    same = (F.col(text) == F.col(found_text)) & verdict.eqNullSafe(F.col(found_verdict))
    scored = rows.join(found.select(F.col("text").alias(found_text), F.col("verdict").alias(found_verdict), F.col("difference").alias(difference)), same)
    score = 1 / (1 + F.exp(-(F.col(difference) * slope + offset)))
    own = F.when(score >= threshold, "allow").otherwise("block")
    return scored.select(
        *[F.col(quoted(c)) for c in kept], F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{rule}.rule").alias("rule"),
        F.coalesce(F.col(f"{rule}.verdict"), own).alias("verdict"), score.alias("score"),
    )
