"""Repeated passages of lines by content-defined chunks, in DataFrame expressions.

A rolling hash over the hashes of two neighbouring lines is taken at every line. Where it is no larger than the one before
or after it, a chunk of two lines begins: of any two neighbouring hashes the smaller one is chosen, by nothing but the
lines themselves. So every passage of three lines or more has a chunk, the same one wherever it stands, and any two
lines of it are a chunk or stand beside one. Chunks that stand in more than one place are found by their hash and
compared byte by byte, and the match is extended line by line to the passage's edges: two neighbouring lines that
are no chunk stand beside one, and go with it if they too stood before (``remove_passages``).

``remove_repeated`` cuts texts into chunks at rarer boundaries and compares whole chunks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.columns import fresh, quoted
from vitrine.llm.winnow import WORDS
from vitrine.session import stage

#: Lines that decide on a boundary, and one in how many lines ends a chunk.
WINDOW, DIVISOR = 2, 3
#: Fewest lines of a chunk that is removed.
LEAST_LINES = 2
#: Fewest words of a line that is a passage by itself.
LEAST_WORDS = 50
#: Places of one anchor that are compared with its first one in one share.
PLACES_OF_SHARE = 256
_anchor_hash = F.xxhash64
_PRIME, _BASE = (1 << 31) - 1, 1_000_003


def with_chunks(df: DataFrame, text: str, out: str, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """``df`` with the array ``out`` of chunks (``text``, ``n_lines``) of the column ``text``, which join to it by line ends."""
    lines, rolling, starts = (fresh(n, df.columns) for n in ("__lines", "__rolling", "__starts"))
    df = df.withColumn(lines, F.split(F.coalesce(F.col(quoted(text)), F.lit("")), "\n", -1))
    hashes = fresh("__hashes", df.columns)
    df = df.withColumn(hashes, F.transform(lines, lambda line: F.pmod(F.xxhash64(line), F.lit(_PRIME))))
    df = df.withColumn(rolling, F.col(hashes))
    for step in range(1, window):  # at line i: the polynomial of the lines i - step to i; the first lines have fewer
        none = F.array_repeat(F.lit(0).cast("long"), step)
        earlier = F.slice(F.concat(none, F.col(hashes)), 1, F.size(hashes))
        df = df.withColumn(rolling, F.zip_with(rolling, earlier, lambda h, e: (h + e * pow(_BASE, step, _PRIME)) % _PRIME))
    # A chunk starts at the first line and after each boundary.
    begins = F.transform(rolling, lambda h, i: F.when(h % divisor == 0, i + 1))
    inner = F.filter(begins, lambda b: b.isNotNull() & (b < F.size(lines)))
    df = df.withColumn(starts, F.concat(F.array(F.lit(0)), inner))

    def chunk(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col(starts), i + 1), F.size(lines))
        return F.struct(F.array_join(F.slice(lines, start + 1, end - start), "\n").alias("text"), (end - start).alias("n_lines"))

    return df.withColumn(out, F.transform(starts, chunk)).drop(lines, hashes, rolling, starts)


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = LEAST_LINES) -> DataFrame:
    """``df`` without the chunks of ``least_lines`` lines or more that stood before, in the order of ids and lines.

    All columns stay as they are but ``text_col`` and the new ``removed_lines`` (long; a column of that name is
    replaced). The first place of a chunk is that with the smallest id and, in it, the smallest line; null ids come
    first. Rows that repeat id and text share their decisions. A null text stays null; a text may become empty, but
    no row goes. An empty table gives no rows.
    """
    columns = [c for c in df.columns if c.lower() != "removed_lines"]
    taken = [*df.columns, id_col, text_col]
    row, copy, chunks, lost_, own_id, own_hash = (fresh(n, taken) for n in ("__row_id", "__row_hash", "__chunks", "__gone", "__own_id", "__own_hash"))
    own = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    cut = with_chunks(df.select(F.col(quoted(id_col)).alias(row), own.alias("__text")), "__text", chunks)
    # There is always a chunk; the outer form keeps the planner from testing that by cutting the text once more.
    places = cut.select(row, F.xxhash64("__text").alias(copy), F.posexplode_outer(chunks).alias("place", "chunk"))
    places = places.where(F.col("chunk.n_lines") >= least_lines).select(
        row, copy, "place", F.col("chunk.text").alias("chunk"), F.xxhash64("chunk.text").alias("hash")
    )
    at = F.struct(row, copy, "place")
    # Candidates by hash alone; only their texts are moved and compared.
    candidates = places.groupBy("hash").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("hash")
    hits = places.join(candidates, "hash", "left_semi")
    firsts = hits.groupBy("hash", "chunk").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last")
    others = hits.join(firsts.select("hash", "chunk", "first"), ["hash", "chunk"]).where(~at.eqNullSafe(F.col("first")))
    gone = others.groupBy(row, copy).agg(F.collect_set("place").alias(lost_))
    rows = df.select(*[F.col(quoted(c)) for c in columns], F.col(quoted(id_col)).alias(own_id), F.xxhash64(own).alias(own_hash))
    joined = rows.join(gone, F.col(own_id).eqNullSafe(F.col(row)) & (F.col(own_hash) == F.col(copy)), "left")
    again = with_chunks(joined, text_col, chunks)
    kept = F.filter(chunks, lambda c, i: ~F.array_contains(lost_, i))
    lost = F.filter(chunks, lambda c, i: F.array_contains(lost_, i))
    text = F.when(F.col(lost_).isNull(), F.col(quoted(text_col))).otherwise(F.array_join(F.transform(kept, lambda c: c["text"]), "\n"))
    removed = F.when(F.col(lost_).isNull(), F.lit(0)).otherwise(F.aggregate(lost, F.lit(0), lambda total, c: total + c["n_lines"]))
    return again.select(
        *[(text.alias(c) if c == text_col else F.col(quoted(c))) for c in columns], removed.cast("long").alias("removed_lines")
    )


def _joined(lines: Column, place: Column, width: Column) -> Column:
    return F.array_join(F.slice(lines, place + 1, width), "\n")


def _anchors(df: DataFrame, lines: str, out: str, least_words: int) -> DataFrame:
    """``df`` with the array ``out`` of ``place``, ``width``, ``hash`` and ``seed`` of what is looked for elsewhere in ``lines``.

    Seeds are the chunks of two lines that the rolling hashes choose, other neighbouring lines of ``least_words``
    words together, and single lines of as many. All other neighbouring lines may only extend a match of a chunk
    beside them.
    """
    rolling, words = fresh("__rolling", df.columns), fresh("__words", df.columns)
    hashes = F.transform(lines, lambda line: F.pmod(F.xxhash64(line), F.lit(_PRIME)))
    # Counting the words of a line is dear; one with fewer characters has too few.
    counted = F.transform(lines, lambda line: F.when(F.char_length(line) >= (least_words + 1) // 2, F.regexp_count(line, F.lit(WORDS))).otherwise(0))
    df = df.withColumn(rolling, hashes).withColumn(words, counted)
    later = F.slice(rolling, 2, F.greatest(F.size(rolling) - 1, F.lit(0)))
    df = df.withColumn(rolling, F.zip_with(F.slice(rolling, 1, F.size(later)), later, lambda h, n: (h * _BASE + n) % _PRIME))
    line = lambda i: F.get(F.col(lines), i)
    hash_at = lambda i: F.get(F.col(rolling), i)
    anchor = lambda place, width, hash_, seed: F.struct(place.alias("place"), F.lit(width).alias("width"), hash_.alias("hash"), seed.alias("seed"))

    def of_pair(h: Column, i: Column) -> Column:
        chosen = (h <= hash_at(i + 1)) | ((i > 0) & (h <= hash_at(i - 1))) | (F.size(rolling) == 1)
        long = F.get(F.col(words), i) + F.get(F.col(words), i + 1) >= least_words
        return anchor(i, 2, _anchor_hash(line(i), line(i + 1)), F.coalesce(chosen, F.lit(False)) | long)

    single = F.transform(words, lambda n, i: F.when(n >= least_words, anchor(i, 1, _anchor_hash(line(i)), F.lit(True))))
    return df.withColumn(out, F.concat(F.transform(rolling, of_pair), F.filter(single, lambda a: a.isNotNull()))).drop(rolling, words)


def remove_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``df`` without the lines of passages that stood before, in the order of ids and lines.

    A passage is a run of three lines or more, of two lines with ``least_words`` words or more, or one line of as many
    (ideographs are words); a run of two shorter lines goes where it is a chunk. A line goes if a seed that holds it equals
    two lines (or a long one) that begin earlier, byte for byte, or if two lines beside a chunk that goes do; so all
    lines of a repeated passage go, and the first place of each line stays. Columns, ``removed_lines``,
    null ids, null texts and repeated rows are as in ``remove_repeated``; working columns avoid the table's names.
    """
    columns = [c for c in df.columns if c.lower() != "removed_lines"]
    taken = [*df.columns, id_col, text_col]
    name = {n: fresh(f"__line_{n}", taken) for n in ("id", "copy", "lines", "wanted", "gone", "anchors", "text", "own")}
    row, copy, lines, wanted, gone = (name[n] for n in ("id", "copy", "lines", "wanted", "gone"))
    own = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    cut = df.select(F.col(quoted(id_col)).alias(row), F.xxhash64(own).alias(copy), F.split(own, "\n", -1).alias(lines))
    cut = _anchors(cut, lines, name["anchors"], least_words).select(row, copy, name["anchors"])
    # The outer form keeps the planner from testing for anchors by cutting the text once more.
    places = cut.select(row, copy, F.inline_outer(name["anchors"])).where("hash is not null")
    at = F.struct(row, copy, "place")
    # Candidates by hash alone; only their texts are compared.
    candidates = stage(places.groupBy("hash").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("hash"))
    # Read twice below: to compare texts and to find places.
    chosen = stage(places.join(candidates, "hash", "left_semi").groupBy(row, copy).agg(F.collect_set(F.struct("place", "width", "hash", "seed")).alias(wanted)))
    # Both joins read the same shuffle of the texts if there are no columns but id and text.
    rows = df.select(*[F.col(quoted(c)) for c in columns], F.xxhash64(own).alias(name["own"]))
    same = F.col(quoted(id_col)).eqNullSafe(F.col(row)) & (F.col(name["own"]) == F.col(copy))
    held = rows.join(chosen, same).withColumn(lines, F.split(own, "\n", -1))
    texts = F.transform(wanted, lambda a: F.struct(a["place"], a["width"], a["hash"], a["seed"], _joined(F.col(lines), a["place"], a["width"]).alias("anchor")))
    # Named twice, so that the planner does not cut the text anew for each anchor.
    hits = held.select(row, copy, F.inline_outer(F.when(F.size(lines) > 0, texts)))
    # A passage that a third of the texts hold is one row of this table for each task that had it.
    compared = hits.groupBy("hash", "anchor").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    compared = compared.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.max(F.struct("n", "first", "last")).alias("most"))
    compared = stage(compared.select("hash", "texts", F.inline(F.array("most"))))
    # One text per hash, so places are told by the hash from here on and their texts stay where they are.
    firsts = compared.where("texts = 1 AND first <> last").select("hash", "first", F.ceil(F.col("n") / PLACES_OF_SHARE).cast("int").alias("shares"))
    # What many places share is dealt out in as many shares as its rows need.
    hot = stage(firsts.where("shares > 1").select("hash", F.col("shares").alias("dealt")))
    shared = firsts.select("hash", "first", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    found = chosen.select(row, copy, F.inline(wanted)).join(hot, "hash", "left")
    found = found.withColumn("share", F.pmod(F.xxhash64(row, copy, "place"), F.coalesce("dealt", F.lit(1))).cast("int"))
    keep = [row, copy, "place", "width", "seed"]
    others = found.join(shared, ["hash", "share"]).where(~at.eqNullSafe(F.col("first"))).select(*keep)
    several = compared.where("texts > 1").select("hash")
    if not several.isEmpty():  # different texts with one hash are told apart by their bytes
        apart = hits.join(several, "hash", "left_semi")
        own_first = apart.groupBy("hash", "anchor").agg(F.min(at).alias("first"))
        others = others.unionByName(apart.join(own_first, ["hash", "anchor"]).where(~at.eqNullSafe(F.col("first"))).select(*keep))
    matched = others.groupBy(row, copy).agg(F.collect_set(F.struct("place", "width", "seed")).alias("matched"))
    places_of = lambda keep: F.transform(F.filter("matched", keep), lambda a: a["place"])
    chunks, rest = places_of(lambda a: a["seed"] & (a["width"] == 2)), places_of(lambda a: ~a["seed"])
    beside = F.concat(F.transform(chunks, lambda p: p + 1), F.transform(chunks, lambda p: p - 1))
    pairs = F.concat(chunks, F.array_intersect(rest, beside))
    lines_of = F.concat(places_of(lambda a: a["width"] == 1), pairs, F.transform(pairs, lambda p: p + 1))
    lost = matched.select(row, copy, F.array_distinct(lines_of).alias(gone)).where(F.size(gone) > 0)
    joined = rows.join(lost, same, "left").withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(own, "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col(quoted(text_col))).otherwise(left)
    removed = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone))
    return joined.select(
        *[(text.alias(c) if c == text_col else F.col(quoted(c))) for c in columns], removed.cast("long").alias("removed_lines")
    )
