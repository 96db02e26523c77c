"""Ranking operators against brute force, with hot keys and ties."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.operators import blocktopk, features, knn, lsh
from vitrine.operators.bm25 import keyword_search
from vitrine.operators.fuzzy import _swap_distance, expand_terms
from vitrine.operators.knn import semantic_search, similar_by_vector
from vitrine.operators.lsh import approximate_search, recall
from vitrine.operators.metadata_similarity import Clauses, similar_by_metadata
from vitrine.operators.tags import tag_facet, tag_matches, tag_search
from vitrine.operators.terms import SearchField, TextIndex
from vitrine.plans import similar
from vitrine.plans.search import SearchOptions, hybrid_models, hybrid_search, multi_mode_search
from vitrine.plans.similar import combined_similar, similar_views


def ranks(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return out


@pytest.fixture(scope="module")
def points(spark):
    """Vectors of which a third are copies of one, two have no direction."""
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 8))
    vecs[:100] = vecs[0]
    vecs[298] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(300, None)]
    return spark.createDataFrame(rows, "doc_id long, vec array<double>"), vecs


def brute_knn(vecs, k):
    norms = np.linalg.norm(vecs, axis=1)
    out = {}
    for q in range(len(vecs)):
        if norms[q] == 0:
            continue
        scored = []
        for d in range(len(vecs)):
            if d != q and norms[d] > 0:
                scored.append((-round((1 + vecs[q] @ vecs[d] / (norms[q] * norms[d])) / 2, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"spread": 5}, {"max_query_rows": 0}])
def test_knn_equals_brute_force(points, options):
    df, vecs = points
    got = ranks(similar_by_vector(df, size=7, **options))
    want = brute_knn(vecs, 7)
    assert got.keys() == want.keys()
    for q, hits in want.items():
        assert [d for d, _ in got[q]] == [d for d, _ in hits]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in hits])


def test_small_blocks_give_the_same(points, monkeypatch):
    df, vecs = points
    monkeypatch.setattr(blocktopk, "CELLS_AT_ONCE", 500)
    from vitrine.operators.knn import CosineScorer

    usable = df.where(F.col("vec").isNotNull())
    cells = blocktopk.grid_topk(
        usable, usable.withColumnRenamed("doc_id", "query_id"), CosineScorer(), 5, exclude_self=True, corpus_block=40, query_block=30
    )
    got = ranks(blocktopk.top_n(cells.drop("matches"), 5))
    want = brute_knn(vecs, 5)
    assert {q: [d for d, _ in h] for q, h in got.items()} == {q: [d for d, _ in h] for q, h in want.items()}


def _long_documents(n=2000, words=300):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(2000)]
    return vocabulary, [(i, rng.choices(vocabulary, k=words)) for i in range(n)]


def test_long_documents_are_decoded_in_small_parts(monkeypatch):
    """The bytes decoded at once have a bound; the ranking is that of one block."""
    vocabulary, rows = _long_documents()
    docs = pa.table({"doc_id": [i for i, _ in rows], "text": [words for _, words in rows]})
    wanted = [[{"field": "text", "term": t, "avg_length": 300.0, "weight": 1.0} for t in vocabulary[q : q + 20]] for q in range(50)]
    queries = pa.table({"query_id": list(range(50)), "features": wanted})
    seen = []

    class Noted(features.FeatureScorer):
        def documents(self, table, queries):
            seen.append(table.nbytes)
            return super().documents(table, queries)

    def best():
        scorer = Noted([SearchField("text")], best_field=True)
        found, decoded, positions = blocktopk._setup(scorer, queries, 20, False)
        blocktopk._offer_block(found, scorer, decoded, positions, docs, False)
        return found.table(pa.int64(), pa.int64()).to_pydict()

    whole = best()
    assert len(seen) == 1
    monkeypatch.setattr(blocktopk, "BYTES_AT_ONCE", 1 << 20)
    monkeypatch.setattr(features, "WORDS_AT_ONCE", 5000)
    seen.clear()
    assert best() == whole
    assert len(seen) > 4 and max(seen) <= 1 << 20


def test_top_k_is_prefix(points):
    df, _ = points
    longer, shorter = ranks(similar_by_vector(df, size=8)), ranks(similar_by_vector(df, size=7))
    assert all(longer[q][:7] == shorter[q] for q in shorter)


def test_lsh_recall_and_hot_bucket(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(600, 16))
    vecs[:200] = vecs[0]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "doc_id long, vec array<double>")
    queries = df.withColumnRenamed("doc_id", "query_id")
    exact = semantic_search(queries, df, 10, exclude_self=True)
    near = approximate_search(queries, df, 10, exclude_self=True, corpus_block=50, query_block=50)
    row = recall(near, exact).first()
    assert row.expected == 6000
    assert row.recall > 0.8
    # Whatever is found has its exact score, and the copies find copies only.
    pairs = near.join(exact.drop("rank").withColumnRenamed("score", "want"), ["query_id", "doc_id"])
    assert pairs.where(F.abs(F.col("score") - F.col("want")) > 1e-9).count() == 0
    assert near.where("query_id < 200 AND (doc_id >= 200 OR score < 1)").count() == 0


WORDS = "red blue bolt bold gear geer small smal widget wigdet plate late anvil anvils rod road a ab".split()


def brute_bm25(docs, queries, fields, fuzzy, k):
    """docs: id -> {field: text}; fields: name -> (boost, exact)."""

    def terms(text, exact):
        return [text] if exact else text.lower().split()

    index = {f: {d: terms(v[f], e) for d, v in docs.items() if v.get(f) is not None} for f, (_, e) in fields.items()}
    out, totals = {}, {}
    for q, text in queries.items():
        best = {}
        for f, (boost, exact) in fields.items():
            df = Counter(t for ts in index[f].values() for t in set(ts))
            n = len(index[f])
            avg = sum(map(len, index[f].values())) / n
            total = Counter()
            for word in terms(text, exact):
                budget = 0 if not fuzzy else (0 if len(word) < 3 else 1 if len(word) < 6 else 2)
                near = {t: _swap_distance(word, t) for t in df}
                near = {t: 1 - e / min(len(t), len(word)) for t, e in near.items() if e <= budget}
                near = dict(sorted(near.items(), key=lambda x: (-x[1], x[0]))[:50])
                near = {t: s for t, s in near.items() if s > 0}
                for t, sim in near.items():
                    top = max(df[x] for x in near)
                    idf = math.log(1 + (n - top + 0.5) / (top + 0.5))
                    for d, ts in index[f].items():
                        tf = ts.count(t)
                        if tf:
                            sat = 1 if exact else 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
                            total[d] += boost * idf * sim * sat
            for d, s in total.items():
                best[d] = max(best.get(d, 0), s)
        ranked = sorted(((-round(s, 6), d) for d, s in best.items()))
        totals[q] = len(ranked)
        out[q] = [(d, -s) for s, d in ranked[:k]]
    return {q: h for q, h in out.items() if h}, totals


@pytest.fixture(scope="module")
def library(spark):
    random.seed(11)
    docs = {}
    for i in range(120):
        words = ["red"] * (i % 3 == 0) + random.choices(WORDS, k=random.randint(1, 12))
        docs[i] = {"title": " ".join(words), "kind": random.choice(["Gear", "Bolts", ""]), "note": None if i % 4 else " ".join(random.choices(WORDS, k=40))}
    queries = {"q1": "red bolt", "q2": "widgte plate late", "q3": "Gear", "q4": "smal red red", "q5": "nothing here"}
    queries["q6"] = queries["q1"]
    df = spark.createDataFrame([(i, d["title"], d["kind"], d["note"]) for i, d in docs.items()], "doc_id long, title string, kind string, note string")
    qdf = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    fields = {"title": (3.0, False), "kind": (1.5, True), "note": (0.5, False)}
    return docs, queries, df, qdf, fields, [SearchField(n, b, e) for n, (b, e) in fields.items()]


@pytest.mark.parametrize("fuzzy", [False, True])
def test_keyword_search_equals_brute_force(library, fuzzy):
    docs, queries, df, qdf, fields, search_fields = library
    got = keyword_search(qdf, TextIndex.of(df, search_fields), 15, fuzzy, with_total=True)
    want, totals = brute_bm25(docs, queries, fields, fuzzy, 15)
    assert {r.query_id: r.total for r in got.select("query_id", "total").distinct().collect()} == {q: t for q, t in totals.items() if t}
    got = ranks(got)
    assert got.keys() == want.keys()
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_written_index_and_grid_give_the_same(spark, library, tmp_path):
    _, _, df, qdf, _, fields = library
    index = TextIndex.of(df, fields)
    want = ranks(keyword_search(qdf, index, 15))
    index.write(str(tmp_path / "index"))
    stored = TextIndex.read(spark, str(tmp_path / "index"), fields)
    assert ranks(keyword_search(qdf, stored, 15)) == want
    assert ranks(keyword_search(qdf, index, 15, max_query_rows=0)) == want


def test_fuzzy_equals_brute_force(spark):
    random.seed(5)
    letters = "abcd"
    vocabulary = sorted({"".join(random.choices(letters, k=random.randint(1, 8))) for _ in range(400)})
    wanted = sorted({"".join(random.choices(letters, k=random.randint(1, 8))) for _ in range(60)})
    got = expand_terms(
        spark.createDataFrame([("f", w) for w in wanted], "field string, query_term string"),
        spark.createDataFrame([("f", v, i + 1) for i, v in enumerate(vocabulary)], "field string, term string, df long"),
        max_expansions=1000,
    )
    got = {(r.query_term, r.term): r.edits for r in got.collect()}
    want = {}
    for w in wanted:
        budget = 0 if len(w) < 3 else 1 if len(w) < 6 else 2
        for v in vocabulary:
            edits = _swap_distance(w, v)
            if edits <= budget and edits < min(len(w), len(v)):
                want[w, v] = edits
    assert got == want


def test_fuzzy_long_words(spark):
    """Words around and beyond the length at which segments take over from deletions."""
    random.seed(8)
    wanted, vocabulary = [], set()
    for n in [9, 10, 11, 12, 13, 14, 15, 16, 20, 31, 400, 20000]:
        word = "".join(random.choices("abcdefgh", k=n))
        wanted.append(word)
        for _ in range(40):
            letters = list(word)
            for _ in range(random.randint(0, 3)):
                at = random.randrange(len(letters) - 1)
                kind = random.choice("idsx")
                if kind == "i":
                    letters.insert(random.choice([0, at, len(letters)]), random.choice("abz"))
                elif kind == "d":
                    del letters[random.choice([0, at, len(letters) - 1])]
                elif kind == "s":
                    letters[at] = "z"
                else:
                    letters[at], letters[at + 1] = letters[at + 1], letters[at]
            vocabulary.add("".join(letters))
    got = expand_terms(
        spark.createDataFrame([("f", w) for w in wanted], "field string, query_term string"),
        spark.createDataFrame([("f", v, 1) for v in vocabulary], "field string, term string, df long"),
    )
    got = {(r.query_term, r.term): r.edits for r in got.collect()}
    want = {}
    for w in wanted:
        for v in vocabulary:
            if abs(len(w) - len(v)) <= 2 and _swap_distance(w, v, 2) <= 2:
                want[w, v] = _swap_distance(w, v, 2)
    assert len(want) > 200
    assert got == want


def test_bounded_distance_is_exact():
    random.seed(2)
    for _ in range(3000):
        a, b = ("".join(random.choices("abc", k=random.randint(0, 7))) for _ in "xy")
        full = _swap_distance(a, b)
        near = _swap_distance(a, b, 2)
        assert near == full if full <= 2 else near > 2


def test_options_from_params():
    options = SearchOptions.from_params({"keyword": "false", "models": "siglip2", "hybridBalance": "0.8", "hybridMode": "text"})
    assert (options.keyword, options.hybrid, options.models, options.balance, options.mode) == (False, True, ("siglip2",), 0.8, "text")
    assert SearchOptions.from_params({}) == SearchOptions()


def test_swap_distance():
    assert _swap_distance("ca", "ac") == 1
    assert _swap_distance("ca", "abc") == 3
    assert _swap_distance("kitten", "sitting") == 3


def test_tags(spark):
    tags = spark.createDataFrame(
        [(1, ["a", "b", "a"]), (2, ["a"]), (3, ["b", "c"]), (4, []), (5, None)], "doc_id long, tags array<string>"
    )
    assert [tuple(r) for r in tag_facet(tags).collect()] == [("a", 2), ("b", 2), ("c", 1)]
    queries = spark.createDataFrame(
        [("ab", ["a", "b"]), ("a", ["a"]), ("az", ["a", "z"]), ("none", [])], "query_id string, tags array<string>"
    )
    got = ranks(tag_search(queries, tags))
    assert {q: [d for d, _ in hits] for q, hits in got.items()} == {"ab": [1], "a": [1, 2]}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert got["ab"][0][1] == pytest.approx(round(2 * idf, 6))


@pytest.fixture(scope="module")
def gallery(spark):
    rows = [
        (1, "Ann Lee", "oil", "Paintings", 1900, 1910, 10.0, 10.0),
        (2, "Ann Lee", "oils", "Paintings", 1905, 1905, 11.0, 9.0),
        (3, "Unknown", "ink", "Prints", None, None, 0.0, 5.0),
        (4, "Unknown", "bronze", "", 1700, 1700, None, None),
        (5, "", "", "", 0, 0, 0.0, 0.0),
    ]
    items = spark.createDataFrame(
        rows, "doc_id long, artist string, medium string, classification string, dateBegin int, dateEnd int, width double, height double"
    )
    clauses = Clauses(exact=(SearchField("classification", 5.0, exact=True),))
    return items, clauses


def test_metadata_similarity(gallery):
    items, clauses = gallery
    got = ranks(similar_by_metadata(items, size=10, clauses=clauses))
    # Dated sources match everything, an undated candidate as if it had the centre year.
    assert {d for d, _ in got[1]} == {2, 3, 4, 5}
    assert got[1][0][0] == 2
    scores = dict(got[1])
    assert scores[3] == 7.0
    assert scores[4] < 1e-6
    # Source 3 is undated and its artist unknown: only medium and kind can match, and none does.
    assert 3 not in got
    assert 5 not in got
    n, df = 5, 2
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    assert scores[2] > 5 * idf + 3 + 6.9


def test_metadata_total(gallery):
    items, clauses = gallery
    got = similar_by_metadata(items, size=2, clauses=clauses, with_total=True)
    assert {(r.query_id, r.total) for r in got.collect()} == {(1, 4), (2, 4), (4, 4)}


def test_metadata_grid_equals_scan(gallery):
    items, clauses = gallery
    scan = ranks(similar_by_metadata(items, size=3, clauses=clauses))
    assert ranks(similar_by_metadata(items, size=3, clauses=clauses, max_query_rows=0)) == scan


def test_combined_and_views(spark, gallery):
    items, clauses = gallery
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "doc_id long, vec array<double>")
    got = combined_similar(items, {"siglip2": vec}, ["siglip2"], size=4, clauses=clauses)
    rows = {(r.query_id, r.doc_id): r for r in got.collect()}
    # The third is too far from the others, undated and of no kind of theirs.
    assert {q for q, _ in rows} == {1, 2}
    # Itself takes the first vector rank, not the first metadata rank.
    assert rows[1, 2].score == pytest.approx(0.35 / 62 + 0.3 / 61, abs=1e-9)
    assert rows[1, 2].sources == ["siglip2", "metadata"]
    assert rows[1, 2].total == got.where("query_id = 1").count()
    views = similar_views(items, {"siglip2": vec}, ["siglip2"], size=4, clauses=clauses)
    assert {r.view for r in views.select("view").distinct().collect()} == {"siglip2", "combined", "metadata"}


def test_views_rank_metadata_once(spark, gallery, monkeypatch):
    """The metadata ranking is a view and a list of the combined one, and is read from where it was staged by both."""
    items, clauses = gallery
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "doc_id long, vec array<double>")
    passed = spark.sparkContext.accumulator(0)

    def counted(*args, **options):
        ranked = similar_by_metadata(*args, **options).coalesce(1)

        def run(batches):
            for batch in batches:
                passed.add(batch.num_rows)
                yield batch

        return ranked.mapInArrow(run, ranked.schema)

    monkeypatch.setattr(similar, "similar_by_metadata", counted)
    views = similar_views(items, {"siglip2": vec}, ["siglip2"], size=4, clauses=clauses).collect()
    listed = sum(r.view == "metadata" for r in views)
    assert listed and passed.value == listed


def test_hybrid(spark, library):
    _, _, df, qdf, _, fields = library
    index = TextIndex.of(df, fields)
    rng = np.random.default_rng(1)
    vec = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "doc_id long, vec array<double>")
    asked = qdf.where("query_id IN ('q1', 'q4')").withColumn("vec_siglip2", F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(0.0)))
    asked = asked.withColumn("vec_jina_v3", F.when(F.col("query_id") == "q1", F.col("vec_siglip2")))
    both = {"jina_v3": vec, "siglip2": vec}
    one = hybrid_search(asked, index, both, ["siglip2"], 5)
    assert one.groupBy("query_id").count().where("count = 5").count() == 2
    pure = ranks(hybrid_search(asked.withColumn("balance", F.lit(1.0)), index, both, ["siglip2"], 5))
    assert pure["q1"] == ranks(semantic_search(asked.select("query_id", F.col("vec_siglip2").alias("vec")), vec, 5))["q1"]
    words = ranks(hybrid_search(asked.withColumn("balance", F.lit(0.0)), index, both, ["siglip2"], 5))
    assert words == ranks(keyword_search(asked, index, 5))
    # At balance 0 two models have no shortcut: the idle side still adds documents, worth nothing.
    idle = hybrid_search(asked.withColumn("balance", F.lit(0.0)), index, both, ["jina_v3", "siglip2"], 200)
    assert idle.where("score = 0").count() > 0
    nothing = hybrid_search(qdf, index, both, ["siglip2"])
    assert nothing.columns == one.columns and nothing.count() == 0


def test_multi_mode_routes_emoji(spark, library):
    _, _, df, _, _, fields = library
    index = TextIndex.of(df, fields)
    queries = spark.createDataFrame([("sea", "🌊"), ("words", "red bolt")], "query_id string, text string").withColumn(
        "vec_siglip2", F.array(F.lit(1.0), F.lit(0.0))
    )
    tags = spark.createDataFrame([(1, ["🌊", "⛰"]), (2, ["⛰"])], "doc_id long, tags array<string>")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, vec array<double>")
    got = multi_mode_search(queries, index, {"siglip2": vec}, SearchOptions(size=5), tags)
    hits = {(r.query_id, r["mode"]): r.doc_id for r in got.where("rank = 1").collect()}
    assert hits["sea", "keyword"] == 1
    assert hits["sea", "siglip2"] == 1
    assert ("words", "hybrid") in hits
    plain = multi_mode_search(queries, index, {"siglip2": vec}, SearchOptions(size=5, include_descriptions=False, hybrid=False))
    assert plain.where("mode = 'keyword'").count() == 5


def test_fields_can_be_left_out(library):
    docs, queries, df, qdf, fields, search_fields = library
    index = TextIndex.of(df, search_fields).without({"note"})
    kept = {n: v for n, v in fields.items() if n != "note"}
    want, _ = brute_bm25(docs, queries, kept, True, 15)
    got = ranks(keyword_search(qdf, index, 15))
    assert {q: [d for d, _ in h] for q, h in got.items()} == {q: [d for d, _ in h] for q, h in want.items()}


def test_hybrid_models():
    every = ["jina_v3", "siglip2"]
    assert hybrid_models("both", every) == every
    assert hybrid_models("text", every) == ["jina_v3"]
    assert hybrid_models("image", ["jina_v3"]) == []
    assert hybrid_models("both", ["siglip2"]) == ["siglip2"]
    assert hybrid_models("image", ["jina_v3"], fallback=True) == []


def test_tag_search_of_few_lists_leaves_the_corpus_in_place(spark):
    """Few tag lists are known to be few: the corpus, a row per tag, is not sorted by tag for them."""
    corpus = spark.range(20_000).selectExpr("id AS doc_id", "array(concat('a', id % 7), concat('b', id % 5), 'c') AS tags").repartition(3)
    queries = spark.createDataFrame([(1, ["c", "a1"]), (2, ["a1", "c"]), (3, ["b0", "zz"]), (4, None)], "query_id long, tags array<string>")
    found = tag_search(queries, corpus, 3)
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in found.collect()) == [(q, 1 + 7 * i, i + 1) for q in (1, 2) for i in range(3)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 60_000)  # less than the corpus
    try:
        plan = tag_matches(queries, corpus)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lsh_scores_no_pair_twice(spark, monkeypatch):
    """Where buckets hold more pairs than there are, blocks of all are scored once, with the hits that the buckets give."""
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(400, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>").repartition(3)
    queries = df.withColumnRenamed("doc_id", "query_id")
    asked = []
    real = lsh.grid_topk
    monkeypatch.setattr(lsh, "grid_topk", lambda *a, **o: asked.append(o.get("keys")) or real(*a, **o))

    def hits(corpus=df):
        found = approximate_search(queries, corpus, 10, tables=6, width=0.6, exclude_self=True).collect()
        return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found)

    once = hits()
    assert asked == [None]
    # Repeated rows push nothing out.
    assert hits(df.unionByName(df.where("doc_id < 200")).unionByName(df.where("doc_id < 100"))) == once
    monkeypatch.setattr(lsh, "_pairs", lambda *a: (0, 1))
    assert hits() == once
    assert asked == [None, None, ["hash_table", "bucket"]]


def test_rough_scores_lose_no_hit():
    """Hits that differ by less than single precision tells are ranked in double precision; few pairs are scored so."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=64)
    near = base + 1e-5 * rng.normal(size=(4000, 64))
    vecs = np.concatenate([near, rng.normal(size=(4000, 64)), np.zeros((1, 64))])
    asked = np.concatenate([base[None], rng.normal(size=(39, 64)) - base, np.zeros((1, 64))])
    docs = pa.table({"doc_id": np.arange(len(vecs)), "vec": pa.array(list(vecs))})
    queries = pa.table({"query_id": np.arange(len(asked)), "vec": pa.array(list(asked))})
    scorer = knn.RoughCosineScorer()
    scored, exact = [], scorer.exact
    scorer.exact = lambda *a: scored.append(len(a[2])) or exact(*a)
    got = blocktopk._cell(scorer, 7, False, [])(docs, queries)
    with np.errstate(invalid="ignore"):
        unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (asked, vecs)]
    want = np.round((1 + unit[0] @ unit[1].T) / 2, 6)
    listed = {}
    for q, d, s in zip(*(got[c].to_pylist() for c in ("query_id", "doc_id", "score"))):
        listed.setdefault(q, []).append((-s, d))
    for q in range(40):
        best = sorted((-s, d) for d, s in enumerate(want[q].tolist()) if not np.isnan(s))[:7]
        assert sorted(listed[q]) == best
    assert 40 not in listed
    # All near ones of the first query, and some of the others.
    assert sum(scored) < 0.1 * len(vecs) * len(asked)
    assert sorted(set(got["matches"].to_pylist())) == [0, 8000]


def test_similar_views_rank_vectors_once_and_broadcast_no_ids(spark, monkeypatch):
    items, vecs = _view_tables(spark)
    plans = []
    real = similar.similar_by_vector
    monkeypatch.setattr(similar, "similar_by_vector", lambda *a, **o: plans.append(1) or real(*a, **o))
    monkeypatch.setattr(similar, "semantic_search", lambda *a, **o: pytest.fail("ranked again"))
    views = similar.similar_views(items, {"siglip2": vecs}, ["siglip2"], 3, items, max_query_rows=0)
    assert plans == [1]
    got = {(r.view, r.query_id, r["rank"]): r.doc_id for r in views.collect()}
    monkeypatch.undo()
    want = real(vecs, items, 3).collect()
    assert {("siglip2", r.query_id, r["rank"]): r.doc_id for r in want} == {k: v for k, v in got.items() if k[0] == "siglip2"}
    combined = similar.combined_similar(items, {"siglip2": vecs}, ["siglip2"], 3, similar.C.COMBINED_WEIGHTS, items).collect()
    assert {("combined", r.query_id, r["rank"]): r.doc_id for r in combined} == {k: v for k, v in got.items() if k[0] == "combined"}
    # The ids of sources stay on the executors, whatever the planner takes their size for.
    queries = vecs.join(items.select("doc_id").hint("merge"), "doc_id", "left_semi")
    assert "Broadcast" not in queries._jdf.queryExecution().executedPlan().toString()
    seen = []
    monkeypatch.setattr(knn, "semantic_search", lambda q, *a, **o: seen.append(q) or q)
    knn.similar_by_vector(vecs, items, 3)
    assert "BroadcastHashJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def _view_tables(spark):
    rng = np.random.default_rng(10)
    vecs = rng.normal(size=(30, 4))
    vecs[7] = vecs[2]
    rows = [(i, f"a{i % 3}", f"m{i % 5}", "c", "d", "u", "n", "p", "y", 1900 + i, 1901 + i, 5.0, 6.0) for i in range(40)]
    names = "doc_id long, artist string, medium string, classification string, department string, culture string, artistNationality string, period string, dynasty string, dateBegin int, dateEnd int, width double, height double"
    return spark.createDataFrame(rows, names), spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "doc_id long, vec array<double>")
