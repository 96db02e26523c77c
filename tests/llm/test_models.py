"""Fitted operators: held-out accuracy, brute-force scores and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, documents, with_clashes

from vitrine.llm import langid, quality, url_filter
from vitrine.llm.registered import URL_RULES

SMALL = quality.Settings(sample_rows=400, vocabulary=200, dimensions=32, epochs=15)


@pytest.fixture(scope="module")
def marked(spark):
    """Texts of plain words (1) and of repeated or shouted ones (0), in two languages."""
    rng = random.Random(2)
    names = {"en": "the of and house river stone with paper light".split(), "de": "der und das haus fluss stein mit papier licht".split()}
    rows, labels = [], []
    for i in range(400):
        lang, good = rng.choice(["en", "de"]), rng.random() < 0.7
        words = [rng.choice(names[lang]) for _ in range(rng.randint(5, 60))]
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        rows.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, marked):
    docs, labels = marked
    model = quality.train(docs, labels.where("doc_id % 4 <> 2"), settings=SMALL)
    rows = quality.score(docs, model).join(labels, "doc_id").where("doc_id % 4 = 2").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(spark, marked):
    docs, labels = marked
    model = quality.train(docs.repartition(5), labels, settings=SMALL)
    same = quality.train(docs, labels, settings=SMALL)
    assert model.words == same.words and (model.vectors == same.vectors).all()  # however the table is divided
    df = with_clashes(documents(spark), "Score", "predicted")
    rows = quality.score(df, model).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "score", "predicted"}
    assert quality.score(df.limit(0), model).count() == 0
    none = quality.train(docs.limit(0), labels, settings=SMALL)
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    unlabelled = quality.train(docs, labels.withColumn("quality", labels.quality * 0 + 7), settings=SMALL)
    assert not unlabelled.layers


def test_word_vectors_count_the_company(spark):
    texts = ["a b c a", "b b", "", "c a é 日 b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    settings = quality.Settings(dimensions=16)
    words = ["a", "b", "c"]
    got = quality.word_vectors(df, words, settings, "text")
    number = quality.Words(words)
    index = quality.index_vectors(quality.SHAPED + 3, 16, settings.seed)
    want = np.zeros_like(got, dtype=np.float64)
    for t in texts:
        ids = number.sequences(pa.array([t]))[0].tolist()
        for i, word in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    want[word] += index[ids[j]]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.maximum(norm, 1e-9), atol=1e-6)


def test_pooling_in_parts(monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(quality.SHAPED + 2, 8)).astype(np.float32)
    pool = quality.Pooler(["a", "b"], vectors)
    texts = pa.array(["a b a a", "", "b b b xyz XYZ", "é"])
    out = pool(texts)
    ids = pool.words.sequences(texts)[0][:4]
    assert np.allclose(out[0][:8], vectors[ids].mean(axis=0), atol=1e-5)
    assert out[0][-2] == 1 / 4 and out[1].tolist() == [0.0] * 19


def test_language_on_held_out_rows(spark, marked):
    docs, _ = marked
    model = langid.train(docs.where("doc_id % 4 <> 2"))
    rows = langid.identify(docs.where("doc_id % 4 = 2"), model).collect()
    assert all(r.lang_pred == r.lang and r.score > 0.5 for r in rows)


@pytest.mark.parametrize("capacity", [0, 2, 100])
def test_language_scores_by_hand(spark, capacity):
    df = spark.createDataFrame([("en", "The cat the"), ("fr", "le chat, LE"), (None, "lost")], "lang string, text string")
    model = langid.train(df, capacity=capacity)
    assert model.languages == ["en", "fr"] and len(model.top[0]) == min(capacity, 4)
    words = spark.createDataFrame([(w,) for w in ("the", "chats", "zzz")], "word string")
    rated = {r.word: r.scores for r in langid.rate_words(words, model).collect()}
    by_join = {r.word: r.scores for r in langid.rate_words(words, model, 0).collect()}
    assert by_join.keys() == rated.keys() and all(by_join[w] == pytest.approx(rated[w]) for w in rated)
    counts = {"en": Counter(the=2, cat=1), "fr": Counter(le=2, chat=1)}
    for i, lang in enumerate(("en", "fr")):
        assert rated["the"][i] == pytest.approx(math.log((counts[lang]["the"] + 0.5) / (3 + 0.5 * 5)))
    grams = {lang: Counter(g for w, n in c.items() for g in [f" {w} "[j : j + 4] for j in range(len(w) - 1)] * n) for lang, c in counts.items()}
    kinds = len(grams["en"] | grams["fr"])
    for i, lang in enumerate(("en", "fr")):  # of the unseen word " cha" and "chat" are known
        want = np.mean([math.log((grams[lang][g] + 0.5) / (sum(grams[lang].values()) + 0.5 * (kinds + 1))) for g in (" cha", "chat")])
        assert rated["chats"][i] == pytest.approx(want)
    got = langid.identify(spark.createDataFrame([(1, "the chats THE")], "doc_id long, text string"), model).first()
    sums = [(2 * rated["the"][i] + rated["chats"][i]) / math.sqrt(3) for i in range(2)]
    assert got.lang_pred == "en" and got.score == pytest.approx(1 / sum(math.exp(x - max(sums)) for x in sums))


def test_every_language_score_is_the_same_whatever_is_broadcast(spark):
    """Random words of three languages, most of them rare, and unseen ones."""
    rng = random.Random(5)
    stems = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)] for lang, letters in (("a", "abcdeé"), ("b", "cdefgß"), ("c", "efghiш"))}
    rows = [(i, " ".join(rng.choices(stems[lang], k=rng.randint(0, 30))), lang) for i in range(120) for lang in ("abc"[i % 3],)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    asked = spark.createDataFrame([(i, t + " neu unseén", None) for i, t, _ in rows] + [(-1, None, None), (-2, "qqq", None)], df.schema)
    results = []
    for capacity in (0, 40, 10**6):
        out = langid.identify(asked, langid.train(df, capacity=capacity))
        results.append({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in out.collect()})
    assert results[0] == results[1] == results[2] and len(results[0]) == 122


def test_a_rare_language_keeps_its_words(spark):
    """Under one row in a hundred, its words seen once or twice, and less broadcast than the large languages alone have."""
    rng = random.Random(8)

    def words(letters, n):
        return ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n)]

    large = {"en": words("aeiorstnlh", 1500), "de": words("aeunrstdgch", 1500)}
    small = words("aeorstnlíkjv", 400)
    rows = [(i, " ".join(rng.choices(large["en" if i % 2 else "de"], k=40)), "en" if i % 2 else "de") for i in range(3000)]
    rows += [(3000 + i, " ".join(rng.choices(small, k=25)), "is") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(docs, capacity=2000)
    held = spark.createDataFrame([(i, " ".join(rng.choices(small, k=20)), "is") for i in range(60)], docs.schema)
    right = sum(r.lang_pred == "is" for r in langid.identify(held, model).collect())
    assert right >= 57
    others = [(i, " ".join(rng.choices(large["en"], k=20)), "en") for i in range(60)]
    assert all(r.lang_pred == "en" for r in langid.identify(spark.createDataFrame(others, docs.schema), model).collect())


def test_language_of_odd_rows(spark, marked):
    model = langid.train(marked[0])
    df = with_clashes(documents(spark), "lang_pred", "Score")
    rows = langid.identify(df, model).collect()
    assert len(rows) == df.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != langid.UNKNOWN) == letters and (letters or r.score == 0) and 0 <= r.score <= 1
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.train(marked[0].limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {langid.UNKNOWN}
    assert len(langid.train(marked[0], capacity=5).top[0]) <= 5


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG/en/12", "https://a.b.example.org/es/x?y#z", "https://example.org/en/2", "ftp://x.org?q",
    "http://x.org/", "http://notorg/", "http://x.com/fr/1", "http://com/de/1", "http://x.com/de", "http://x.net/fr/://y.org/", "a://b://c.org/",
    "http://É.org/Ü", "http://example.org#/es/", "http://sub.example.org/es/", "http://myexample.org/es/", "x\n://y.org/a\nb?c",
]


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def _rule(host, path):
    best = None
    for verdict, rule in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def test_url_rules_and_models(spark):
    rng = random.Random(3)
    urls = URLS + [f"http://{rng.choice(['good', 'nice'])}{i}.org/{rng.choice(['read', 'book'])}/{i}" for i in range(300)]
    urls += [f"http://{rng.choice(['spam', 'casino'])}{i}.com/de/{rng.choice(['win', 'cash'])}/{i}" for i in range(300)]
    unruled = [(f"http://good{i}.net/read/{i}", "allow") for i in range(40)] + [(f"http://casino{i}.net/de/win/{i}", "block") for i in range(40)]
    rows = [(i, u, "clash") for i, u in enumerate(urls + [u for u, _ in unruled] + urls[:3])]
    df = spark.createDataFrame(rows, "page_id long, url string, Verdict string").repartition(3)
    out = {r.page_id: r for r in url_filter.judge(df, URL_RULES).collect()}
    assert len(out) == len(rows)
    for i, url, _ in rows:
        r, (host, path) = out[i], _parts(url)
        rule = _rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1])
        assert r.verdict == (rule[0] if rule else "allow" if r.score >= 0.5 else "block")
    own = [out[len(urls) + i].verdict == v for i, (_, v) in enumerate(unruled)]
    assert np.mean(own) > 0.95
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0
    assert {r.score for r in url_filter.judge(df, []).collect()} == {0.5}


def test_urls_are_read_to_their_end(spark, monkeypatch):
    """URLs that differ in their query or fragment alone, one very long; working columns don't clash."""
    monkeypatch.setattr(url_filter, "TEXTS_OF_COPY", 7)
    urls = [f"http://a{i}.org/x?ref=good{i}" for i in range(60)] + [f"http://a{i}.com/de/x?ref=spam{i}#win" for i in range(60)]
    asked = ["http://b.net/x?ref=good7", "http://b.net/x?ref=spam7#win", "http://b.net/x", "x?ref=good1", "http://b.net/" + "y" * 60_000]
    names = ["difference", "__found_text", "__url_text", "text", "id", "gram"]
    rows = [(i, u, *["clash"] * len(names)) for i, u in enumerate(urls + asked)]
    df = spark.createDataFrame(rows, ", ".join(["page_id long, url string", *[f"`{n}` string" for n in names]])).repartition(3)
    found = url_filter.judge(df, URL_RULES).collect()
    assert len(found) == len(rows) and all(r[n] == "clash" for r in found for n in names)
    out = {r.page_id: r for r in found}
    good, spam, plain, bare, _ = (out[len(urls) + i] for i in range(5))
    assert good.verdict == "allow" and spam.verdict == "block" and good.score > plain.score > spam.score and bare.score != 0.5


def test_markov_smoothing_by_hand(spark):
    texts = ["ab", "abab", "b"]
    df = spark.createDataFrame([("allow", t) for t in texts], "verdict string, text string").repartition(2)
    model = url_filter.train(df)["allow"]
    logs = model.logs(url_filter._contexts(pa.array(["aba"]))[0])
    counts = {}
    for t in texts:
        padded = "\0" * url_filter.ORDER + t + "\0"
        for i in range(url_filter.ORDER, len(padded)):
            for k in range(url_filter.ORDER + 1):
                counts.setdefault(padded[i - k : i], Counter())[padded[i]] += 1
    padded = "\0" * url_filter.ORDER + "aba" + "\0"
    for place, i in enumerate(range(url_filter.ORDER, len(padded))):
        p = 1 / 257
        for k in range(url_filter.ORDER + 1):
            seen = counts.get(padded[i - k : i])
            if seen:
                p = (seen[padded[i]] + len(seen) * p) / (sum(seen.values()) + len(seen))
        assert logs[place] == pytest.approx(math.log(p))


def test_url_differences_hold_all_contexts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CAPACITY", 1)  # bounds nothing here
    rng = random.Random(6)
    sides = [("allow", "abcé", 60), ("block", "bcd", 15)]
    held = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 9))), v) for v, letters, n in sides for _ in range(n)]
    counted = Counter(held)
    texts = [(t, v, n, False) for (t, v), n in counted.items()] + [("abcd", None, 3, False), ("", None, 1, False), ("zz", "allow", 2, True)]
    out = url_filter.text_differences(spark.createDataFrame(texts, "text string, verdict string, n long, out boolean").repartition(3))
    models = url_filter.train(spark.createDataFrame([(v, t) for t, v in held], "verdict string, text string"), capacity=1 << 30)
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        levels, _ = url_filter._contexts(pa.array([r.text]))
        want = (models["allow"].logs(levels) - models["block"].logs(levels)).mean()
        assert r.difference == pytest.approx(want, abs=1e-6)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == corpus_pipeline.COLUMNS
        assert 0 < after.count() <= before.count(), name
        before = after
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in before.select("doc_id").collect()}
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
