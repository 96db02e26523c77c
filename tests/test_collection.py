"""Files in, collection out: catalogues, model output, store, jobs, caches, streams."""

import csv
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.operators import enrich
from vitrine.operators.bm25 import keyword_search
from vitrine.operators.terms import TextIndex, default_fields
from vitrine.plans import jobs, query_cache
from vitrine.plans.build import build_collections, coverage_report, read_model_output
from vitrine.session import drop_staged, stage
from vitrine.sources import files, normalize, registry, store
from vitrine.streaming.ingest import compact, ingest_records, read_ingested
from vitrine.streaming.query_keys import first_in_week


def write_csv(path, schema, rows, bom=False):
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as out:
        writer = csv.DictWriter(out, schema.names, restval="")
        writer.writeheader()
        writer.writerows(rows)


def write_lines(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in records), encoding="utf-8")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("catalogue")
    painting = {"Classification": "Paintings", "Is Public Domain": "True", "Link Resource": "http://x/1"}
    first = [
        {**painting, "Object ID": "1", "Title": 'A "red" boat,\nat sea', "Object Date": "ca. 1900", "Gallery Number": "12", "Tags": "Men| Sea ||"},
        {**painting, "Object ID": "2", "Title": "", "Object Date": "1850–1860", "Artist Begin Date": "1820  "},
        {**painting, "Object ID": "3", "Title": "No image"},
        {**painting, "Object ID": "4", "Classification": "Prints"},
        {**painting, "Object ID": "5", "Link Resource": " "},
        {**painting, "Object ID": "6", "Is Public Domain": "False"},
    ]
    write_csv(root / "first.csv", schemas.SOURCE1_CSV, first, bom=True)
    second = [
        {"ObjectID": "7", "Title": "Boat", "Artist": "Ann", "ImageURL": "http://i/1024x1024/a", "BeginDate": "(1900)", "Width (cm)": "10.5", "Height (cm)": "x", "OnView": "Y"},
        {"ObjectID": "8", "Title": "Blind", "ImageURL": " "},
        {"ObjectID": "9", "Title": "Sea", "ImageURL": "http://i/b", "URL": "http://u", "BeginDate": "-1841", "Dimensions": "1″  x 2″"},
    ]
    write_csv(root / "second.csv", schemas.SOURCE2_CSV, second)
    cache = [
        {"object_id": "1", "primaryImage": "http://p/old", "primaryImageSmall": "", "hasImage": True, "fetched_at": "2024-01-01"},
        {"object_id": "1", "primaryImage": "http://p/1", "primaryImageSmall": "http://s/1", "hasImage": True, "fetched_at": "2024-01-02"},
        "{broken",
        "",
        {"object_id": "2", "primaryImage": "http://p/2", "primaryImageSmall": "", "hasImage": True, "fetched_at": "2024-01-01"},
        {"object_id": "3", "primaryImage": "", "hasImage": False, "fetched_at": "2024-01-01"},
    ]
    write_lines(root / "cache.jsonl", cache)
    out = root / "model"
    record = {"timestamp": "2024-01-01T00:00:00", "model": "jina_v3", "dimension": 2, "metadata": {"title": "t"}}
    vectors = [
        {**record, "artwork_id": "met_1", "embedding": [1.0, 0.0]},
        {**record, "artwork_id": "met_1", "embedding": [0.0, 1.0]},
        "not json",
        {**record, "artwork_id": "met_99", "embedding": [1.0, 1.0]},
    ]
    write_lines(out / "embeddings" / "jina_v3" / "embeddings.jsonl", vectors)
    told = {"has_violations": False, "violations": [], "timestamp": "2024-01-01T00:00:00", "model": "m"}
    descriptions = [
        {**told, "artwork_id": "met_1", "alt_text": "a boat", "long_description": "a boat on waves", "emoji_summary": "⛰️🌊2"},
        {**told, "artwork_id": "met_2", "alt_text": "hills", "long_description": "green hills"},
    ]
    write_lines(out / "descriptions" / "descriptions.jsonl", descriptions)
    return root


def rows_by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_first_source(spark, folder):
    items = registry.read_source(spark, "met", csv=str(folder / "first.csv"), image_cache=str(folder / "cache.jsonl"))
    got = rows_by_id(items)
    assert set(got) == {"met_1", "met_2"}
    one, two = got["met_1"], got["met_2"]
    assert one.metadata.title == 'A "red" boat,\nat sea'
    assert (one.metadata.dateBegin, one.metadata.dateEnd) == (1900, 1900)
    assert one.image.url == "http://s/1" and one.image.thumbnailUrl == "http://s/1"
    assert one.metadata.onView is True and two.metadata.onView is False
    assert one.metadata.additionalData["tags"] == "Men, Sea"
    assert one.metadata.width is None and one.metadata.artist == "Unknown"
    assert two.metadata.title == "Untitled" and two.image.url == "http://p/2"
    assert two.metadata.artistBeginDate == 1820 and two.metadata.medium == ""


def test_second_source(spark, folder):
    got = rows_by_id(registry.read_source(spark, "moma", csv=str(folder / "second.csv")))
    assert set(got) == {"moma_7", "moma_9"}
    seven, nine = got["moma_7"].metadata, got["moma_9"].metadata
    assert seven.artistBeginDate is None and nine.artistBeginDate == 1841
    assert seven.width == pytest.approx(10.5) and seven.height is None
    assert seven.sourceUrl == "https://www.moma.org/collection/works/7" and nine.sourceUrl == "http://u"
    assert got["moma_7"].image.thumbnailUrl == "http://i/400x400/a"
    assert nine.dimensions == '1" x 2"' and seven.onView and not nine.onView and nine.culture is None


def test_scan_limits(spark, folder):
    raw = files.read_catalogue(spark, str(folder / "first.csv"), schemas.SOURCE1_CSV)
    cache = files.read_jsonl(spark, str(folder / "cache.jsonl"), schemas.IMAGE_CACHE_RECORD, "object_id", "fetched_at")
    assert raw.count() == 6 and cache.count() == 3
    assert normalize.normalize_source1(raw, cache, limit=3).count() == 2
    second = files.read_catalogue(spark, str(folder / "second.csv"), schemas.SOURCE2_CSV)
    assert normalize.normalize_source2(second, limit=2).count() == 2
    assert normalize.eligible_source1(raw, need_link=False).count() == 4


def test_texts_to_embed(spark, folder):
    raw = normalize.eligible_source1(files.read_catalogue(spark, str(folder / "first.csv"), schemas.SOURCE1_CSV))
    _, descriptions = read_model_output(spark, str(folder / "model"))
    got = rows_by_id(normalize.texts_to_embed(raw, "met", descriptions, normalize.SOURCE1_LABELS, "Object ID"), "artwork_id")
    assert got["met_2"].text == (
        "Date: 1850–1860. Type: Paintings. Visual description: hills. Detailed description: green hills"
    )
    assert "Tags: Men, Sea" in got["met_1"].text and got["met_2"].artist == "Unknown"
    assert got["met_1"].has_description and not got["met_3"].has_description


def test_registry_checks_schema(spark):
    registry.register_source("bad", "Bad", lambda spark: spark.range(1))
    with pytest.raises(TypeError):
        registry.read_source(spark, "bad")
    assert {"met", "moma"} <= set(registry.source_ids())


def test_missing_and_last_wins(spark, folder, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "nowhere"), schemas.EMBEDDING_RECORD, "artwork_id").count() == 0
    vectors, descriptions = read_model_output(spark, str(folder / "model"))
    got = {(r.doc_id, r.model): list(r.vec) for r in vectors.collect()}
    assert got == {("met_1", "jina_v3"): [0.0, 1.0], ("met_99", "jina_v3"): [1.0, 1.0]}
    assert descriptions.count() == 2


def test_build_search_update(spark, folder, tmp_path):
    sources = {
        "met": {"csv": str(folder / "first.csv"), "image_cache": str(folder / "cache.jsonl"), "output": str(folder / "model")},
        "moma": {"csv": str(folder / "second.csv"), "output": str(tmp_path / "none")},
    }
    out = str(tmp_path / "collection")
    assert build_collections(spark, sources, out) == {"indexed": 4, "failed": 0}
    assert build_collections(spark, sources, out) == {"indexed": 0, "existing": True}
    assert build_collections(spark, sources, out, force=True) == {"indexed": 4, "failed": 0}
    items = spark.read.parquet(f"{out}/items")
    assert {r.collection for r in items.select("collection").distinct().collect()} == {"met", "moma"}
    one = store.item_by_id(items, "met_1").first()
    assert one.visual_emoji_array == ["⛰", "🌊", "2"]
    assert one.description_metadata.model == "m"
    vectors = spark.read.parquet(f"{out}/vectors")
    assert [tuple(r) for r in store.vectors_per_model(vectors).collect()] == [("jina_v3", 1)]
    assert list(store.vector_of(vectors, "met_1", "jina_v3").first().vec) == [0.0, 1.0]
    stats = store.index_stats(items).first()
    assert stats.documents == 4 and stats.bytes > 0
    report = {r.kind: (r.matched, r.total, r.percent) for r in coverage_report(items, *read_model_output(spark, str(folder / "model"))).collect()}
    assert report == {"jina_v3": (1, 4, 25.0), "siglip2": (0, 4, 0.0), "descriptions": (2, 4, 50.0)}

    fields = default_fields(include_descriptions=True)
    queries = spark.createDataFrame([("q", "boat"), ("kind", "Paintings")], "query_id string, text string")
    fresh = keyword_search(queries, TextIndex.of(items, fields), 10)
    stored = keyword_search(queries, TextIndex.read(spark, f"{out}/index", fields), 10)
    assert sorted(map(tuple, fresh.collect())) == sorted(map(tuple, stored.collect()))
    hits = {(r.query_id, r.doc_id) for r in fresh.collect()}
    assert ("q", "met_1") in hits and ("q", "moma_7") in hits and ("kind", "met_2") in hits

    update = spark.createDataFrame(
        [("met_2", "new", "longer", "m2", "2025-01-01T00:00:00", True, ["1900"]), ("met_77", "x", "y", "m", "t", False, [])],
        "artwork_id string, alt_text string, long_description string, model string, timestamp string, has_violations boolean, violations array<string>",
    )
    changed = rows_by_id(store.updated_items(items, update))
    assert len(changed) == 4 and changed["met_2"].visual_alt_text == "new"
    assert changed["met_1"].visual_alt_text == "a boat" and changed["met_1"].visual_emoji_array == ["⛰", "🌊", "2"]
    wanted = spark.createDataFrame([("met_1",), ("met_2",), ("met_77",)], "doc_id string")
    summary = enrich.update_summary(wanted, items, update.withColumnRenamed("artwork_id", "doc_id"), "doc_id")
    assert {r.status: r["count"] for r in summary.collect()} == {"updated": 1, "skipped": 2}


def test_duplicate_items_are_loaded_once(spark, folder, tmp_path):
    items = registry.read_source(spark, "moma", csv=str(folder / "second.csv"))
    assert store.load_items(items.unionByName(items), str(tmp_path / "items")) == {"indexed": 2, "failed": 0}


def test_image_cache_rows_and_jsonl(spark, tmp_path):
    fetched = spark.createDataFrame(
        [("1", "http://p", None, "t", None, "1900", "now"), ("2", None, None, None, None, None, "now")],
        "object_id string, primaryImage string, primaryImageSmall string, title string, artistDisplayName string, objectDate string, fetched_at string",
    )
    rows = files.image_cache_rows(fetched)
    path = str(tmp_path / "cache")
    files.write_jsonl(rows, path)
    files.write_jsonl(rows, path)
    assert files.read_jsonl(spark, path, schemas.IMAGE_CACHE_RECORD).count() == 4
    kept = rows_by_id(files.read_jsonl(spark, path, schemas.IMAGE_CACHE_RECORD, "object_id", "fetched_at"), "object_id")
    assert kept["1"].hasImage and not kept["2"].hasImage and kept["2"].title == ""
    files.write_jsonl(rows, path, append=False)
    assert files.read_jsonl(spark, path, schemas.IMAGE_CACHE_RECORD).count() == 2
    url = normalize.image_from_any(F.lit("http://u"))
    assert spark.range(1).select(url.alias("i")).first().i.url == "http://u"


def test_embed_job(spark):
    def load():
        inner = jobs.hashing_embedder(8)()

        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("no")
            return inner(texts)

        return model

    rows = spark.createDataFrame([("a", "red boat"), ("b", " "), ("c", None), ("d", "boom"), ("e", "sea")], "artwork_id string, text string")
    done = jobs.embed(rows, load, "hash", dims=4)
    got = rows_by_id(done, "artwork_id")
    assert {k: r.status for k, r in got.items()} == {"a": "processed", "b": "skipped", "c": "skipped", "d": "failed", "e": "processed"}
    assert len(got["a"].embedding) == 4 and got["a"].dimension == 4 and got["d"].embedding is None
    assert tuple(enrich.status_counts(done).first()) == (2, 2, 1)
    assert jobs.vectors_of(done).count() == 2


def test_describe_job(spark):
    def load():
        texts = {
            "ok": {"alt_text": "one two three four five six seven eight nine ten", "long_description": "A painter in 1900", "emoji_summary": "🌊, 👩"},
            "half": {"alt_text": "x", "long_description": "", "emoji_summary": "🌊"},
        }

        def model(urls):
            return [texts[u] for u in urls]

        return model

    rows = spark.createDataFrame([("a", "ok"), ("b", "half"), ("c", "unknown")], "artwork_id string, image_url string")
    got = rows_by_id(jobs.describe(rows, load, "m"), "artwork_id")
    assert {k: r.status for k, r in got.items()} == {"a": "processed", "b": "failed", "c": "failed"}
    a = got["a"]
    assert a.violations == ["1900", "painter"] and a.has_violations and a.alt_text_length_ok
    assert a.emoji_summary == "🌊👩" and a.shows_people
    counts = enrich.status_counts(jobs.describe(rows, load, "m"), F.col("has_violations")).first()
    assert tuple(counts) == (1, 0, 2, 1)


def test_staged_tables_can_be_dropped(spark):
    kept = stage(spark.range(3))
    folder = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(folder)
    assert drop_staged(spark) > 0 and not os.path.exists(folder) and drop_staged(spark) == 0


def test_repeated_updates_add_no_rows(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    updates = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "doc_id long, source string")
    got = enrich.update_matched(target, updates, "doc_id", ["source"]).collect()
    assert sorted(map(tuple, got)) == [(1, "y"), (2, "b")]


def test_resume_by_anti_join(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "artwork_id long")
    done = rows.where("artwork_id IN (0, 3)")
    assert [r.artwork_id for r in enrich.backlog(rows, done, "artwork_id", limit=3).collect()] == [1, 2, 4]


def test_query_cache(spark):
    now = datetime(2024, 1, 10)
    key = lambda s: spark.range(1).select(query_cache.text.cache_key(F.lit(s))).first()[0]
    cache = spark.createDataFrame(
        [(key("sea"), [1.0], [1.0], now - timedelta(minutes=30)), (key("sky"), [1.0], [1.0], now - timedelta(hours=2)),
         (key("old"), [1.0], [1.0], now - timedelta(days=8)), (key("idle"), [1.0], [1.0], now - timedelta(days=2))],
        schemas.QUERY_CACHE,
    )
    log = spark.createDataFrame([("1", " SEA"), ("2", "sky"), ("3", "old"), ("4", "New"), ("5", "new ")], "query_id string, text string")
    at = F.lit(now)
    assert {r.query_id: r.cache_hit for r in query_cache.lookup(log, cache, at).collect()} == {"1": True, "2": True, "3": False, "4": False, "5": False}
    assert {r.text for r in query_cache.to_embed(log, cache, at).collect()} == {"old", "New"}
    after = {r.cache_key: r.ts for r in query_cache.after_use(cache, log, at).collect()}
    assert after == {key("sea"): now - timedelta(minutes=30), key("sky"): now, key("idle"): now - timedelta(days=2)}
    fresh = spark.createDataFrame([(key("old"), [2.0], [2.0], now), (key("half"), [2.0], None, now)], schemas.QUERY_CACHE)
    merged = rows_by_id(query_cache.merged(cache, fresh), "cache_key")
    assert list(merged[key("old")].jina_v3) == [2.0] and key("half") not in merged and len(merged) == 4


def test_embed_missing(spark):
    now = F.lit(datetime(2024, 1, 10))
    cache = spark.createDataFrame([], schemas.QUERY_CACHE)
    log = spark.createDataFrame([("1", "sea"), ("2", "SEA "), ("3", "sky")], "query_id string, text string")
    models = {"jina_v3": jobs.hashing_embedder(4), "siglip2": jobs.hashing_embedder(6)}
    fresh = query_cache.embed_missing(log, cache, models, now)
    filled = query_cache.merged(cache, fresh.select("cache_key", "jina_v3", "siglip2", "ts"))
    assert filled.count() == 2
    assert query_cache.to_embed(log, filled, now).count() == 0


def test_incremental_ingest(spark, tmp_path):
    source, target, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    schema = "artwork_id string, alt_text string, timestamp string"
    write_lines(source / "a.jsonl", [{"artwork_id": "x", "alt_text": "1", "timestamp": "2024-01-01"}, {"artwork_id": "x", "alt_text": "2", "timestamp": "2024-01-01"}, "junk"])
    run = lambda: ingest_records(spark, str(source), schema, "artwork_id", target, check).awaitTermination()
    run()
    write_lines(source / "b.jsonl", [{"artwork_id": "x", "alt_text": "3", "timestamp": "2024-02-01"}, {"artwork_id": "y", "alt_text": "4", "timestamp": "2023-01-01"}])
    run()
    run()
    got = rows_by_id(read_ingested(spark, target, "artwork_id"), "artwork_id")
    assert {k: r.alt_text for k, r in got.items()} == {"x": "3", "y": "4"}
    assert spark.read.parquet(target).count() == 3
    compact(spark, target, str(tmp_path / "snapshot"), "artwork_id")
    assert spark.read.parquet(str(tmp_path / "snapshot")).count() == 2
    again = rows_by_id(read_ingested(spark, str(tmp_path / "snapshot"), "artwork_id"), "artwork_id")
    assert again["x"].alt_text == "3"


def test_query_stream(spark, tmp_path):
    rows = [("sea", "2024-01-01 00:00:00"), (" SEA ", "2024-01-02 00:00:00"), ("sky", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "text string, ts string").selectExpr("text", "CAST(ts AS TIMESTAMP) ts").coalesce(1).write.parquet(str(tmp_path / "q"))
    stream = first_in_week(spark.readStream.schema("text string, ts timestamp").parquet(str(tmp_path / "q")))
    query = stream.writeStream.format("memory").queryName("fresh_queries").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("fresh_queries").select("cache_key").distinct().count() == spark.table("fresh_queries").count() == 2
