"""Bucketed tables, streams into them, sliding life times and CSV records across byte ranges."""

import csv
import io
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registered import storage_queries
from vitrine import constants as C
from vitrine.sources.buckets import BucketStore, Conflict
from vitrine.sources.quoted_csv import read_quoted_catalogue, read_records
from vitrine.streaming.ingest import ingest_into
from vitrine.streaming.query_keys import needing_vectors, rocksdb_state

SCHEMA = "id long, v string, ts int"


def rows(df):
    return {r.id: (r.v, r.ts) for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    held = BucketStore(spark, str(tmp_path / "table"))
    held.create(spark.createDataFrame([*[(i, f"v{i}", 0) for i in range(40)], (7, "late", 5), (None, "none", 0)], SCHEMA), "id", 8, [F.desc("ts")])
    return held


def files(store):
    return {f: f.stat().st_mtime_ns for f in Path(store.path, "data").rglob("*.parquet")}


def test_changes_rewrite_touched_buckets_only(spark, store):
    want = {i: (f"v{i}", 0) for i in range(40)} | {7: ("late", 5)}
    assert rows(store.read()) == want
    before, first = files(store), store.manifest().versions
    touched = store.update(spark.createDataFrame([(3, "new", 1), (99, "unknown", 1), (None, "x", 1)], SCHEMA), ["v"])
    want[3] = ("new", 0)
    assert rows(store.read()) == want and 1 <= len(touched) <= 3
    after = files(store)
    assert all(after[f] == t for f, t in before.items())
    assert {b for b, v in store.manifest().versions.items() if first[b] != v} == set(touched)
    store.upsert(spark.createDataFrame([(3, "older", -1), (5, "newer", 9), (50, "added", 1)], SCHEMA), [F.desc("ts")])
    want |= {5: ("newer", 9), 50: ("added", 1)}
    assert rows(store.read()) == want
    store.delete(spark.createDataFrame([(i,) for i in range(0, 40, 2)], "id long"))
    want = {i: v for i, v in want.items() if i % 2 or i >= 40}
    assert rows(store.read()) == want
    assert rows(store.look_up(spark.createDataFrame([(5,), (6,)], "id long"))) == {5: ("newer", 9)}
    assert store.vacuum() > 0 and rows(store.read()) == want and store.vacuum() == 0


def test_buckets_can_become_empty_and_fill_again(spark, store):
    store.delete(store.read().select("id"))
    assert store.read().count() == 0 and store.manifest().versions == {}
    assert store.update(spark.createDataFrame([(1, "x", 1)], SCHEMA), ["v"]) == []
    store.upsert(spark.createDataFrame([(1, "x", 1)], SCHEMA), [F.desc("ts")])
    assert rows(store.read()) == {1: ("x", 1)}


def test_the_second_of_two_writers_fails_and_nothing_is_lost(spark, store, monkeypatch):
    stale = store.manifest()
    store.update(spark.createDataFrame([(1, "first", 1)], SCHEMA), ["v"])
    slow = BucketStore(spark, store.path)
    monkeypatch.setattr(slow, "manifest", lambda: stale)
    with pytest.raises(Conflict):
        slow.update(spark.createDataFrame([(2, "second", 1)], SCHEMA), ["v"])
    assert rows(store.read())[1] == ("first", 0) and rows(store.read())[2] == ("v2", 0)
    with pytest.raises(FileExistsError):
        store.create(spark.createDataFrame([], SCHEMA), "id", 2)


def test_stream_into_a_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = BucketStore(spark, str(tmp_path / "t"))
    store.create(spark.createDataFrame([], SCHEMA), "id", 4)
    put = lambda name, rows_: (folder / name).write_text("".join(json.dumps(dict(zip(("id", "v", "ts"), r))) + "\n" for r in rows_) + "no json\n")
    run = lambda: ingest_into(spark, str(folder), SCHEMA, store, str(tmp_path / "c"), "ts", 1).awaitTermination()
    put("a.json", [(1, "a", 1), (2, "b", 5)])
    put("b.json", [(1, "c", 3), (2, "older", 2), (3, "d", None)])
    run()
    assert rows(store.read()) == {1: ("c", 3), 2: ("b", 5), 3: ("d", None)}
    number = store.manifest().number
    run()
    assert store.manifest().number == number
    put("c.json", [(3, "e", 1)])
    run()
    assert rows(store.read())[3] == ("e", 1)
    again = spark.createDataFrame([(1, "twice", 99)], SCHEMA)
    writer = next(iter(store.manifest().applied))
    assert store.upsert(again, [F.desc("ts")], writer, store.manifest().applied[writer]) == []


def by_hand(events):
    made, out = {}, []
    for at, text in sorted(events):
        key = text.strip().lower()
        if key not in made or at - made[key] >= C.CACHE_TTL_SECONDS:
            made[key] = at
            out.append((key, at))
        elif at - made[key] > C.CACHE_REFRESH_SECONDS:
            made[key] = at
    return sorted(out)


def test_uses_renew_the_life_of_vectors(spark, tmp_path):
    """In several batches: a key asked for every six days passes once, one asked for after eight days again."""
    day = 24 * 3600
    events = [(i * 6 * day, "Sea ") for i in range(9)] + [(0, "sky"), (8 * day, "SKY"), (8 * day + 60, "sky"), (9 * day, "sky"), (50 * day, "sky")]
    rng = random.Random(3)
    events += [(rng.randrange(60 * day), rng.choice(["oil", "ink", "Ink"])) for _ in range(60)]
    events = sorted((1_700_000_000 + at, text) for at, text in events)
    before = rocksdb_state(spark)
    try:
        for n, part in enumerate([events[:30], events[30:50], events[50:]]):
            df = spark.createDataFrame([(t, at) for at, t in part], "text string, at long").selectExpr("text", "timestamp_seconds(at) AS ts")
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = needing_vectors(spark, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
            sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
            sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    out = spark.read.parquet(str(tmp_path / "out")).selectExpr("lower(trim(text)) AS text", "unix_seconds(ts) AS ts").collect()
    assert sorted((r.text, r.ts) for r in out) == by_hand(events)
    assert sum(r.text == "sea" for r in out) == 1


HEAD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "text", "more", "missing")])


@pytest.mark.parametrize("bytes_", [61, 1 << 20])
def test_csv_records_across_ranges(spark, tmp_path, bytes_):
    rng = random.Random(bytes_)
    values = ["plain", "", "a,b", 'say ""hi""'.replace('""', '"'), "line\nend", "\n\n", '"', "tail\n", "é日\n本", "x" * 90, "many\n" * 30]
    want = []
    for name, crlf in (("a.csv", "\n"), ("b.csv", "\r\n")):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=crlf)
        columns = ["id", "text", "more"] if crlf == "\n" else ["more", "id", "text"]
        writer.writerow(columns)
        for i in range(14):
            row = {"id": f"{name}{i}", "text": rng.choice(values), "more": rng.choice(values)}
            writer.writerow([row[c] for c in columns])
            want.append((row["id"], row["text"], row["more"], ""))
        (tmp_path / name).write_bytes(("﻿" if crlf == "\n" else "").encode() + out.getvalue().encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert sorted(map(tuple, read_quoted_catalogue(spark, str(tmp_path), HEAD).collect())) == sorted(want)
        starts = read_records(spark, str(tmp_path)).select("path", "start").distinct().count()
        assert starts > (10 if bytes_ == 61 else 1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n")
    assert read_quoted_catalogue(spark, str(tmp_path), HEAD).count() == 0


def test_csv_query_writes_a_file_per_task(spark, tmp_path, monkeypatch):
    """No task writes all rows; texts that span lines, and each file's mark and header, are read as before."""
    rows = [(i, None if i % 7 == 0 else f'line "{i}"\nnext, {i}', "web" if i % 2 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    docs.write.option("maxRecordsPerFile", 10).parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(storage_queries, "_folder", lambda _: str(tmp_path / "csv"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "2k")
    try:
        got = storage_queries.csv_multi_line(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted((str(i), text or "", source or "", "") for i, text, source in rows)
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) > 1
