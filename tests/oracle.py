"""Side-by-side check of the registered queries against their SQL twins."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, int):
        return value
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def _types(df, relation) -> str:
    want = dict(zip(relation.columns, map(str, relation.types)))
    odd = [f"{n}: {t} vs {want.get(n)}" for n, t in df.dtypes if SAME_TYPE.get(t) != want.get(n)]
    return "types " + ", ".join(odd) if odd else ""


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, sf_dir)
    got, got_columns = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want, want_columns = _rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    odd_types = _types(df, con.sql(sql))
    if odd_types:
        return odd_types
    if not got:
        return "no rows"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} vs {len(want)}; only here {only_got}; only there {only_want}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from vitrine.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            if name in oracle:
                verdict = compare(spark, con, query, oracle[name], sf_dir) or "equal"
            else:
                verdict = f"no oracle, {query(spark, sf_dir).count()} rows"
        except Exception as error:  # report every query
            verdict = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - started:6.1f}s  {verdict}", flush=True)
