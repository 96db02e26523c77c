"""Query stream to the queries that need vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine import constants as C
from vitrine.plans.query_cache import with_key
from vitrine.session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_in_week(queries: DataFrame, time: str = "ts") -> DataFrame:
    """A query passes if its key has not passed within the cache's life time.

    State holds one entry per key and is dropped as the watermark moves on.
    """
    keyed = with_key(queries).withWatermark(time, f"{C.CACHE_TTL_SECONDS} seconds")
    return keyed.dropDuplicatesWithinWatermark(["cache_key"])


def _frame(rows: list[tuple[str, str, int]]) -> pd.DataFrame:
    """Plain objects, as Spark does not take the string type of newer pandas here."""
    key, text, micros = zip(*rows) if rows else ((), (), ())
    return pd.DataFrame({"cache_key": pd.Series(key, dtype=object), "text": pd.Series(text, dtype=object), "micros": pd.Series(micros, dtype="int64")})


class _LifeTime(StatefulProcessor):
    """Per key, until when its vectors live: a life time from being made or last renewed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("made", "made long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["micros", "text"], kind="stable")
        made = self.state.get()[0] if self.state.exists() else None
        before = made
        passed = []
        for at, text in zip(batch["micros"].tolist(), batch["text"].tolist()):
            if made is None or at - made >= C.CACHE_TTL_SECONDS * 1_000_000:
                made = at
                passed.append((key[0], text, at))
            elif at - made > C.CACHE_REFRESH_SECONDS * 1_000_000:
                made = at
        if made != before:
            self.state.update((made,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(made // 1000 + C.CACHE_TTL_SECONDS * 1000)
        yield _frame(passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield _frame([])

    def close(self) -> None:
        pass


def needing_vectors(spark: SparkSession, queries: DataFrame, time: str = "ts", delay_seconds: int = 0) -> DataFrame:
    """``cache_key, text, ts`` of the queries of a stream whose key has no live vectors.

    Vectors live a week from being made, and each use that finds them over an hour old renews them, so a key that is
    asked for time and again passes once. State holds one number per key; a timer drops it when the life time has run
    out by the watermark, ``delay_seconds`` behind the newest query. The state lives in RocksDB, which
    the session's state store has to be (see ``rocksdb_state``).
    """
    ship_package(spark)
    keyed = with_key(queries).where(f"{time} IS NOT NULL").withWatermark(time, f"{delay_seconds} seconds")
    plain = keyed.selectExpr("cache_key", "text", f"unix_micros({time}) AS micros", f"{time} AS event_time")
    passed = plain.groupBy("cache_key").transformWithStateInPandas(
        statefulProcessor=_LifeTime(), outputStructType="cache_key string, text string, micros long", outputMode="Append", timeMode="EventTime"
    )
    return passed.selectExpr("cache_key", "text", "timestamp_micros(micros) AS ts")


def rocksdb_state(spark: SparkSession) -> dict[str, str | None]:
    """Keep the state of streams in RocksDB, without disk reserved in advance; gives what was set before."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    return before
