"""Scans that wait until a scope is quiet: bursts of changes give one scan each."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: How long nothing may change before a scan.
QUIET_MS = 400
SCANS = "scope long, first_at long, last_at long, records long, nodes array<long>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def bursts(events: DataFrame, scope: str, at: str, quiet: str = f"{QUIET_MS} milliseconds", late: str | None = None, **values: Column) -> DataFrame:
    """scope, first_at, closes_at (the last record's time and the quiet after it), records, and values, aggregates, of each burst by the records' own times: records that follow one another within `quiet`.

    Batch or stream; a stream needs `late`, how far behind its newest record one may come, and gives
    a burst when no such record can extend it. Session windows: sums are combined before the shuffle.
    """
    d = events if late is None else events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = d.groupBy(scope, F.session_window(at, quiet)).agg(F.count("*").alias("records"), *[c.alias(k) for k, c in values.items()])
    return w.select(scope, F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("closes_at"), "records", *values)


class QuietScope(StatefulProcessor):
    """Collects a scope's changed nodes and gives them once nothing has come for `quiet_ms` of the clock. Each record puts the timer off. State: the different nodes of the open burst, dropped when it is given."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "first_at long, last_at long, records long")
        self.nodes = handle.getMapState("nodes", "node long", "times long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentProcessingTimeInMs()
        first, records = now, 0
        if self.burst.exists():
            first, _, records = self.burst.get()
        for b in rows:
            records += len(b)
            for node in b["node"].unique():
                self.nodes.updateValue((int(node),), (1,))
        self.burst.update((first, now, records))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.quiet_ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.burst.exists():
            return
        first, last, records = self.burst.get()
        nodes = sorted(int(n[0]) for n in self.nodes.keys())
        self.burst.clear()
        self.nodes.clear()
        yield pd.DataFrame({"scope": [int(key[0])], "first_at": [first], "last_at": [last], "records": [records], "nodes": [nodes]})

    def close(self) -> None:
        pass


def quiet_scans(records: DataFrame, scope: str = "page_id", quiet_ms: int = QUIET_MS) -> DataFrame:
    """A stream of scans: a row for each burst of a scope's change records (scope, node), when the scope has been quiet for quiet_ms of the clock. Needs the RocksDB state store: see started()."""
    d = records.select(F.col(scope).cast("long").alias("scope"), F.col("node").cast("long").alias("node"))
    return d.groupBy("scope").transformWithStateInPandas(QuietScope(quiet_ms), SCANS, "Append", "ProcessingTime")


def started(scans: DataFrame, path: str, cadence: str = "100 milliseconds") -> StreamingQuery:
    """Write scans as a table under path, looking at the clock every `cadence`, with the state store that timers need."""
    spark = scans.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        w = scans.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
        return w.outputMode("append").trigger(processingTime=cadence).start()
    finally:
        spark.conf.set(PROVIDER, before)


def written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCANS).parquet(f"{path}/rows")


def given(spark: SparkSession, path: str) -> int:
    """Records in the scans that are written so far."""
    try:
        return written(spark, path).agg(F.sum("records")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise


def until(query: StreamingQuery, written: Callable[[], int], total: int, seconds: float = 3600.0) -> None:
    """Let a query run until written() has come to total, and stop it. `seconds` in which it doesn't grow are an error, as what is there then lacks rows. It is asked less often as a run gets longer, at least every two seconds."""
    start = grown = time.time()
    before = 0
    try:
        while query.isActive and (now := written()) != total:
            if now != before:
                before, grown = now, time.time()
            if time.time() - grown > seconds:
                raise TimeoutError(f"{now} of {total} records written, and no more in {seconds} seconds")
            time.sleep(min(2.0, max(0.2, (time.time() - start) / 20)))
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
