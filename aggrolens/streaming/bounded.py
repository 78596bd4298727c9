"""Streams whose state stays small: units once within a watermark, tabs and activations, diagnostics."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(units: DataFrame, key: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """A stream's units, each key once. A key is remembered until the newest unit is `late` past it, so the state grows with the pace of a stream and not with its age; what comes later than that is dropped and counted (see late_rows)."""
    return units.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's recent batches dropped for being late."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after each recent batch that had rows."""
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]


# --- tabs --------------------------------------------------------------------------------------

SHOWN = "scope long, seq long, tab long, total long, aggressive long"


def activations(events: DataFrame) -> DataFrame:
    """scope, seq, tab, total, aggressive: what a scope shows from each activation on, from events (scope, seq, tab, kind, flagged). Batch form."""
    d = events.withColumn("one", (F.col("kind") == "detection").cast("long"))
    so_far = W.partitionBy("scope", "tab").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    total, flagged = (F.coalesce(F.sum(c).over(so_far), F.lit(0)).cast("long") for c in (F.col("one"), F.col("one") * F.col("flagged")))
    return d.withColumn("total", total).withColumn("aggressive", flagged).where("kind = 'activation'").select("scope", "seq", "tab", "total", "aggressive")


def shown_tabs(events: DataFrame) -> DataFrame:
    """The stream form of activations(): detections and activations are two kinds of event in one state of a scope.

    An activation clears what the scope shows and the tab publishes its own counters anew;
    detections count for their tab, shown or not. A closed tab's counters go. State: two numbers a
    tab. Events of a scope must come in order of seq from batch to batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tabs, totals, flags = state.get if state.exists else ([], [], [])
        counts = {t: [a, b] for t, a, b in zip(tabs, totals, flags, strict=True)}
        rows = sorted((int(q), k, int(t), int(f)) for b in batches for q, k, t, f in zip(b["seq"], b["kind"], b["tab"], b["flagged"], strict=True))
        out = []
        for seq, kind, tab, flagged in rows:
            own = counts.setdefault(tab, [0, 0])
            if kind == "detection":
                own[0], own[1] = own[0] + 1, own[1] + flagged
            elif kind == "activation":
                out.append((int(key[0]), seq, tab, *own))
            else:
                counts.pop(tab)
        state.update(([*counts], [x[0] for x in counts.values()], [x[1] for x in counts.values()]))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SHOWN.split(", ")])

    d = events.select("scope", "seq", "tab", "kind", "flagged")
    return d.groupBy("scope").applyInPandasWithState(step, SHOWN, "tabs array<long>, totals array<long>, flags array<long>", "append", GroupStateTimeout.NoTimeout)


# --- diagnostics -------------------------------------------------------------------------------

ENTRIES = "level string, area string, message string, details map<string,string>"


class Diagnostics(StreamingQueryListener):
    """The newest `most` entries on streams that run: batches with observed errors or late rows, and queries that fail. Add it with spark.streams.addListener."""

    def __init__(self, most: int = 50) -> None:
        self.entries: deque = deque(maxlen=most)
        self.lock, self.ended = threading.Lock(), set()

    def record(self, level: str, area: str, message: str, **details) -> None:
        with self.lock:
            self.entries.append((level, area, message, {k: str(x) for k, x in details.items()}))

    def recent(self) -> list[tuple]:
        with self.lock:
            return [(a, b, c, dict(d)) for a, b, c, d in self.entries]

    def clear(self) -> None:
        with self.lock:
            self.entries.clear()

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.recent(), ENTRIES)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for name, row in p.observedMetrics.items():
            seen = row.asDict()
            if seen.get("errors"):
                self.record("warning", name, f"{seen['errors']} of {seen['rows']} rows failed", batch=p.batchId)
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        if late:
            self.record("warning", p.name or "stream", f"{late} rows came late", batch=p.batchId)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.record("error", "stream", event.exception.splitlines()[0], id=event.id)
        self.ended.add(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 20.0) -> None:
        """Until the listener has heard of a query's end."""
        end = time.time() + seconds
        while str(query.runId) not in self.ended and time.time() < end:
            time.sleep(0.05)


def observed(found: DataFrame, name: str, failed: Column) -> DataFrame:
    """found, with its rows and failed rows counted as they pass, for Diagnostics."""
    return found.observe(name, F.count("*").alias("rows"), F.count_if(failed).alias("errors"))
