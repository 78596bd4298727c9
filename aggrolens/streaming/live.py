"""Live scans as streams: whole verdicts, per-scope logs and counters, alerts per visit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT
from ..operators import scoring as s
from ..storage import shared_path  # noqa: F401

#: How often page changes are gathered.
CADENCE = "400 milliseconds"


def start(stream: DataFrame, path: str, each: Callable[[DataFrame], DataFrame] | None = None, once: bool = True, mode: str = "append", cadence: str = CADENCE) -> StreamingQuery:
    """Write a stream batch by batch under path, through `each` if given. A batch that runs again overwrites its own folder, so every row is there once.

    once: what is there now and then end, as for a first scan; else every `cadence`. After settings change, stop
    the query and start it on a new path: it scans everything again by them.
    """

    def write(batch: DataFrame, number: int) -> None:
        (batch if each is None else each(batch)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode(mode)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=cadence)).start()


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/rows")


def fenced(found: DataFrame, current: DataFrame, scope: str) -> DataFrame:
    """Rows of found (scope, generation) that still belong to their scope's present generation and whose scope is enabled: current has scope, generation, enabled, a row per scope."""
    now = current.where("enabled").select(scope, "generation")
    return found.join(now, [scope, "generation"], "left_semi")


VERDICTS = "conv_id long, turn long, text string, verdict string, score double, flagged int, error string"


def live_detections(units: DataFrame, model: DataFrame | None, path: str, mode: str = "hybrid", **lists) -> DataFrame:
    """Scan a stream of units, each (conv_id, turn) once, by the whole order of live verdicts; the written rows."""
    key = ["conv_id", "turn"]
    start(units.dropDuplicates(key), path, lambda b: s.live_verdicts(b, model, key, mode, **lists)).awaitTermination()
    return written(units.sparkSession, path, VERDICTS).drop("batch")


def verdict_stream(units: DataFrame, model: DataFrame | None, path: str, mode: str = "hybrid", **lists) -> DataFrame:
    """Whole verdicts of a stream of units as a stream again, for operators with state of their own: each (conv_id, turn) once, exempt ones left out.

    Scoring joins and aggregates, which only batches can, so a first query writes verdicts under path and what is returned reads
    them. A batch of the first that ran again has new files; its repeated rows are dropped by key.
    """
    live_detections(units, model, path, mode, **lists)
    found = units.sparkSession.readStream.schema(f"{VERDICTS}, batch long").parquet(f"{path}/rows")
    return found.where("verdict <> 'exempt'").drop("batch").dropDuplicates(["conv_id", "turn"])


LOG = "scope long, total long, aggressive long, safe long, turns array<long>, texts array<string>, scores array<double>, flags array<int>"


def running_log(found: DataFrame, scope: str = "conv_id", order: str = "turn", most: int = DEFAULT.log_rows, chars: int = DEFAULT.log_chars) -> DataFrame:
    """After each batch, its scopes' counters and newest `most` entries, newest first. Exempt units aren't counted. A scope's state is that and no more."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, aggressive, turns, texts, scores, flags = state.get if state.exists else (0, 0, [], [], [], [])
        log = list(zip(turns, texts, scores, flags, strict=True))
        for b in batches:
            b = b[b["verdict"] != "exempt"]
            total, aggressive = total + len(b), aggressive + int(b["flagged"].sum())
            new = [(int(o), x[:chars], round(float(p), 3), int(f)) for o, x, p, f in zip(b[order], b["text"], b["score"], b["flagged"], strict=True)]
            log = sorted(log + new, key=lambda e: -e[0])[:most]
        columns = [list(c) for c in zip(*log, strict=True)] if log else [[], [], [], []]
        state.update((total, aggressive, *columns))
        yield pd.DataFrame([[key[0], total, aggressive, max(0, total - aggressive), *columns]], columns=["scope", "total", "aggressive", "safe", "turns", "texts", "scores", "flags"])

    kept = found.select(scope, order, "text", F.coalesce("score", F.lit(0.0)).alias("score"), "flagged", "verdict")
    state = LOG.replace("scope long, ", "").replace("safe long, ", "")
    return kept.groupBy(scope).applyInPandasWithState(step, LOG, state, "update", GroupStateTimeout.NoTimeout)


def present(log: DataFrame) -> DataFrame:
    """The newest row of each scope in a written running_log: what the scope that is looked at shows."""
    return log.groupBy("scope").agg(F.max_by(F.struct(*[c for c in log.columns if c not in ("scope", "batch")]), "batch").alias("now")).select("scope", "now.*")


def visit_alerts(found: DataFrame, scope: str = "conv_id", visit: str = "visit", unit: str = "turn", after: int = DEFAULT.alert_after) -> DataFrame:
    """scope, visit, alert_at: the unit whose flag is the `after`-th different one of a visit, once for each scope ever.

    A new visit starts the count anew but not the warning; units of an earlier visit than the
    present one are stale and don't count. State: the visit, at most `after` units, the warning.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, seen, warned = state.get if state.exists else (-1, [], False)
        for at, x in sorted({(int(a), int(u)) for b in batches for a, u, f in zip(b[visit], b[unit], b["flagged"], strict=True) if f == 1}):
            if at > now:
                now, seen = at, []
            if at == now and not warned and x not in seen:
                seen = [*seen, x]
                if len(seen) == after:
                    warned = True
                    yield pd.DataFrame({scope: [key[0]], visit: [at], "alert_at": [x]})
        state.update((now, seen, warned))

    return found.select(scope, visit, unit, "flagged").groupBy(scope).applyInPandasWithState(step, f"{scope} long, {visit} long, alert_at long", "now long, seen array<long>, warned boolean", "append", GroupStateTimeout.NoTimeout)


def shown(stream: DataFrame, name: str, seconds: int = 1, mode: str = "update") -> StreamingQuery:
    """A stream's rows as an in-memory table, looked at every second: for small totals only."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(processingTime=f"{seconds} seconds").start()
