"""Streaming detection: scored units, each once, and page alerts kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT
from ..functions import text as t
from ..functions import vocab as v
from ..operators import scoring as s
from ..storage import shared_path

UNITS = "conv_id long, turn long, role string, text string"


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the units under path, a folder or a single file (as a pattern, which the source takes for either)."""
    return spark.readStream.schema(UNITS).parquet(f"{path[:-1]}[{path[-1]}]")


def detections(units: DataFrame, key: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Units, batch or stream, each scored once by its first words: lex, verdict, flagged. A scorer's error can't stop a stream: expressions give null, and null counts as safe."""
    exempt = s.listed(F.col("text"), v.WHITELIST) & ~s.listed(F.col("text"), v.BLOCKLIST)
    d = units.where("text is not null").where(~exempt).dropDuplicates(list(key)).withColumn("cut", t.first_words(F.col("text")))
    d = s.score_lexicon(d, "cut").withColumn("verdict", s.verdict(F.col("text"), F.coalesce("lex", F.lit(0.0)), v.BLOCKLIST, v.WHITELIST))
    score = F.when(F.col("verdict") == "blocked", 1.0).otherwise(F.col("lex"))
    return d.select(*key, "text", score.alias("score"), "verdict", F.col("verdict").isin("blocked", "aggressive").cast("int").alias("flagged"))


def streamed_alerts(found: DataFrame, scope: str = "conv_id", unit: str = "turn", after: int = DEFAULT.alert_after) -> DataFrame:
    """scope and alert_at: the unit whose flag is a scope's `after`-th. A scope's state is at most `after` units and whether it has been warned of, which never expires."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, warned = state.get if state.exists else ([], False)
        units = sorted({int(x) for b in batches for x in b[unit][b["flagged"] == 1]})
        for x in units:
            if not warned and x not in seen:
                seen = [*seen, x]
                if len(seen) == after:
                    warned = True
                    yield pd.DataFrame({scope: [key[0]], "alert_at": [x]})
        state.update((seen, warned))

    # a filter on flagged would be pushed down as the whole scoring expression, several times over
    return found.select(scope, unit, "flagged").groupBy(scope).applyInPandasWithState(step, f"{scope} long, alert_at long", "seen array<long>, warned boolean", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run a stream over what is there, in append mode, into a Parquet table, and read that."""
    spark = stream.sparkSession
    path = path or shared_path(spark, "stream")
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
