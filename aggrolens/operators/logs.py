"""Detection logs, running counters and page alerts, as windows over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT


def last_entries(detections: DataFrame, scope: str, order: str, most: int = DEFAULT.log_rows) -> DataFrame:
    """The newest `most` entries of each scope, with texts cut and scores rounded for the log."""
    rank = F.row_number().over(W.partitionBy(scope).orderBy(F.desc(order)))
    d = detections.withColumn("age", rank).where(F.col("age") <= most)
    return d.withColumn("text", F.substring("text", 1, DEFAULT.log_chars)).withColumn("score", F.round("score", 3))


def running_totals(detections: DataFrame, scope: str, order: str) -> DataFrame:
    w = W.partitionBy(scope).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = detections.withColumn("total", F.count("*").over(w)).withColumn("aggressive", F.sum("flagged").over(w))
    return d.withColumn("safe", F.greatest(F.lit(0), F.col("total") - F.col("aggressive")))


def page_alerts(detections: DataFrame, scope: str, order: str, unit: str, after: int = DEFAULT.alert_after) -> DataFrame:
    """scope and the order at which its `after`-th different flagged unit came."""
    first = detections.groupBy(scope, unit).agg(F.min(F.when(F.col("flagged") == 1, F.col(order))).alias("at")).where("at is not null")
    rank = F.row_number().over(W.partitionBy(scope).orderBy("at", unit))
    return first.withColumn("n", rank).where(F.col("n") == after).select(scope, F.col("at").alias("alert_at"))
