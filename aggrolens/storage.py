"""Tables and paths in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir or, where that is unset, in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written to the shared folder and read back: computed once, however often it is used, and safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table in a partition a core, for costly functions on a table of few pieces; one that has a piece for every second core at least stays as it is, so what is moved is never more than a piece a core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() > cores else df.repartition(cores)
