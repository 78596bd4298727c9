"""Shared pieces: materialising frames, vectorised byte hashing, connected components."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests), the warehouse, which all executors share too."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed with its application's others when the driver ends."""
    own = f"{shared_dir(spark)}/aggrolens-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_tidy, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


_OWN: set[str] = set()


def _tidy(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except (Py4JError, OSError, AttributeError):
        pass  # the session has ended already


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read back: its lineage is cut, its size known, and its files outlive executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove saved tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._saved_at)


def most_frequent(counts: DataFrame, key: str, by: str, n: int) -> list:
    """The n keys of the highest counts, ties by key. Only keys that reach the count of the n-th are sorted and fetched, not each partition's best."""
    reach, left = None, n
    for row in sorted(counts.groupBy(by).agg(F.count("*").alias("keys")).collect(), reverse=True):
        reach, left = row[by], left - row["keys"]
        if left <= 0:
            break
    if reach is None:
        return []
    return [r[key] for r in counts.where(F.col(by) >= reach).orderBy(F.desc(by), key).limit(n).collect()]


# --- bytes of many texts at once ------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _powers(n: int, sign: int) -> np.ndarray:
    """The first n powers of the base (sign 1) or of its inverse (-1), modulo 2**64."""
    if len(_POWERS[sign]) < n:
        x = np.full(max(n, 1 << 16), _BASE if sign == 1 else _BASE_INV, np.uint64)
        x[0] = 1
        _POWERS[sign] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[sign][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = sum of code(data[x]) * base**x over i <= x < j."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * _powers(len(data), 1), dtype=np.uint64, out=p[1:])
    return p


def span_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), by content alone."""
    return mixed((p[end] - p[start]) * _powers(len(p), -1)[start])


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# --- connected components --------------------------------------------------------------------


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of edges reaches.

    Alternating large-star and small-star steps; each is an aggregate (minimum of a node's
    neighbours, combined on the map side) and a join on the node whose skewed partitions Spark
    can split. Every half step is written to the shared folder, so a lost executor costs one
    step at most. Loops and repeated edges are allowed; null nodes are left out. An empty frame gives an empty one.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    e = saved(e)
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct())
        forget(e, low)
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        forget(large, low)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
