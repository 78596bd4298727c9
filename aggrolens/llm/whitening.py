"""Whitening of embeddings by the eigenvectors of their covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .vectors import matrix

SCALE, SHIFT = 64, 1_000_000
#: x-vectors are whole numbers within these bounds; larger components count as these.
LARGEST = 1 << 62
#: Components whose variance is under this share of the largest one are rounding, not directions.
FLAT = 1e-13


def whole(v: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000 of each component."""
    return np.clip(np.floor(SCALE * v), -LARGEST, LARGEST - SHIFT - 1).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit numbers if they are large enough, else Python's."""
    most = max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums))
    kind = np.int64 if most < 1 << 61 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def deviations(d: np.ndarray) -> list[int | None]:
    """Sums of squares of each row; None where one doesn't fit 64 bits. Only rows near that bound are added up in Python."""
    about = (d.astype(float) ** 2).sum(axis=1) / 2.0**63
    small = about < 0.99
    out: list[int | None] = [None] * len(d)
    for i, s in zip(np.flatnonzero(small), (d[small].astype(np.int64) ** 2).sum(axis=1).tolist(), strict=True):
        out[i] = s
    for i in np.flatnonzero(~small & (about < 1.01)):
        s = sum(int(c) ** 2 for c in d[i])
        out[i] = s if s < 1 << 63 else None
    return out


def dimensions(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows whose vector is complete: not null or empty, of finite components, of the commonest length (the largest of several)."""
    d = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    d = d.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = d.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).first()
    return d.where(F.size("v") == (sizes["size"] if sizes else -1))


def totals(d: DataFrame) -> tuple[int, list[int]]:
    """Number of x-vectors and their sum per dimension, exact. Tasks add up high and low halves; a row a batch and dimension is shuffled."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = whole(matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1]), pa.int32()), pa.array([len(x)] * x.shape[1], pa.int64()), pa.array((x >> 32).sum(axis=0)), pa.array((x & 0xFFFFFFFF).sum(axis=0))], ["at", "n", "high", "low"])

    sums = d.select("v").mapInArrow(added, "at int, n long, high long, low long").groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    got = sorted(sums.collect(), key=lambda r: r["at"])  # one row a dimension
    return (got[0]["n"] if got else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in got]


def covariance(vectors: DataFrame, n: int) -> np.ndarray:
    """RowMatrix's Gramian of a column `c` of centred rows, divided by n."""
    ml = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector("c").alias("c")), "c")
    dims = vectors.select(F.size("c").alias("n")).first()["n"]
    return RowMatrix(ml, n, dims).computeGramianMatrix().toArray() / n


def axes(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors (columns), whose largest entry is positive."""
    e, u = np.linalg.eigh((cov + cov.T) / 2)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return e, u * np.sign(u[np.abs(u).argmax(axis=0), range(u.shape[1])])


def whitened(rows: DataFrame, components: int = 32) -> DataFrame:
    """Each complete vector on the leading components, scaled to variance 1.

    The components of a vector become whole numbers x, whose count and sums are exact, so rows are
    centred without rounding before MLlib's RowMatrix multiplies them. Its Gramian, a matrix of
    dimensions only, is decomposed at the driver; the axes go to the tasks, which whiten the rows.
    The covariance of what comes out is measured the same way. Sizes at the driver depend on the
    dimensions alone; no row is shuffled.

    Returns vec_id, component (from 1, by falling variance), n, deviation (null if it needs more
    than 64 bits), whitened, explained, identity_error. Rows whose vector is null, empty, holds
    null or non-finite components, or isn't of the commonest length are dropped. whitened is null
    for components without variance (a single or repeated vector, more dimensions than rows), and
    those don't count in identity_error, which is null if all are so. Repeated rows and vec_ids
    are rows of their own; null vec_ids stay. An empty table gives no rows.
    """
    d = dimensions(rows)
    n, sums = totals(d)
    if not n:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"c": list((centred(whole(np.stack(b["v"])), n, sums) / n).astype(float))})

    cov = covariance(d.select("v").mapInPandas(centre, "c array<double>"), n)
    e, u = axes(cov, components)
    trace = float(np.trace(cov))
    real = (e > FLAT * max(e.max(), 0)) & (e > 0)
    share = [float(x / trace) if trace > 0 else 0.0 for x in np.maximum(e, 0)]
    scaled = rows.sparkSession.sparkContext.broadcast(u[:, real] / np.sqrt(e[real]))  # dimensions by components

    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c = centred(whole(np.stack(b["v"])), n, sums)
                yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "deviation": pd.array(deviations(c), dtype="Int64"), "w": list((c / n).astype(float) @ scaled.value)})

    done = saved(d.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInPandas(whiten, "vec_id long, deviation long, w array<double>"))
    error = None
    if real.any():
        found = done.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(int(real.sum()))]).first()
        mean = F.array(*[F.lit(float(m)) for m in found])
        again = covariance(done.select(F.zip_with("w", mean, lambda a, b: a - b).alias("c")), n)
        error = float(np.abs(again - np.eye(len(again))).max())
    values = F.array(*[F.get("w", F.lit(int(at))) if ok else F.lit(None).cast("double") for ok, at in zip(real, np.cumsum(real) - 1, strict=True)])
    out = done.select("vec_id", "deviation", F.posexplode(values).alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, share))[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
