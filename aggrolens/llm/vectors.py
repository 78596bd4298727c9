"""Vectors in frames: validity, collapsing equal ones, reading Arrow batches group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(v: str = "embedding") -> Column:
    """Not null or empty, every component finite, not all zero."""
    d = F.col(v).cast("array<double>")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & fine & F.exists(d, lambda x: x != 0), F.lit(False))


def keyed(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """vec_id, v (array of double), ok, and k1, k2: two hashes that stand for the vector's content."""
    d = rows.select(F.col(key).alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return d.withColumn("ok", usable("v")).withColumn("k1", F.xxhash64("v", F.size("v"))).withColumn("k2", F.xxhash64(F.lit(7), F.reverse("v")))


def distinct_vectors(k: DataFrame, ids: int) -> DataFrame:
    """One row per different usable vector: k1, k2, v, n rows, ids (its `ids` smallest vec_ids, in order).

    The smallest ids are picked by a ranked window that Spark limits before the shuffle, so that a
    vector that a third of the rows share never gathers in a task.
    """
    ok = k.where("ok")
    rank = F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.col("vec_id").asc_nulls_last()))
    few = ok.withColumn("rank", rank).where(F.col("rank") <= ids).groupBy("k1", "k2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("s"))
    n = ok.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    return few.join(n, ["k1", "k2"]).select("k1", "k2", "v", "n", F.transform("s", lambda x: x["vec_id"]).alias("ids"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def group_pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Sorted batches cut where their first `keys` integer columns change: (key, piece); a group can come in several pieces."""
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:keys]])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            yield tuple(int(x) for x in k[:, lo]), b.slice(lo, hi - lo)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    last, held = None, []
    for key, piece in group_pieces(batches, keys):
        if key != last and held:
            yield last, pa.Table.from_batches(held).combine_chunks()
            held = []
        last = key
        held.append(piece)
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()
