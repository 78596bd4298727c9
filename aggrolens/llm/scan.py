"""Running sums over a sorted frame that may be one key's alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def scanned(df: DataFrame, key: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """df with run_<s> for each of sums: the sum of s over the rows of the same key up to this one, in `order`, which begins with key and should have no ties.

    The rows are sorted by range, so a key with very many rows lies in several partitions: each
    task adds up its own rows, and what the partitions before it hold of its first key comes from
    one small row a partition. key and sums are long columns without nulls; without a key, all
    rows are one. Only one row a partition reaches the driver. The rows are saved once.
    """
    spark = df.sparkSession
    runs = [f"run_{s}" for s in sums]
    spread = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, lead, last, held = TaskContext.get().partitionId(), 0, True, None, [0] * len(sums)
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in key] or [np.zeros(b.num_rows, np.int64)])
            new = np.r_[last is not None and bool((k[:, 0] != last).any()), (k[:, 1:] != k[:, :-1]).any(0)]
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))  # -1: the run began before this batch
            totals = []
            for i, s in enumerate(sums):
                c = np.r_[0, np.cumsum(b.column(s).to_numpy())]
                totals.append(c[1:] - np.where(start < 0, -held[i], c[start]))
            led = lead & ~np.logical_or.accumulate(new)
            rows = np.arange(row, row + len(new))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(new), part, np.int32)), pa.array(rows), pa.array(led), *map(pa.array, totals)], [*b.schema.names, "_part", "_row", "_lead", *runs])
            row, lead, last, held = row + len(new), bool(led[-1]), k[:, -1], [int(t[-1]) for t in totals]

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema] + ["_part int, _row long, _lead boolean"] + [f"{r} long" for r in runs])
    rows = saved(spread.mapInArrow(local, schema))
    ends = rows.groupBy("_part").agg(F.min_by(F.array(*key, F.lit(0).cast("long")), "_row").alias("first"), F.max_by(F.struct(F.array(*key, F.lit(0).cast("long")).alias("key"), "_lead", F.array(*runs).alias("runs")), "_row").alias("last"))
    carried, before, held = [], None, [0] * len(sums)
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        carry = held if r["first"] == before else [0] * len(sums)
        carried.append((r["_part"], *carry))
        before = r["last"]["key"]
        held = [x + (c if r["last"]["_lead"] else 0) for x, c in zip(r["last"]["runs"], carry, strict=True)]
    more = spark.createDataFrame(carried, ", ".join(["_part int"] + [f"_c{i} long" for i in range(len(sums))]))
    out = rows.join(F.broadcast(more), "_part")  # a row a partition
    added = [(F.col(r) + F.when(F.col("_lead"), F.col(f"_c{i}")).otherwise(0)).alias(r) for i, r in enumerate(runs)]
    return out.select(*df.columns, *added)
