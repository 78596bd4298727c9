"""Near-duplicate vectors by random-hyperplane signs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, saved
from .vectors import distinct_vectors, keyed, matrix, whole_groups

BLOCK = 512
NEAR = 1e-9


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits, tables): buckets of about 256 random vectors, and tables enough for a pair just at the threshold to meet with probability `recall`."""
    bits = max(4, min(30, round(math.log2(max(n, 1) / 256))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def sign_codes(v: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """A row of codes, one per table, for each vector."""
    planes = np.random.Generator(np.random.PCG64([seed, v.shape[1]])).standard_normal((v.shape[1], tables * bits))
    signs = (v @ planes > 0).reshape(len(v), tables, bits)
    return (signs << np.arange(bits)).sum(axis=2).astype(np.int32)


def linked(v: np.ndarray, w: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of v and w have a cosine of at least `cosine`.

    A matrix product finds them; its rounding changes with the shape of the blocks, so pairs
    within 1e-9 of the threshold are measured one by one, on the vectors as given.
    """
    a, b = np.linalg.norm(v, axis=1), np.linalg.norm(w, axis=1)
    c = (v / a[:, None]) @ (w / b[:, None]).T
    close = c >= cosine
    p, q = np.nonzero(np.abs(c - cosine) < NEAR)
    for at in range(0, len(p), 1 << 12):
        x, y = p[at : at + (1 << 12)], q[at : at + (1 << 12)]
        close[x, y] = (v[x] * w[y]).sum(axis=1) / (a[x] * b[y]) >= cosine
    return close


def links_in(left: pa.Table, right: pa.Table | None, table: int, cosine: float) -> pa.RecordBatch:
    """Links within a block or between two: rid, links (rows of the partners), root (the smallest rid that its links lead to).

    A pair that shares a code in an earlier table is left to that table.
    """
    both = left if right is None else pa.concat_tables([left, right]).combine_chunks()
    v = matrix(both.column("v").chunk(0))
    codes, n, rid = matrix(both.column("codes").chunk(0)), both.column("n").to_numpy(), both.column("rid").to_numpy()
    a = len(left)
    close = linked(v[:a], v if right is None else v[a:], cosine)
    p, q = np.nonzero(np.triu(close, 1) if right is None else close)
    q = q if right is None else q + a
    new = ~(codes[p, :table] == codes[q, :table]).any(axis=1)
    p, q = p[new], q[new]
    links = np.bincount(p, n[q], len(rid)) + np.bincount(q, n[p], len(rid))
    root = rid.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, p, root[q])
        np.minimum.at(root, q, root[p])
        if (root == before).all():
            break
    keep = links > 0
    return pa.RecordBatch.from_arrays([pa.array(rid[keep]), pa.array(links[keep].astype(np.int64)), pa.array(root[keep])], ["rid", "links", "root"])


def near_duplicates(rows: DataFrame, cosine: float = 0.9, recall: float = 0.9995, seed: int = 5) -> DataFrame:
    """Vectors linked by a cosine of at least `cosine`, and their components.

    Equal vectors are one member with a count; links among them need no search. The others meet
    in sign buckets of several tables, cut into blocks of 512 members; a task handles two blocks
    at most (a matrix product), counts each pair in the first table where it meets, and sends on
    a count and a root per vector, never the pairs. Every pair reported has been verified.

    Returns vec_id, n_links, component_id (smallest vec_id reachable), kept. Vectors that are
    null, empty, zero or hold null or non-finite components have no links; vectors of different lengths neither.
    Null vec_ids: a component's id is the smallest that is not null. Repeated rows link with each
    other. An empty table gives none.
    """
    k = keyed(rows)
    reps = saved(distinct_vectors(k, 1).withColumn("rid", F.monotonically_increasing_id()))
    bits, tables = plan(reps.count(), cosine, recall)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                x = b.filter(pa.array(dims == d))
                codes = sign_codes(matrix(x.column("v")), bits, tables, seed)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(list(codes), pa.list_(pa.int32()))], [*x.schema.names, "codes"])

    members = reps.select("rid", "n", F.size("v").alias("dim"), "v").mapInArrow(coded, "rid long, n long, dim int, v array<double>, codes array<int>")
    members = saved(members)
    in_table = members.select("rid", "dim", F.posexplode("codes").alias("t", "code"))
    sizes = saved(in_table.groupBy("dim", "t", "code").agg(F.count("*").alias("size")).where("size > 1"))
    block = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    placed = in_table.join(sizes, ["dim", "t", "code"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", block)
    placed = placed.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("dim", "t", "code", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "rid")
    key = ["dim", "t", "code", "i", "j"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, t, _, i, j), g in whole_groups(batches, len(key)):
            side = g.column("block").to_numpy()
            left = g.filter(pa.array(side == i))
            right = None if i == j else g.filter(pa.array(side == j))
            if len(left) and (right is None or len(right)):
                yield links_in(left.combine_chunks(), right, t, cosine)

    pairs = placed.join(members.select("rid", "n", "v", "codes"), "rid").select(*key, "block", "rid", "n", "v", "codes")
    pairs = pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(found, "rid long, links long, root long")
    pairs = saved(pairs.groupBy("rid", "root").agg(F.sum("links").alias("links")))
    comp = connected_components(pairs.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    comp = reps.select("k1", "k2", "rid", "n", F.col("ids")[0].alias("id")).join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = comp.groupBy("component").agg(F.min("id").alias("component_id"))
    links = pairs.groupBy("rid").agg(F.sum("links").alias("links"))
    known = saved(comp.join(least, "component").join(links, "rid", "left").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    done = k.where("ok").select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = k.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
