"""Approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved
from .hilbert import hilbert_keys
from .scan import scanned
from .vectors import distinct_vectors, group_pieces, keyed, matrix

#: More than rounding adds to the bounds.
SLACK = 1e-9


def directions(v: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def curve_keys(u: np.ndarray, curves: int, axes: int, bits: int, seed: int, probes: int = 0, step: float = 0.5) -> np.ndarray:
    """Hilbert keys of each direction (rows) on each curve (columns): projections on axes of random rotations, shifted by up to half the grid. With probes, a row has for each curve the keys of itself and of `probes` points near it, the same offsets for every row."""
    dims = u.shape[1]
    rng, near = (np.random.Generator(np.random.PCG64([seed, dims, x])) for x in (0, 1))
    axes = min(axes, dims)
    out, unused = np.empty((len(u), curves * (1 + probes)), np.int64), []
    for c in range(curves):
        if len(unused) < axes:
            unused = list(np.linalg.qr(rng.standard_normal((dims, dims)))[0])
        p = u @ np.array([unused.pop() for _ in range(axes)]).T * np.sqrt(dims)
        shift, offsets = rng.random(axes), np.vstack([np.zeros(axes), step * near.standard_normal((probes, axes))])
        for j, o in enumerate(offsets):
            at = (np.clip((p + o + 3) / 6, 0, 0.999999) + shift) / 2
            out[:, c * (1 + probes) + j] = hilbert_keys((at * (1 << bits)).astype(np.int64), bits)
    return out


def small_codes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions as bytes, and what a step of each row's bytes stands for."""
    step = np.abs(u).max(axis=1) / 127
    return np.rint(u / step[:, None]).astype(np.int8), step


def bounded_cosines(q: np.ndarray, q_step: np.ndarray, x: np.ndarray, x_step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of coded rows with coded rows, and how far off each can be."""
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    rough = (q.astype(kind) @ x.T.astype(kind)).astype(float) * (q_step[:, None] * x_step)
    off = np.sqrt(q.shape[1]) / 2
    a, b = off * q_step[:, None], off * x_step
    return rough, a + b + a * b + SLACK


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, each row for itself. Powers of two that bring the largest components to about 1 are taken out first, which rounds nothing."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def true_nearest(reps: DataFrame, asked: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """rid, found: the k nearest other entries of each of a few asked vectors, over all. A task keeps k a vector for each batch."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids, dims = b.column("rid").to_numpy(), b.column("dim").to_numpy()
            for d in np.unique(dims):
                here = np.flatnonzero(dims == d)
                u, ids = directions(matrix(b.column("v").take(pa.array(here)))), rids[here]
                for rid, v in (x for x in asked if len(x[1]) == d):
                    s = np.where(ids == rid, -2.0, u @ directions(v[None])[0])
                    best = np.argsort(-s, kind="stable")[:k]
                    best = best[s[best] > -2]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), rid)), pa.array(ids[best]), pa.array(s[best])], ["rid", "found", "score"])

    found = reps.select("rid", "dim", "v").mapInArrow(top, "rid long, found long, score double")
    rank = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("rid", "found")


def nearest(rows: DataFrame, is_query: Column, k: int = 5, curves: int = 48, axes: int = 10, bits: int = 6, block: int = 32, reach: int = 1, probes: int = 5, recall: float = 0.95, sample: int = 200, exact: bool = False, seed: int = 9) -> DataFrame:
    """The k nearest found of each query by cosine, over all other rows.

    Different vectors are ordered along each curve by a range exchange, and running counts give
    each its rank; a query and `probes` points near it are put between them. A query looks at the
    blocks of ranks around each of these, so its windows on all curves merge. How large blocks must
    be is measured, not set: of `sample` queries the true nearest are found by brute force, and the
    blocks are made as large as it takes for a share of `recall` of them to lie in some window
    (`block` ranks at least). They grow with the index and with how hard its vectors are, up to all
    of it; exact=True makes them so at once. A task holds one block of vectors coded in bytes and
    streams the coded queries past it; the coded cosines are bounded, and only entries that can be
    among the k + 1 best go on. All finds merge, and the original vectors of those that can still
    be among the best rerank them. Equal vectors are one entry with its k + 1 smallest ids.

    Returns query_id, rank, vec_id, score: nearest first, ties to the smaller vec_id; cosines in
    double precision on the original vectors. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do queries among them; vectors of different lengths don't compare. A row with the query's vec_id is its own; a
    repeated query row counts once. Candidates without a vec_id come last among ties. With fewer
    candidates, all are returned as long as a window holds them.
    """
    k_rows = keyed(rows)
    reps = saved(distinct_vectors(k_rows, k + 1).withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    asked = saved(keyed(rows.where(is_query)).where("ok").select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct().join(reps.select("k1", "k2", "rid"), ["k1", "k2"]).select("query_id", "rid"))
    near = asked.select("rid").distinct().withColumn("asked", F.lit(True))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, is_asked = b.column("dim").to_numpy(), b.column("asked").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                for q in (False, True):
                    x = b.filter(pa.array((dims == d) & (is_asked == q)))
                    if not x.num_rows:
                        continue
                    u = directions(matrix(x.column("v")))
                    codes, step = small_codes(u)
                    found = curve_keys(u, curves, axes, bits, seed, probes if q else 0)
                    yield pa.RecordBatch.from_arrays([x.column("rid"), x.column("dim"), x.column("asked"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step), pa.array(list(found), pa.list_(pa.int64()))], ["rid", "dim", "asked", "code", "step", "keys"])

    coded = reps.join(near, "rid", "left").select("rid", "dim", "v", F.coalesce("asked", F.lit(False)).alias("asked"))
    coded = saved(coded.mapInArrow(keys, "rid long, dim int, asked boolean, code binary, step double, keys array<long>"))
    on = coded.select("rid", F.col("dim").cast("long").alias("dim"), "asked", F.posexplode("keys").alias("at", "key"))
    per = F.when(F.col("asked"), 1 + probes).otherwise(1)
    on = on.select("rid", "dim", F.floor(F.col("at") / per).cast("long").alias("curve"), (F.col("at") % per).cast("long").alias("probe"), "asked", "key")
    # an asked entry stands in the order as itself and, for its own search, once more with its probes
    on = on.where("probe = 0").withColumn("one", F.lit(1).cast("long")).union(on.where("asked").withColumn("one", F.lit(0).cast("long")))
    placed = saved(scanned(on.drop("asked"), ["dim", "curve"], ["dim", "curve", "key", "one", "rid", "probe"], ["one"]).select("dim", "curve", "one", "rid", F.col("run_one").alias("rank")))
    index, looks = placed.where("one = 1").withColumn("rank", F.col("rank") - 1), placed.where("one = 0")

    if exact:
        block = max(block, reps.count())
    else:
        some = near.orderBy(F.xxhash64("rid"), "rid").limit(sample)
        few = [(r["rid"], np.array(r["v"], float)) for r in reps.join(F.broadcast(some), "rid").select("rid", "v").collect()]
        true = saved(true_nearest(reps, few, k))
        theirs = index.join(F.broadcast(true.select(F.col("found").alias("rid"), F.col("rid").alias("query"))), "rid")  # k rows for each of `sample`
        own = looks.join(F.broadcast(some), "rid").select("dim", "curve", F.col("rid").alias("query"), F.col("rank").alias("from"))
        apart = theirs.join(own, ["dim", "curve", "query"]).groupBy("query", "rid").agg(F.min(F.abs(F.col("rank") - F.col("from"))).alias("apart"))
        needed = apart.agg(F.percentile("apart", F.lit(recall)).alias("x")).first()["x"]
        block = max(block, math.ceil((needed or 0) / (reach + 0.5)) + 1)  # a window reaches so many blocks either way on average

    spots = F.sequence(F.greatest(F.lit(0), F.floor(F.col("rank") / block) - reach), F.floor(F.col("rank") / block) + reach)
    queries = looks.select("dim", "curve", F.explode(spots).alias("block"), F.lit(1).alias("query"), "rid").distinct()
    both = index.select("dim", "curve", F.floor(F.col("rank") / block).alias("block"), F.lit(0).alias("query"), "rid").union(queries)
    both = both.join(coded.select("rid", "code", "step"), "rid")
    key = ["dim", "curve", "block", "query"]
    both = both.select(*key, "rid", "code", "step").repartition("dim", "curve", "block").sortWithinPartitions(*key)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(x: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            return np.frombuffer(b"".join(x.column("code").to_pylist()), np.int8).reshape(x.num_rows, -1), x.column("step").to_numpy(), x.column("rid").to_numpy()

        here, held, index = None, [], None
        for (dim, curve, at, query), piece in group_pieces(batches, 4):
            if (dim, curve, at) != here:
                here, held, index = (dim, curve, at), [], None
            if not query:
                held.append(read(piece))
                continue
            if not held:
                continue
            index = index or tuple(np.concatenate(c) for c in zip(*held, strict=True))
            codes, step, ids = index
            q, q_step, rid = read(piece)
            rough, off = bounded_cosines(q, q_step, codes, step)
            n = min(k + 1, len(ids))
            floor = np.partition(rough - off, len(ids) - n, axis=1)[:, len(ids) - n]
            of, entry = np.nonzero(rough + off >= floor[:, None])
            r, o = rough[of, entry], off[of, entry]
            yield pa.RecordBatch.from_arrays([pa.array(rid[of]), pa.array(ids[entry]), pa.array(r - o), pa.array(r + o)], ["rid", "found", "least", "most"])

    hits = both.mapInArrow(best, "rid long, found long, least double, most double").groupBy("rid", "found").agg(F.max("least").alias("least"), F.max("most").alias("most"))
    place = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("least")))
    floor = F.min(F.when(F.col("place") <= k + 1, F.col("least"))).over(W.partitionBy("rid"))
    hits = saved(hits.withColumn("place", place).withColumn("floor", floor).where("most >= floor").select("rid", "found"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                x = b.filter(pa.array(dims == d))
                yield pa.RecordBatch.from_arrays([x.column("rid"), x.column("found"), pa.array(exact_cosines(matrix(x.column("a")), matrix(x.column("b"))))], ["rid", "found", "score"])

    side = lambda i, v: reps.select(F.col("rid").alias(i), F.col("v").alias(v))
    pairs = hits.join(side("rid", "a").withColumn("dim", F.size("a")), "rid").join(side("found", "b"), "found")
    pairs = pairs.select("rid", "found", "dim", "a", "b").mapInArrow(rerank, "rid long, found long, score double")
    hits = pairs.join(reps.select(F.col("rid").alias("found"), F.explode("ids").alias("vec_id")), "found")
    hits = hits.join(asked, "rid").where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
