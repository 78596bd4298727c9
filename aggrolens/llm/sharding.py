"""Sharding by histogram sort. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

KEY = ("h", "g", "m")
STEP = 12
BITS = 64 * len(KEY)


def _slice(top: int, width: int) -> Column:
    """`width` bits of the key from bit `top` down; a slice lies within one column."""
    level, at = divmod(top, 64)
    return F.shiftrightunsigned(F.col(KEY[level]), 64 - at - width).bitwiseAND(F.lit((1 << width) - 1))


def _begins(prefix: int, bits: int) -> Column:
    """The key's first `bits` bits are prefix."""
    test, done = F.lit(True), 0
    while done < bits:
        width = min(64 - done % 64, bits - done)
        part = prefix >> (bits - done - width) & ((1 << width) - 1)
        part -= (1 << 64) if width == 64 and part >= 1 << 63 else 0
        here = F.col(KEY[done // 64]) == F.lit(part) if width == 64 else F.shiftrightunsigned(F.col(KEY[done // 64]), 64 - width) == F.lit(part)
        test, done = test & here, done + width
    return test


def _reaches(edge: int) -> Column:
    """The key is at least edge."""
    if edge >= 1 << BITS:
        return F.lit(False)
    low = -(1 << 63)
    test = F.lit(True)
    for level in reversed(range(len(KEY))):
        value = (edge >> (BITS - 64 * (level + 1)) & ((1 << 64) - 1)) + low
        c = F.col(KEY[level]).bitwiseXOR(F.lit(low))
        test = (c > F.lit(value)) | ((c == F.lit(value)) & test)
    return test


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[int]:
    """Edges between shards of nearly equal bytes, found by refining histograms.

    A round counts the exact bytes in each of 4096 ranges of every open splitter's interval, in one
    distributed aggregate (at most 4096 rows per splitter reach the driver, whatever the input). A splitter is
    settled at the edge nearest its target once that is within `tolerance` of a shard's bytes;
    the others go on inside the range that holds their target, down to single rows.
    """
    edges: dict[int, int] = {}
    open_, done = {j: (0, 0) for j in range(1, shards)}, 0
    total = None
    while open_:
        width = min(STEP, 64 - done % 64)
        prefixes = sorted({p for p, _ in open_.values()})
        which = F.coalesce(*[F.when(_begins(p, done), F.lit(i)) for i, p in enumerate(prefixes)])
        counts = keyed.select(which.alias("i"), _slice(done, width).alias("bin"), "size").where("i is not null").groupBy("i", "bin").agg(F.sum("size").alias("size")).collect()
        bins: dict[int, list[tuple[int, int]]] = {}
        for r in counts:
            bins.setdefault(prefixes[r["i"]], []).append((r["bin"], r["size"]))
        total = sum(r["size"] for r in counts) if total is None else total
        done += width
        for j, (p, below) in list(open_.items()):
            target, at = total * j / shards, below
            for b, size in sorted(bins.get(p, [])):
                if at + size >= target:
                    child = p << width | b
                    near, far = (child, target - at), (child + 1, at + size - target)
                    edge, error = min(near, far, key=lambda x: x[1])
                    if error <= tolerance * total / shards or done == BITS:
                        edges[j] = edge << (BITS - done)
                    else:
                        open_[j] = (child, at)
                    break
                at += size
            else:
                edges[j] = 1 << BITS
            if j in edges:
                del open_[j]
    return [edges[j] for j in sorted(edges)]


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.005) -> DataFrame:
    """Put documents into shards of nearly equal bytes (law `bytes`).

    The sort key is the hash of the text, then of the doc_id, then the row's place: equal texts
    stay together unless their group is what a shard's edge must cut to keep within `tolerance`.
    Rows go through one exchange, to be numbered, by shard and cell of the key (about 2,000 rows, a hot
    text's rows over 64 cells), never by shard alone.

    Returns doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot (0.. in each shard),
    grown_shard (null). Null texts count as empty. Null doc_ids and repeated rows are rows
    like others. An empty table gives none; shards may be empty if there are fewer rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64("doc_id").alias("g"), F.monotonically_increasing_id().alias("m"))
    keyed = saved(keyed)
    edges = splitters(keyed, shards, tolerance)
    n = keyed.count()
    bits = max(1, min(20, (n // 2000).bit_length()))
    cell = F.shiftrightunsigned("h", 64 - bits) * 64 + F.shiftrightunsigned("g", 58)
    rows = keyed.withColumn("shard", sum((_reaches(e).cast("int") for e in edges), F.lit(0))).withColumn("cell", cell)
    counts = saved(rows.groupBy("shard", "cell").agg(F.count("*").alias("n")))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    at = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    number = F.row_number().over(W.partitionBy("shard", "cell").orderBy("h", "g", "m"))
    return rows.withColumn("number", number).join(at, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
