"""The trie of conversation prefixes, as preorder intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .scan import scanned

#: Turns, or blocks of them, that are compared as one array.
BLOCK = 32
#: Bytes of identifiers in a piece of what ends at a node.
PIECE = 1 << 16
LOW = (1 << 32) - 1
NODE = ["depth", "k1", "k2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, null first, ties by content), e1, e2 (120 bits of a SHA-256 that stand for role and text), bytes (of the text). Null roles and texts are empty; rows without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary"), 256)
    d = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", sha.alias("sha"), F.octet_length(text).cast("long").alias("bytes"))
    half = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    d = saved(d.select("conv_id", "turn", half(1).alias("e1"), half(16).alias("e2"), "bytes", F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("row")))
    d = scanned(d, ["conv_id"], ["conv_id", "turn", "e1", "e2", "row"], ["one"])
    return d.select("conv_id", (F.col("run_one") - 1).alias("pos"), "e1", "e2", "bytes")


def rebuilt(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their group does: (c, len) and (c, len, depth, e1, e2, bytes).

    Conversation c takes the first h turns of conversation c - c % group, h = crc32(c) % heads,
    and then its own after its first h.
    """
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    c = size.select(F.col("conv_id").alias("c"), "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    c = c.join(size.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    c = c.withColumn("k", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    c = saved(c.select("c", "base", "h", "k", (F.col("k") + F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("h"))).alias("len")))
    own = turns.join(c, turns["conv_id"] == c["c"]).where("pos >= h").withColumn("depth", F.col("k") + F.col("pos") - F.col("h") + 1)
    taken = turns.where(F.col("pos") < heads - 1).join(c, turns["conv_id"] == c["base"]).where("pos < k").withColumn("depth", F.col("pos") + 1)
    return c.select("c", "len"), own.unionByName(taken).select("c", "len", "depth", "e1", "e2", "bytes")


def with_prefixes(turns: DataFrame) -> DataFrame:
    """turns with k1, k2, which stand for the turns up to this one, and p1, p2 for those before it: sums, modulo 2**32, of four hashes of each turn and its depth. None stands for no turn but 0, 0."""
    h = [F.xxhash64("e1", "e2", "depth", F.lit(seed)) for seed in (1, 2)]
    parts = {"a": F.shiftrightunsigned(h[0], 32), "b": h[0].bitwiseAND(LOW), "c_": F.shiftrightunsigned(h[1], 32), "d": h[1].bitwiseAND(LOW)}
    d = scanned(turns.withColumns(parts), ["c"], ["c", "depth"], list(parts))
    both = lambda x, y: F.shiftleft(x, 32).bitwiseOR(y.bitwiseAND(LOW))
    up, before = [F.col(f"run_{p}") for p in parts], [F.col(f"run_{p}") - F.col(p) for p in parts]
    return d.select(*turns.columns, both(*up[:2]).alias("k1"), both(*up[2:]).alias("k2"), both(*before[:2]).alias("p1"), both(*before[2:]).alias("p2"))


def sequence_ranks(turns: DataFrame) -> DataFrame:
    """c, rank (from 1) of different sequences of turns in lexicographic order, a beginning before what it begins.

    Blocks of turns are ranked among all different blocks, then blocks of those ranks, until one
    block is left of each sequence: arrays stay short however long a conversation is, and each
    round has a BLOCK-th of the rows of the one before.
    """
    level = turns.select("c", (F.col("depth") - 1).alias("at"), F.array("e1", "e2").alias("v"))
    while True:
        group = level.groupBy("c", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s"))
        blocks = saved(group.select("c", "block", F.flatten(F.transform("s", lambda x: x["v"])).alias("key")))
        top = blocks.agg(F.max("block")).first()[0]
        one = F.lit(1).cast("long").alias("one")
        if not top:  # every sequence is one key, and no two are equal
            return scanned(blocks.select("c", "key", one), [], ["key", "c"], ["one"]).select("c", F.col("run_one").alias("rank"))
        ranks = scanned(blocks.select("key").distinct().select("key", one), [], ["key"], ["one"])
        level = blocks.join(ranks, "key").select("c", F.col("block").alias("at"), F.array("run_one").alias("v"))


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and sha: SHA-256 of the comma-joined identifiers of the conversations that end at a node.

    Identifiers are sorted by range and joined into pieces first, so that the one task which must
    read a digest's input from end to end gets a row for thousands of them.
    """
    order = [*NODE, "c"]
    spread = ends.select(*order).repartitionByRange(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    node = "depth long, k1 long, k2 long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        *ids, last = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in ids), pa.array(last, pa.string())], [f"f{i}" for i in range(len(out[0]))])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, first, held, size, out = None, 0, [], 0, []
        for *at, c in rows(batches):
            if held and (at != here or size > PIECE):
                out.append((*here, first, ",".join(held)))
                held, size = [], 0
            if len(out) >= 1000:
                yield batch(out)
                out = []
            here, first = at, first if held else c
            held.append(str(c))
            size += len(held[-1]) + 1
        if held:
            yield batch([*out, (*here, first, ",".join(held))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sha, out = None, None, []
        for *at, _, text in rows(batches):
            if at != here:
                if here:
                    out.append((*here, sha.hexdigest()))
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
                here, sha = at, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        if here:
            yield batch([*out, (*here, sha.hexdigest())])

    joined = saved(spread.mapInArrow(lambda b: (x.rename_columns([*NODE, "first", "ids"]) for x in pieces(b)), f"{node}, first long, ids string"))
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(lambda b: (x.rename_columns([*NODE, "sha"]) for x in digests(b)), f"{node}, sha string")


def trie(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see rebuilt()), from the textless root down.

    Different sequences of turns are ranked lexicographically; a node's members are a range of
    those ranks, so the nodes in order of (first member's rank, depth) are in preorder, and the
    last node of the last member ends its subtree. Leaves and savings of a subtree are then
    differences of running sums over the preorder, taken at both ends.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and preorder, subtree_end (places from 1). Turns that tie come in
    the order of their content's hash; repeated rows are turns of their own. Rows without a
    conv_id take no part. An empty table gives no node.
    """
    convs, turns = rebuilt(turns_of(conversations), group, heads)
    turns = saved(with_prefixes(turns))
    zero = F.lit(0).cast("long")
    ends = turns.where("depth = len").select("c", "depth", "k1", "k2").unionByName(convs.where("len = 0").select("c", zero.alias("depth"), zero.alias("k1"), zero.alias("k2")))
    ends = saved(ends)
    alike = saved(ends.groupBy(*NODE).agg(F.count("*").alias("w"), F.min("c").alias("c")))
    own = turns.join(alike.select("c", "w"), "c")
    own = own.join(sequence_ranks(own), "c")

    def node(first: Column, last: Column, bytes_: Column, over: Column) -> list[Column]:
        return [F.min("c").alias("conv_id"), F.sum("w").alias("n_convs"), first.alias("first"), last.alias("last"), bytes_.alias("bytes"), F.coalesce(F.sum(F.when(over, F.col("w"))), zero).alias("n_ends")]

    below = own.groupBy(*NODE).agg(*node(F.min("rank"), F.max("rank"), F.max("bytes"), F.col("depth") == F.col("len")), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = alike.agg(*node(zero, F.coalesce(F.count_if(F.col("depth") > 0), zero), zero, F.col("depth") == 0)).where("n_convs is not null")
    root = root.select(*[zero.alias(c) for c in NODE], "*", zero.alias("p1"), zero.alias("p2"))
    nodes = below.unionByName(root)
    one = F.lit(1).cast("long")
    leaf = ((F.col("first") == F.col("last")) & (F.col("n_ends") > 0)).cast("long")
    nodes = nodes.withColumns({"one": one, "leaf": leaf, "saving": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes = saved(scanned(nodes, [], ["first", "depth"], ["one", "leaf", "saving"]))
    lasts = nodes.where("n_ends > 0").select(F.col("first").alias("last"), F.col("run_one").alias("subtree_end"), F.col("run_leaf").alias("leaves"), F.col("run_saving").alias("savings"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(lasts, "last").join(parents, ["depth", "p1", "p2"], "left").join(children, NODE, "left").join(end_digests(ends), NODE, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        (F.col("leaves") - F.col("run_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("savings") - F.col("run_saving") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.col("run_one").alias("preorder"),
        "subtree_end",
    )
