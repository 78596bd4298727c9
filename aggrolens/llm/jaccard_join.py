"""Similarity join on shingle sets by a grouped prefix join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forget, most_frequent, saved, text_bytes
from .shingles import shingle_sets

#: Longs of a set's parity bitmap.
LONGS = 4
#: Members of a bucket that all its others are compared with first.
PIVOTS = 8
#: Identifiers broadcast at most.
SENT = 200_000
#: Common shingles sent to the tasks at most.
COMMON = 100_000
#: Groups that may share a prefix shingle before it is put last in the order of sets, and rounds of that.
HOT, ROUNDS = 256, 3
#: Groups of a block of a bucket.
BLOCK = 64


def parity(u: np.ndarray) -> np.ndarray:
    """A bit for each of 256 parts of the hash space: whether the part holds an odd number of shingles. Sets differ in at least as many shingles as bits."""
    odd = np.bincount((u >> np.uint64(56)).astype(np.int64), minlength=64 * LONGS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def common_shingles(docs: DataFrame, size: int, least: int = 12) -> list[int]:
    """Shingles that `least` different texts of some batch hold, the most frequent first, at most 100,000."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(dict.fromkeys(text_bytes(b.column(0))))
            found = list(shingle_sets(texts, size))
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(h[n >= least].view(np.int64)), pa.array(n[n >= least])], ["h", "n"])

    found = saved(docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    return most_frequent(found, "h", "n", COMMON)


def described(docs: DataFrame, size: int, percent: int, common: list[int]) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (digest of the set), t (hash of the text), prefix, bits of each document."""
    late = np.sort(np.array(common, np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, prefix, bits = [], [], [], []
            for u in shingle_sets(text_bytes(b.column(2)), size):
                n.append(len(u))
                digest.append(np.frombuffer(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), np.int64))
                bits.append(parity(u))
                if len(late):
                    at = np.minimum(np.searchsorted(late, u), len(late) - 1)
                    is_late = late[at] == u
                    u = np.concatenate([u[~is_late], u[is_late]])
                prefix.append(u[: len(u) - (percent * len(u) + 99) // 100 + 1].view(np.int64) if len(u) else u.view(np.int64))
            d, w = np.array(digest).reshape(-1, 2), np.array(bits).reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(prefix, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(c)) for c in w.T)], ["doc_id", "t", "n", "s1", "s2", "prefix", *BITS])

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {id_type}, t long, n long, s1 long, s2 long, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS))


BITS = [f"b{i}" for i in range(LONGS)]


def least_common(a: Column, b: Column, percent: int) -> Column:
    """Shingles that sets of sizes a and b must share at least."""
    return F.ceil((a + b) * percent / (100 + percent))


def can_match(x: str, y: str, percent: int) -> Column:
    """Whether members of groups x and y can be similar: their sizes, and the bits that each group's members agree on and in which the groups differ."""
    n = lambda s: F.col(f"{s}.n")
    size = F.least(n(x), n(y)) * 100 >= F.greatest(n(x), n(y)) * percent
    differ = sum((F.bit_count(F.col(f"{x}.a{i}").bitwiseXOR(F.col(f"{y}.a{i}")).bitwiseAND(F.bitwise_not(F.col(f"{x}.a{i}").bitwiseXOR(F.col(f"{x}.o{i}")))).bitwiseAND(F.bitwise_not(F.col(f"{y}.a{i}").bitwiseXOR(F.col(f"{y}.o{i}"))))) for i in range(LONGS)), F.lit(0))
    return size & (differ <= n(x) + n(y) - 2 * least_common(n(x), n(y), percent))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and text of the wanted sets (sid, rep, t), each once, however often its row is repeated. Up to 200,000 identifiers are broadcast."""
    w = wanted.select("sid", "rep", F.col("t").alias("wt"))
    w = F.broadcast(w) if wanted.count() <= SENT else w
    d = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return d.join(w, (d["t"] == F.col("wt")) & d["doc_id"].eqNullSafe(F.col("rep"))).groupBy("sid").agg(F.first("text").alias("text"))


def sketched(texts: DataFrame, size: int) -> DataFrame:
    """sid, n and a parity bitmap of 8192 bits for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                x = b.slice(at, 500)
                n, bits = [], []
                for u in shingle_sets(text_bytes(x.column(1)), size):
                    n.append(len(u))
                    bits.append(np.packbits(np.bincount((u >> np.uint64(51)).astype(np.int64), minlength=8192).astype(np.uint8) & 1).tobytes())
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], ["sid", "n", "bits"])

    return texts.mapInArrow(run, "sid long, n long, bits binary").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))


def near_enough(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose large bitmaps still allow similarity, and in how many bits they differ (apart)."""
    side = lambda k: sketches.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                x = b.slice(at, 2000)
                m = [np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint64).reshape(x.num_rows, -1) for k in ("bitsa", "bitsb")]
                apart = np.bitwise_count(m[0] ^ m[1]).sum(axis=1).astype(np.int64)
                total = x.column("na").to_numpy() + x.column("nb").to_numpy()
                fine = apart <= total - 2 * -(-total * percent // (100 + percent))
                yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(fine)), x.column("b").filter(pa.array(fine)), pa.array(apart[fine])], ["a", "b", "apart"])

    p = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
    return p.mapInArrow(run, "a long, b long, apart long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar, made from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for at in range(0, b.num_rows, 200):
                x = b.slice(at, 200)
                for u, w in zip(shingle_sets(text_bytes(x.column(2)), size), shingle_sets(text_bytes(x.column(3)), size), strict=True):
                    both = len(np.intersect1d(u, w, assume_unique=True))
                    good.append(both * 100 >= (len(u) + len(w) - both) * percent)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    p = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")
    return p.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame, size: int, percent: int, common: list[int]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, sets, groups, tokens, shared), all saved: of each document its set's size and digest; each different set with its
    group g; each group's size, members and the bits they agree on; each group's prefix shingles; and the shingles that several groups have, with how many."""
    whole = saved(described(docs, size, percent, common))
    key = ["s1", "s2"]
    r = whole.where("n > 0").groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("least"), *[F.first(c).alias(c) for c in ("n", "prefix", *BITS)])
    r = r.withColumn("rep", F.col("least.doc_id")).withColumn("t", F.col("least.t")).drop("least").withColumn("g1", F.xxhash64("prefix", "n")).withColumn("g2", F.xxhash64(F.lit(3), F.reverse("prefix"), "n"))
    full = saved(r.withColumn("sid", F.monotonically_increasing_id()))
    d = saved(whole.select("doc_id", "n", "s1", "s2"))
    forget(whole)
    agreed = [f(b).alias(f"{k}{i}") for k, f in (("a", F.bit_and), ("o", F.bit_or)) for i, b in enumerate(BITS)]
    named = saved(full.groupBy("g1", "g2", "n").agg(F.first("prefix").alias("prefix"), F.count("*").alias("m"), *agreed).withColumn("g", F.monotonically_increasing_id()))
    r = saved(full.drop("prefix").join(named.select("g1", "g2", "n", "g"), ["g1", "g2", "n"]).drop("g1", "g2"))
    tokens = saved(named.select("g", F.explode("prefix").alias("token")))
    groups = saved(named.drop("g1", "g2", "prefix"))
    shared = saved(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    forget(full, named)
    return d, r, groups, tokens, shared


def paired(left: DataFrame, right: DataFrame, on: list[str], percent: int, more: Column | None = None) -> DataFrame:
    """p < q: groups of left and right that meet in a bucket and can match."""
    same = F.lit(True) if more is None else more
    for c in on:
        same = (F.col(f"x.{c}") == F.col(f"y.{c}")) & same
    differ = F.col("x.g") < F.col("y.g") if left is right else F.col("x.g") != F.col("y.g")
    met = left.alias("x").join(right.alias("y"), same & differ & can_match("x", "y", percent))
    return met.select(F.least("x.g", "y.g").alias("p"), F.greatest("x.g", "y.g").alias("q")).distinct()


def paired_in_blocks(big: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups of one bucket (token, g, lo, hi) that are not in one component already. Buckets are cut into blocks of about 64 groups, and each pair of blocks is a bucket of its own."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    b = big.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    left = b.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    right = b.withColumn("other", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("other"))))
    apart = ~((F.col("x.lo") == F.col("y.hi")) & (F.col("x.hi") == F.col("y.lo")))
    return paired(left, right, ["token", "block", "other"], percent, apart)


def similar_documents(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Documents linked by a Jaccard similarity of at least percent / 100 of their shingle sets, and their components.

    Equal sets are one. Sets with an equal prefix and size form a group; a group's prefix is
    joined with the others' once, and a pair of groups passes if sizes and parity bits (a lower
    bound of the difference) allow it. Pairs of groups expand to pairs of sets, filtered likewise, and these are
    verified on the texts themselves. What is wanted are components, so pairs within one already
    known are not looked at again: the groups of a bucket of over 16 are first joined with its eight pivots, of the pairs that
    pass a bitmap of 8192 bits each set's closest is verified first, and then those between different components are, all of them;
    a bucket that is not one component by then is cut into blocks of about 64 groups whose pairs spread over tasks.
    No link between different components is lost, and no bucket's pairs are all sent on.
    Shingles common to many documents come last in the order that prefixes follow: those that a
    dozen texts of one batch share, then those that over 256 groups have in their prefixes, for up to three rounds. That changes no result.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable). Words: runs without ASCII white
    space, A-Z in lower case; texts with fewer words than `size` are one shingle; null, empty and
    blank texts have none and link with nothing. Repeated rows link with each other. Null
    doc_ids are left out of the smallest where another exists. Other columns are not read; an empty table gives none.
    """
    key = ["s1", "s2"]
    common = common_shingles(docs, size)
    for again in range(ROUNDS, -1, -1):
        d, r, groups, tokens, shared = grouped(docs, size, percent, common)
        hot = set(most_frequent(shared.where(F.col("c") > HOT), "token", "c", COMMON)) - set(common) if again else set()
        if not hot or len(common) >= COMMON:
            break
        common = [*common, *sorted(hot)][:COMMON]
        forget(d, r, groups, tokens, shared)
    filed = saved(tokens.join(shared, "token").join(groups.drop("m"), "g"))
    few, many = filed.where(F.col("c") <= 2 * PIVOTS), filed.where(F.col("c") > 2 * PIVOTS)
    pivot = many.where(F.pmod(F.xxhash64("g", "token"), "c") < PIVOTS)
    met = paired(few, few, ["token"], percent).union(paired(pivot, many, ["token"], percent)).distinct()
    own = saved(groups.where("m > 1").select(F.col("g").alias("p"), F.col("g").alias("q")))
    forget(groups, shared, tokens)

    member = r.select("g", "sid", "n", *[F.col(b).alias(f"{k}{i}") for k in "ao" for i, b in enumerate(BITS)])

    def expanded(pairs: DataFrame) -> DataFrame:
        p = pairs.join(member.alias("x"), F.col("p") == F.col("x.g")).join(member.alias("y"), (F.col("q") == F.col("y.g")) & ((F.col("p") < F.col("q")) | (F.col("x.sid") < F.col("y.sid"))) & can_match("x", "y", percent))
        return p.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))

    def closest(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("e"), "a", "b", "apart").union(pairs.select(F.col("b").alias("e"), "a", "b", "apart"))
        return ends.groupBy("e").agg(F.min(F.struct("apart", "a", "b")).alias("s")).select("s.a", "s.b").distinct()

    def between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs whose ends lie in different components."""
        p = pairs.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        return p.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def wanted(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
        return saved(r.select("sid", "rep", "t").join(ids, "sid", "left_semi"))

    tried = saved(expanded(met.union(own)))
    texts = saved(texts_of(docs, wanted(tried)))
    sketches = saved(sketched(texts, size))
    pairs = saved(near_enough(tried, sketches, percent))
    forget(sketches)
    first = saved(closest(pairs))
    links = saved(verified(first, texts, size, percent))
    comp = saved(connected_components(links))
    rest = saved(between(pairs.join(first, ["a", "b"], "left_anti"), comp))
    links = saved(links.union(verified(rest, texts, size, percent)))
    comp = saved(connected_components(links))
    forget(texts)

    of_group = r.select("g", "sid").join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    of_group = saved(of_group.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    big = many.join(of_group, "g")
    open_ = big.groupBy("token").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last").select("token")
    met2 = paired_in_blocks(big.join(open_, "token"), percent).distinct()
    late = saved(between(expanded(met2).join(tried, ["a", "b"], "left_anti"), comp))
    if late.take(1):
        texts = saved(texts_of(docs, wanted(late)))
        late = saved(near_enough(late, saved(sketched(texts, size)), percent))
        links = saved(links.union(verified(late, texts, size, percent)))
        comp = saved(connected_components(links))

    known = r.select(*key, "sid", "rep").join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = saved(known.join(least, "component").select(*key, "component_id"))
    done = d.where("n > 0").select("doc_id", "n", *key).join(known, key).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return done.union(d.where("n = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id")))
