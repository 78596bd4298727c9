"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, saved

CELL_ROWS = 4096
WING = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def cell_digits(rows: int) -> int:
    """Hexadecimal digits of a cell: a source that held all rows would have about CELL_ROWS of them a cell at most."""
    digits = 3
    while 16**digits * CELL_ROWS < rows and digits < 7:
        digits += 1
    return digits


def highest_quotients(df: DataFrame, by: list[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """Give each group's `seats` (equal in its rows) to its rows by the highest quotients weight / (2k + 1).

    A row of share s among n rows gets within s * n / 2 + 1 of its exact portion, so only the
    quotients in that range are ranked (about 3n in all); those before it are given outright.
    Equal quotients go by key. Rows of weight 0 get none.
    """
    g = W.partitionBy(*by)
    d = df.withColumn("_t", F.sum(weight).over(g)).withColumn("_n", F.count("*").over(g))
    share = F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise(0.0)
    d = d.withColumn("_x", share * F.col(seats)).withColumn("_r", share * F.col("_n") / 2 + 1)
    d = d.withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col("_x") - F.col("_r"))).cast("long"))
    d = d.withColumn("_left", F.col(seats) - F.sum("_lo").over(g))
    ks = F.sequence("_lo", (F.ceil(F.col("_x") + F.col("_r")) + 1).cast("long"))
    q = d.where(F.col(weight) > 0).select(*by, key, "_left", weight, F.explode(ks).alias("_k"))
    q = q.withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    q = q.withColumn("_rank", F.row_number().over(g.orderBy(F.desc("_q"), key, "_k"))).where("_rank <= _left")
    won = q.groupBy(*by, key).agg(F.count("*").alias("_won"))
    return d.join(won, [*by, key], "left").withColumn(out, (F.col("_lo") + F.coalesce("_won", F.lit(0))).cast("long")).drop("_t", "_n", "_x", "_r", "_lo", "_left", "_won")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, block_words: int = 64, shard_words: int = 50_000, seed: int = 17, passing: tuple[str, ...] = ()) -> DataFrame:
    """Words that a mix takes from each document.

    Sources, by code point and null last, weigh `weights` in turn and share the words of all
    documents; none gets over `max_epochs` times its own (the excess is reshared by weight).
    Documents lie in each source's shards in seeded order; a shard's words are cut into blocks of
    nearly equal length (`block_words`; fewer in corpora under 100,000 such blocks). Blocks go to
    sources, then to a source's shards, by the highest quotients, and a shard takes its quota as
    whole passes and a seeded run of blocks. Shards are ranges of a source's hash cells, whose
    number grows with the table (`cell_digits`), so a hot source is spread and neither windows nor
    joins are by source alone; seats go to wings of 4096 shards first, so that no ranking is longer.

    Returns doc_id, size, source_size, target, taken, passes (whole copies), parts (array of
    start, words: runs of words taken besides), and the columns in `passing`.
    Null or blank texts: size 0, nothing taken. Null doc_ids and repeated rows: each row is
    its own document; rows alike in doc_id and size are interchangeable. An empty table gives none.
    """
    digits = cell_digits(docs.count())
    n_cells = 16**digits
    d = docs.select("doc_id", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("sk"), word_count().alias("size"), *passing)
    d = d.withColumn("key", _seeded(F.lit(seed), F.col("doc_id"), F.col("size"))).withColumn("cell", _number(F.col("key"), digits))
    if not passing:
        d = saved(d)
    cells = saved(d.groupBy("sk", "cell").agg(F.sum("size").alias("cw")))

    every = W.partitionBy(F.lit(0))
    src = cells.groupBy("sk").agg(F.sum("cw").alias("source_size"))
    turn = F.array(*[F.lit(int(w)) for w in weights])
    src = src.withColumn("weight", F.element_at(turn, (1 + (F.row_number().over(every.orderBy("sk")) - 1) % len(weights)).cast("int")).cast("long"))
    src = src.withColumn("cap", F.col("source_size") * max_epochs)
    before = every.orderBy(F.col("cap") / F.col("weight"), "sk").rowsBetween(W.unboundedPreceding, -1)
    src = src.withColumn("total", F.sum("source_size").over(every))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    src = src.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    src = src.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    src = src.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")))
    src = src.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr("total div 100000"))))
    src = src.withColumn("n_shards", F.greatest(F.lit(1), F.least(F.lit(n_cells), F.ceil(F.col("source_size") / shard_words))).cast("long"))
    src = saved(src.select("sk", "source_size", "target", "block", "n_shards"))

    placed = cells.join(src, "sk").withColumn("shard", F.expr(f"cell * n_shards div {n_cells}")).withColumn("wing", F.expr(f"shard div {WING}"))
    shards = placed.groupBy("sk", "wing", "shard").agg(F.sum("cw").alias("words"), F.first("block").alias("block"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = shards.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / F.col("block")))).otherwise(0).cast("long"))
    own = shards.groupBy("sk").agg(F.sum("blocks").alias("blocks"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    own = own.withColumn("due", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)).withColumn("one", F.lit(0))
    own = own.withColumn("seats", F.round(F.sum("due").over(every)).cast("long"))
    own = highest_quotients(own, ["one"], "sk", "due", "seats", "won").select("sk", F.least("won", F.col("blocks") * max_epochs).alias("won"))
    wings = shards.groupBy("sk", "wing").agg(F.sum("blocks").alias("blocks"))
    wings = highest_quotients(wings.join(own, "sk"), ["sk"], "wing", "blocks", "won", "due").select("sk", "wing", "due")
    shards = highest_quotients(shards.join(wings, ["sk", "wing"]), ["sk", "wing"], "shard", "blocks", "due", "quota")

    run = W.partitionBy("sk", "shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    at = placed.select("sk", "cell", "shard", F.coalesce(F.sum("cw").over(run), F.lit(0)).alias("cell_at"))
    at = saved(at.join(shards.select("sk", "shard", "words", "blocks", "quota", "source_size", "target"), ["sk", "shard"]))

    run = W.partitionBy("sk", "cell").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("size").over(run), F.lit(0))).join(at, ["sk", "cell"])
    d = d.withColumn("a", F.col("cell_at") + F.col("at")).withColumn("b", F.col("a") + F.col("size"))
    d = d.withColumn("passes", F.expr("case when blocks > 0 then quota div blocks else 0 end")).withColumn("rest", F.col("quota") - F.col("passes") * F.col("blocks"))
    d = d.withColumn("first", F.when(F.col("blocks") > 0, F.pmod(_number(_seeded(F.lit(seed), F.col("sk"), F.col("shard")), 8), F.greatest("blocks", F.lit(1)))).otherwise(0))
    edge = lambda j: F.expr(f"case when blocks > 0 then ({j}) * words div blocks else 0 end")
    runs = [(edge("first"), edge("least(first + rest, blocks)")), (F.lit(0).cast("long"), edge("greatest(first + rest - blocks, 0)"))]
    part = lambda lo, hi: F.struct((F.greatest(lo, "a") - F.col("a")).alias("start"), F.greatest(F.lit(0), F.least(hi, "b") - F.greatest(lo, "a")).alias("words"))
    d = d.withColumn("parts", F.filter(F.array(*[part(*r) for r in runs]), lambda p: p["words"] > 0))
    taken = F.col("passes") * F.col("size") + F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    return d.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, F.col("passes")).otherwise(0).alias("passes"), "parts", *passing)


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole pass over a document and one for each further run of its words (joined by spaces)."""
    cols = docs.columns
    m = mix(docs.withColumn("_row", F.struct(*cols)), passing=("_row",), **parameters)
    whole = F.transform(F.sequence(F.lit(1), F.col("passes")), lambda i: F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("words")))
    m = m.withColumn("p", F.explode(F.concat(F.when(F.col("passes") > 0, whole).otherwise(F.slice(whole, 1, 0)), "parts")))
    words = F.slice(F.regexp_extract_all("_row.text", F.lit(WORD), F.lit(0)), (F.col("p.start") + 1).cast("int"), F.greatest(F.col("p.words"), F.lit(0)).cast("int"))
    text = F.when(F.col("p.words") < 0, F.col("_row.text")).otherwise(F.array_join(words, " "))
    named = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in cols else {})
    return m.select(*[named.get(c, F.col(f"_row.`{c}`")).alias(c) for c in cols])
