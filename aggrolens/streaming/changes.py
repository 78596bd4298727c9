"""Scans of what is added to pages, as a stream of change records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nodes as t
from ..storage import shared_path, stored

RECORDS = "page_id long, node int, at int"
UNITS = "page_id long, node int, text string"


def change_records(tree: DataFrame, rounds: int = 3) -> DataFrame:
    """Records (page_id, node, at) as if each page had been built in rounds: every second node, by a hash, is named as added, elements and texts alike, some of them again in the next round, and some that have been taken out meanwhile."""
    h = F.crc32(F.concat_ws(":", "page_id", "node").cast("binary"))
    d = tree.select("page_id", "node", (h % rounds).cast("int").alias("at"), (F.shiftright(h, 8) % 16).alias("lot"))
    again = d.where("lot < 2").select("page_id", "node", ((F.col("at") + 1) % rounds).alias("at"))
    gone = d.where("lot = 2").select("page_id", (F.col("node") + 1_000_000).alias("node"), "at")
    return d.where("lot < 8").select("page_id", "node", "at").union(again).union(gone)


def scanned(records: DataFrame, tree: DataFrame, path: str) -> DataFrame:
    """Run a stream of change records against the tree's table, and give the scanned texts: page_id, node, text, each node once.

    Each batch scans the subtrees of its own roots, less the nodes that earlier batches have
    written; a batch that runs again replaces its own folder, so nothing comes twice or is lost.
    What has been scanned is that table, in the shared folder, and not state in memory.
    """
    spark = records.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        units = t.subtree_units(t.scan_roots(batch, tree), tree)
        if number:
            before = scanned_so_far(spark, path).where(F.col("batch") < number).select("page_id", "node")
            units = units.join(before, ["page_id", "node"], "left_anti")
        units.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        batch.unpersist()

    q = records.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return scanned_so_far(spark, path).drop("batch")


def scanned_so_far(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{UNITS}, batch long").parquet(f"{path}/rows")


def scan_changes(pages: DataFrame, files: int = 4) -> DataFrame:
    """The texts that a stream of pages' change records makes scanned, a few files of records at a time."""
    spark = pages.sparkSession
    tree = stored(t.nodes(pages), "tree")
    path = shared_path(spark, "changes")
    change_records(tree).repartition("at").write.partitionBy("at").parquet(f"{path}/records")
    records = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files).parquet(f"{path}/records")
    return scanned(records, tree, path)
