"""Live scans under settings that change while they run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators import scoring as s
from .live import VERDICTS, fenced

SETTINGS = "generation long, enabled boolean, mode string, blocklist array<string>, whitelist array<string>"
UNITS = "conv_id long, turn long, role string, text string"
KEY = ["conv_id", "turn"]


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """A stream of settings: a row for each change, with a higher generation."""
    return spark.readStream.schema(SETTINGS).parquet(path)


def default_settings(mode: str = "hybrid") -> dict:
    return {"generation": 0, "enabled": True, "mode": mode, "blocklist": v.BLOCKLIST, "whitelist": v.WHITELIST}


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def settings_at(spark: SparkSession, path: str, batch: int) -> dict:
    """The settings of the highest generation that had come by a batch; without any the defaults."""
    if batch < 0:
        return default_settings()
    found = _rows(spark, f"{path}/settings", SETTINGS).where((F.col("batch") <= batch) & F.col("generation").isNotNull()).orderBy(F.desc("generation"), F.desc("batch")).drop("batch").first()
    return found.asDict() if found else default_settings()


def supervise(units: DataFrame, settings: DataFrame, path: str, model: DataFrame | None, once: bool = True, cadence: str = "400 milliseconds"):
    """Scan a stream of units by the settings of the same moment; the started query.

    Units and settings are one stream, so a change of settings wakes the query though no unit comes.
    A batch of a new generation scans every unit again, any other one only its own units; verdicts
    carry their generation, and present() shows those of the newest one only, so what was under way
    when settings changed is never seen. An older generation that comes late changes nothing.
    Each batch writes its units, settings and verdicts to folders of its own, which a batch that
    runs again replaces; the tables, not memory, hold what has been.
    """
    both = units.select(*KEY, "role", "text").unionByName(settings, allowMissingColumns=True)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        at = lambda kind: f"{path}/{kind}/batch={number}"
        batch.where("generation is not null").select(*[c.split()[0] for c in SETTINGS.split(", ")]).write.mode("overwrite").parquet(at("settings"))
        new = batch.where("conv_id is not null and text is not null").select(*KEY, "role", "text").dropDuplicates(KEY)
        if number:
            new = new.join(_rows(spark, f"{path}/units", UNITS).where(F.col("batch") < number).select(*KEY), KEY, "left_anti")
        new.write.mode("overwrite").parquet(at("units"))
        now, before = settings_at(spark, path, number), settings_at(spark, path, number - 1)
        known = _rows(spark, f"{path}/units", UNITS).where(F.col("batch") <= number)
        asked = known if now["generation"] != before["generation"] else known.where(F.col("batch") == number)
        if not now["enabled"]:
            asked = asked.limit(0)
        found = s.live_verdicts(asked.drop("batch", "role"), model, KEY, now["mode"], blocklist=now["blocklist"], whitelist=now["whitelist"])
        found.withColumn("generation", F.lit(now["generation"]).cast("long")).write.mode("overwrite").parquet(at("verdicts"))
        batch.unpersist()

    w = both.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=cadence)).start()


def present(spark: SparkSession, path: str) -> DataFrame:
    """The verdicts that hold now: those of the newest generation that has come, if it is enabled. While a new generation's first batch is under way there are none."""
    found = _rows(spark, f"{path}/verdicts", f"{VERDICTS}, generation long")
    now = settings_at(spark, path, 1 << 62)
    current = spark.createDataFrame([("all", now["generation"], now["enabled"])], "scope string, generation long, enabled boolean")
    return fenced(found.withColumn("scope", F.lit("all")), current, "scope").drop("scope", "batch")
