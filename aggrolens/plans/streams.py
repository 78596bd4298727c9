"""Queries of streams with timers, changing settings, watermarks and activations, each over a given table, with SQL where their batch form has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nodes
from ..storage import shared_path
from ..streaming import bounded, changes, quiet, settings
from ..streaming.detect import run_available
from .detection import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def streamed(spark, sf, name):
    """A table as a stream; a single file is given as a pattern, which the source takes."""
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{path[:-1]}[{path[-1]}]")


_GAP = "4 hours"


@query(
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {_GAP} THEN 0 ELSE 1 END AS opens FROM events),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id AS scope, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS first_at, strftime(max(ts) + INTERVAL {_GAP}, '%Y-%m-%dT%H:%M:%S.%f') AS closes_at, count(*) AS records, count(*) FILTER (event_type = 'error') AS errors FROM n GROUP BY user_id, burst"""
)
def scan_bursts(spark, sf):
    """Bursts of a user's events, each with the time at which it is scanned: four quiet hours after its last event."""
    d = table(spark, sf, "events").withColumnRenamed("user_id", "scope")
    found = quiet.bursts(d, "scope", "ts", _GAP, errors=F.count_if(F.col("event_type") == "error"))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c in ("first_at", "closes_at")})


@query()
def stream_scan_bursts(spark, sf):
    """The bursts that a stream of events can close: all but those which a later event might still extend."""
    d = streamed(spark, sf, "events").withColumnRenamed("user_id", "scope")
    return run_available(quiet.bursts(d, "scope", "ts", _GAP, late="1 hour", errors=F.count_if(F.col("event_type") == "error")))


@query()
def stream_quiet_scans(spark, sf):
    """Different nodes that pages' change records name, gathered until a page has been quiet by the clock."""
    path = shared_path(spark, "quiet")
    records = changes.change_records(nodes.nodes(table(spark, sf, "pages")))
    records.write.parquet(f"{path}/records")
    scans = quiet.quiet_scans(spark.readStream.schema(records.schema).parquet(f"{path}/records"))
    total = spark.read.schema(records.schema).parquet(f"{path}/records").count()
    q = quiet.started(scans, path)
    quiet.until(q, lambda: quiet.given(spark, path), total)
    found = quiet.written(spark, path).select("scope", F.explode("nodes").alias("node")).distinct()
    return found.groupBy(F.col("scope").alias("page_id")).agg(F.count("*").alias("n_nodes"))


@query()
def stream_settings_rescan(spark, sf):
    """Verdicts on conversations after settings changed in a running stream: the new blocklist is the word of five letters or more that most turns have."""
    path = shared_path(spark, "settings")
    d = table(spark, sf, "conversations")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))
    found = d.select("conv_id", "turn", F.explode(F.array_distinct(words)).alias("word")).dropDuplicates().groupBy("word").agg(F.count("*").alias("n"))
    top = found.orderBy(F.desc("n"), "word").limit(1)
    feed = lambda: settings.read_settings(spark, f"{path}/feed")
    first = settings.default_settings("lexicon") | {"generation": 1}
    columns = [c.split()[0] for c in settings.SETTINGS.split(", ")]
    spark.createDataFrame([tuple(first[c] for c in columns)], settings.SETTINGS).write.mode("append").parquet(f"{path}/feed")
    settings.supervise(streamed(spark, sf, "conversations"), feed(), path, None).awaitTermination()
    none = F.array().cast("array<string>")
    top.select(F.lit(2).cast("long").alias("generation"), F.lit(True).alias("enabled"), F.lit("lexicon").alias("mode"), F.array("word").alias("blocklist"), none.alias("whitelist")).write.mode("append").parquet(f"{path}/feed")
    settings.supervise(streamed(spark, sf, "conversations"), feed(), path, None).awaitTermination()
    return settings.present(spark, path)


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_events_once(spark, sf):
    """Events, each once, from a stream that remembers a day's."""
    d = bounded.once(streamed(spark, sf, "events"), ["event_id"], "ts", "1 day")
    return run_available(d.select("event_id", "user_id", "event_type"))


def tab_events(d):
    """Events as those of three tabs of each user's window: sign-ups activate a tab, the others are detections, errors flagged."""
    kind = F.when(F.col("event_type") == "signup", "activation").otherwise("detection")
    return d.select(F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("tab"), kind.alias("kind"), (F.col("event_type") == "error").cast("int").alias("flagged"))


_SHOWN = """WITH e AS (SELECT user_id AS scope, event_id AS seq, event_id % 3 AS tab, event_type FROM events),
c AS (SELECT *, coalesce(count(*) FILTER (event_type <> 'signup') OVER w, 0) AS total, coalesce(count(*) FILTER (event_type = 'error') OVER w, 0) AS aggressive FROM e WINDOW w AS (PARTITION BY scope, tab ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT scope, seq, tab, total, aggressive FROM c WHERE event_type = 'signup'"""


@query(_SHOWN)
def tab_activations(spark, sf):
    """What a window shows from each activation on."""
    return bounded.activations(tab_events(table(spark, sf, "events")))


@query(_SHOWN)
def stream_tab_activations(spark, sf):
    """The same from a stream of events."""
    return run_available(bounded.shown_tabs(tab_events(streamed(spark, sf, "events"))))


@query()
def stream_diagnostics(spark, sf):
    """Entries that a listener keeps of a stream of turns, of which those without a question mark count as failed."""
    log = bounded.Diagnostics()
    spark.streams.addListener(log)
    try:
        found = bounded.observed(streamed(spark, sf, "conversations"), "turns", ~F.contains("text", F.lit("?")))
        q = found.writeStream.format("noop").option("checkpointLocation", shared_path(spark, "watch")).trigger(availableNow=True).start()
        q.awaitTermination()
        log.wait(q)
    finally:
        spark.streams.removeListener(log)
    return log.frame(spark).select("level", "area", "message")
