"""Queries of the whole live order: normalised, cut, scored by both scorers, decided by policy and lists. Normalising has no SQL form; the tests hold them against cases and the streams against the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as n
from ..functions import render as r
from ..functions import text as t
from ..operators import logs, report
from ..operators import scoring as s
from ..streaming import detect, live
from .detection import documents, live_model, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
KEY = ["conv_id", "turn"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def units(spark, sf):
    return table(spark, sf, "conversations").dropDuplicates(KEY)


@query
def live_truncated(spark, sf):
    d = documents(spark, sf).where("text is not null")
    return d.select("doc_id", t.first_words(n.normalise(F.col("text"))).alias("text"))


@query
def live_verdicts(spark, sf):
    d = documents(spark, sf).dropDuplicates(["doc_id"])
    return s.live_verdicts(d, live_model(spark, sf), ["doc_id"]).drop("text")


@query
def live_verdicts_by_mode(spark, sf):
    scores = s.live_scores(units(spark, sf), live_model(spark, sf), KEY)
    scores = scores.withColumn("mode", F.explode(F.array(*[F.lit(x) for x in ("hybrid", "nb", "lexicon")])))
    return s.decided(scores, [*KEY, "mode"], F.col("mode")).groupBy("mode", "verdict").agg(F.count("*").alias("n"))


@query
def live_page_alerts(spark, sf):
    """The document whose flag is a language's third, where every language is a page."""
    d = documents(spark, sf).dropDuplicates(["doc_id"])
    found = s.live_verdicts(d.withColumn("lang", F.coalesce("lang", F.lit(""))), live_model(spark, sf), ["lang", "doc_id"])
    return logs.page_alerts(found.withColumn("unit", F.col("doc_id")), "lang", "doc_id", "unit")


def stream(spark, sf):
    return detect.read_units(spark, f"{sf}/conversations.parquet")


@query
def stream_live_detections(spark, sf):
    return live.live_detections(stream(spark, sf), live_model(spark, sf), live.shared_path(spark, "live"))


def verdicts(spark, sf):
    """Whole verdicts of the turns as a stream."""
    return live.verdict_stream(stream(spark, sf), live_model(spark, sf), live.shared_path(spark, "verdicts"))


@query
def stream_detections(spark, sf):
    """The log's rows: every unit that no whitelist exempts, once."""
    return detect.run_available(verdicts(spark, sf).select(*KEY, "text", "score", "verdict", "flagged"))


@query
def stream_page_alerts(spark, sf):
    return detect.run_available(detect.streamed_alerts(verdicts(spark, sf)))


@query
def log_report_lines(spark, sf):
    """The report's texts as the lines that a page shows, with the verdict of each entry."""
    d = s.live_verdicts(units(spark, sf), live_model(spark, sf), KEY).where("verdict <> 'exempt'")
    d = report.report_rows(d.withColumn("score", F.round("score", 3)).withColumn("mode", F.lit("hybrid")), "conv_id", "turn")
    return d.select(*KEY, "number", "verdict", "percentage", "mode", F.posexplode(r.wrapped_lines(F.col("text"), 91)).alias("line", "text"))


@query
def stream_running_log(spark, sf):
    """Counters and last entries of each conversation after the stream's last batch."""
    path = live.shared_path(spark, "log")
    live.start(live.running_log(verdicts(spark, sf)), path, mode="update").awaitTermination()
    return live.present(live.written(spark, path, live.LOG))


@query
def stream_visit_alerts(spark, sf):
    """Alerts where every sixteen turns of a conversation are a visit."""
    path = live.shared_path(spark, "visits")
    found = verdicts(spark, sf).withColumn("visit", F.floor(F.col("turn") / 16))
    live.start(live.visit_alerts(found), path).awaitTermination()
    return live.written(spark, path, "conv_id long, visit long, alert_at long").drop("batch")
