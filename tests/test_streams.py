"""Quiet scopes, settings generations, bounded state, tabs and diagnostics."""

import datetime
import time

from pyspark.sql import functions as F

from aggrolens.operators import scoring as s
from aggrolens.plans import QUERIES
from aggrolens.storage import shared_path
from aggrolens.streaming import bounded, quiet, settings

T0 = datetime.datetime(2024, 1, 1)


def rows_at(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_burst_is_one_scan(spark, tmp_path):
    """Records of a burst come in several batches, and a second burst follows."""
    src, out, schema = str(tmp_path / "src"), str(tmp_path / "out"), "page_id long, node int"
    rows_at(spark, src, [(1, 1), (1, 2), (2, 9)], schema)
    q = quiet.started(quiet.quiet_scans(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), quiet_ms=6000), out)
    got = lambda: quiet.written(spark, out).collect() if (tmp_path / "out" / "rows").exists() else []
    try:
        end = time.time() + 60
        while not any(p["numInputRows"] for p in q.recentProgress) and time.time() < end:
            time.sleep(0.1)
        rows_at(spark, src, [(1, 2), (1, 3)], schema)
        quiet_end = time.time() + 60
        while len(got()) < 2 and time.time() < quiet_end:
            time.sleep(0.3)
        first = sorted((r.scope, r.records, r.nodes) for r in got())
        rows_at(spark, src, [(1, 1)], schema)
        while len(got()) < 3 and time.time() < quiet_end + 60:
            time.sleep(0.3)
    finally:
        q.stop()
    assert first == [(1, 4, [1, 2, 3]), (2, 1, [9])]
    assert sorted((r.scope, r.records, r.nodes) for r in got()) == [(1, 1, [1]), (1, 4, [1, 2, 3]), (2, 1, [9])]
    assert all(r.last_at >= r.first_at for r in got())


def test_bursts_by_time(spark, tmp_path):
    ms = lambda x: T0 + datetime.timedelta(milliseconds=x)
    rows = [(1, ms(0)), (1, ms(300)), (1, ms(700)), (1, ms(1101)), (2, ms(100)), (2, ms(100))]
    d = spark.createDataFrame(rows, "scope long, at timestamp")
    got = {(r.scope, r.first_at, r.closes_at, r.records) for r in quiet.bursts(d, "scope", "at").collect()}
    assert got == {(1, ms(0), ms(1100), 3), (1, ms(1101), ms(1501), 1), (2, ms(100), ms(500), 2)}
    spark.createDataFrame([*rows, (9, ms(10_000))], d.schema).write.parquet(str(tmp_path / "e"))
    stream = quiet.bursts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "e")), "scope", "at", late="1 second")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.scope, r.first_at, r.closes_at, r.records) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == got


UNITS = [(1, 1, "u", "you zebra"), (1, 2, "u", "hello idiot"), (2, 1, "u", "pathetic moron trash"), (2, 2, "u", None)]


def supervised(spark, base):
    q = settings.supervise(spark.readStream.schema(settings.UNITS).parquet(f"{base}/units"), settings.read_settings(spark, f"{base}/settings"), f"{base}/run", None)
    q.awaitTermination()
    return {(r.conv_id, r.turn): (r.verdict, r.generation) for r in settings.present(spark, f"{base}/run").collect()}


def test_settings_rescan(spark, tmp_path):
    base = str(tmp_path)
    rows_at(spark, f"{base}/units", UNITS, settings.UNITS)
    rows_at(spark, f"{base}/settings", [(1, True, "lexicon", ["scum"], ["idiot"])], settings.SETTINGS)
    assert supervised(spark, base) == {(1, 1): ("safe", 1), (1, 2): ("exempt", 1), (2, 1): ("aggressive", 1)}
    rows_at(spark, f"{base}/settings", [(3, True, "lexicon", ["zebra"], [])], settings.SETTINGS)  # no unit comes, all are scanned again
    want = {(1, 1): ("blocked", 3), (1, 2): ("aggressive", 3), (2, 1): ("aggressive", 3)}
    assert supervised(spark, base) == want
    rows_at(spark, f"{base}/settings", [(2, True, "lexicon", [], [])], settings.SETTINGS)  # stale
    rows_at(spark, f"{base}/units", [(3, 1, "u", "a zebra"), (1, 1, "u", "you zebra")], settings.UNITS)
    assert supervised(spark, base) == want | {(3, 1): ("blocked", 3)}
    rows_at(spark, f"{base}/settings", [(4, False, "lexicon", [], [])], settings.SETTINGS)
    assert supervised(spark, base) == {}
    rows_at(spark, f"{base}/units", [(4, 1, "u", "unseen zebra")], settings.UNITS)
    assert supervised(spark, base) == {}
    rows_at(spark, f"{base}/settings", [(5, True, "lexicon", ["unseen"], [])], settings.SETTINGS)
    assert {k: x[0] for k, x in supervised(spark, base).items()} == {(1, 1): "safe", (1, 2): "aggressive", (2, 1): "aggressive", (3, 1): "safe", (4, 1): "blocked"}


def test_settings_query_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["stream_settings_rescan"](spark, sf).collect()
    d = spark.read.parquet(f"{sf}/conversations.parquet").dropDuplicates(["conv_id", "turn"])
    word = d.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").first()["w"]
    want = s.live_verdicts(d, None, ["conv_id", "turn"], "lexicon", blocklist=[word], whitelist=[]).collect()
    assert {(r.conv_id, r.turn, r.verdict) for r in got} == {(r.conv_id, r.turn, r.verdict) for r in want} and "blocked" in {r.verdict for r in got}


def test_state_stays_small(spark, tmp_path):
    """Twenty batches an hour apart: the state holds one hour's keys, repeats within it go, and what comes late is dropped and counted."""
    schema, src = "unit long, at timestamp, text string", str(tmp_path / "src")
    for hour in range(20):
        at = T0 + datetime.timedelta(hours=hour)
        rows = [(hour * 100 + i, at + datetime.timedelta(seconds=i), "x") for i in range(50)]
        late = [(7, T0, "late")] * 3 if hour == 10 else []
        rows_at(spark, src, rows + rows[:20] + late, schema)
        time.sleep(0.02)
    stream = bounded.once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), ["unit"], "at", "10 minutes")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "o"))
    assert rows.count() == rows.select("unit").distinct().count() == 1000
    assert bounded.late_rows(q) == 3 and max(bounded.state_rows(q)) <= 100


def test_tabs(spark, tmp_path):
    e = [(1, 1, 1, "detection", 1), (1, 2, 2, "detection", 0), (1, 3, 1, "activation", 0), (1, 4, 1, "detection", 0), (1, 5, 2, "activation", 0), (1, 6, 1, "activation", 0), (2, 7, 5, "activation", 0)]
    schema = "scope long, seq long, tab long, kind string, flagged int"
    want = [(1, 3, 1, 1, 1), (1, 5, 2, 1, 0), (1, 6, 1, 2, 1), (2, 7, 5, 0, 0)]
    assert sorted(map(tuple, bounded.activations(spark.createDataFrame(e, schema)).collect())) == want
    for part in (e[:4], e[4:], [(1, 8, 1, "closed", 0), (1, 9, 1, "activation", 0)]):
        rows_at(spark, str(tmp_path / "e"), part, schema)
        time.sleep(0.02)
    stream = bounded.shown_tabs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect())) == sorted([*want, (1, 9, 1, 0, 0)])


def test_tab_queries_agree(spark):
    sf = "/root/testdata/sf0.001"
    assert sorted(map(tuple, QUERIES["tab_activations"](spark, sf).collect())) == sorted(map(tuple, QUERIES["stream_tab_activations"](spark, sf).collect()))


def test_diagnostics(spark, tmp_path):
    rows_at(spark, str(tmp_path / "u"), [(i, None if i % 4 == 0 else "x") for i in range(40)], "i long, text string")
    log = bounded.Diagnostics(most=3)
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("i long, text string").parquet(str(tmp_path / "u"))
        watched = bounded.observed(stream, "texts", F.col("text").isNull())
        q = watched.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        log.wait(q)
        broken = stream.select(F.raise_error(F.lit("no good")).alias("x")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
        try:
            broken.awaitTermination()
        except Exception:  # noqa: BLE001
            log.wait(broken)
    finally:
        spark.streams.removeListener(log)
    assert [(a, b, c) for a, b, c, _ in log.recent()][:1] == [("warning", "texts", "10 of 40 rows failed")] and log.recent()[-1][0] == "error"
    for i in range(9):
        log.record("warning", "more", str(i))
    assert [x[2] for x in log.recent()] == ["6", "7", "8"] and log.frame(spark).count() == 3
    log.clear()
    assert log.recent() == []


def test_quiet_query(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["stream_quiet_scans"](spark, sf).collect()
    from aggrolens.operators import nodes
    from aggrolens.streaming import changes

    records = changes.change_records(nodes.nodes(spark.read.parquet(f"{sf}/pages.parquet"))).groupBy("page_id").agg(F.count_distinct("node").alias("n")).collect()
    assert {r.page_id: r.n_nodes for r in got} == {r.page_id: r.n for r in records}


def test_paths_differ(spark):
    assert shared_path(spark, "a") != shared_path(spark, "a")
