"""Explanations add up to scores; models as JSON; word lists; streams as in-memory tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from aggrolens.functions import text as t
from aggrolens.functions import vocab as v
from aggrolens.operators import explain
from aggrolens.operators import scoring as s
from aggrolens.plans import QUERIES
from aggrolens.sources import files
from aggrolens.streaming import live


def model_of(spark, rows):
    return spark.createDataFrame([(w, 1, 1, a, b, -0.7, -0.7) for w, a, b in rows], files.MODEL)


def texts(spark, *xs):
    return spark.createDataFrame(list(enumerate(xs)), "doc_id long, text string")


def test_pushes_add_up_to_the_score(spark):
    model = model_of(spark, [("not_idiot", -4.0, -2.0), ("stupid", -5.0, -3.0), ("nice", -2.0, -4.5), ("gg", -9.0, -1.0)])
    d = texts(spark, "you are not an idiot in here, stupid stupid", "nice nice day gg", "fucking great, stupid", "nothing known")
    found = explain.pushes(d, model, ["doc_id"])
    totals = {r.doc_id: r for r in explain.push_totals(found, ["doc_id"]).collect()}
    nb = {r.doc_id: r.nb for r in s.dampened_nb(d, model).collect()}
    for i in range(3):
        assert nb[i] == pytest.approx(1 / (1 + math.exp(totals[i].safe - totals[i].aggressive)), abs=1e-4)
    assert totals[0].tokens == 3 and totals[0].aggressive == pytest.approx(2 * 0.75 + 2 * 2) and 3 not in totals
    assert totals[1].safe == pytest.approx(5.0)  # gg doesn't count
    top = {(r.doc_id, r.rank): (r.token, r.push) for r in explain.strongest(found, ["doc_id"], 1).collect()}
    assert top[0, 1] == ("stupid", 2.0) and top[1, 1][0] == "nice"


def test_ties_in_text_order(spark):
    model = model_of(spark, [(w, -2.0, -1.0) for w in ("zulu", "alpha", "mike")] + [("you", -2.0, -1.0)])
    got = explain.strongest(explain.pushes(texts(spark, "zulu alpha you zulu mike"), model, ["doc_id"]), ["doc_id"]).orderBy("rank").collect()
    assert [r.token for r in got] == ["zulu", "alpha", "mike"]


def test_reasons(spark):
    model = model_of(spark, [("not_good", -4.0, -1.0), ("not_stupid", -1.0, -4.0), ("moron", -6.0, -1.0), ("hello", -1.0, -2.0)])
    d = texts(spark, "you are a pathetic moron and you are stupid", "you are not good, you pathetic moron", "hello you are not stupid", "hello my friend you are here", "oh great you moron are so late and so pathetic")
    got = {r.doc_id: (r.flagged, r.reasons) for r in explain.explained(d, model, ["doc_id"]).collect()}
    assert got[0] == (1, f"{v.REASONS[1]}, {v.REASONS[3]}") and got[1][1].startswith(f"{v.REASONS[0]}, {v.REASONS[1]}")
    assert got[2] == (0, ", ".join(v.SAFE_REASONS)) and got[3] == (0, ", ".join(v.SAFE_REASONS[1:]))
    assert v.REASONS[2] in got[4][1]


def test_blanks_part_words(spark):
    d = texts(spark, "good day new　car﻿end")
    assert d.select(t.live_words(F.col("text"))).first()[0] == ["good", "day", "new", "car", "end"]


def test_json_model(spark, tmp_path):
    d = spark.createDataFrame([(1, "idiot moron moron", 1), (2, "nice day", 0), (3, "nice", 0)], "doc_id long, text string, label int")
    model = s.train_nb(d)
    files.write_json_model(model, str(tmp_path / "m"))
    back = files.read_json_model(spark, str(tmp_path / "m"))
    rounded = lambda m: sorted((r.token, r.c0, r.c1, round(r.ll0, 9), round(r.ll1, 9), round(r.prior0, 9), round(r.prior1, 9)) for r in m.collect())
    assert rounded(back) == rounded(model)
    (tmp_path / "bare.json").write_text(json.dumps({"log_prior": {"0": -0.5, "1": -1.0}, "log_likelihood": {"0": {"a": -1.0, "b": -2.0}, "1": {"a": -3.0}}, "made_by": "someone"}))
    got = {r.token: (r.c0, r.ll0, r.ll1, r.prior1) for r in files.read_json_model(spark, str(tmp_path / "bare.json")).collect()}
    assert got == {"a": (None, -1.0, -3.0, -1.0), "b": (None, -2.0, 0.0, -1.0)}
    score = s.score_nb(spark.createDataFrame([(1, "aa")], "doc_id long, text string"), files.read_json_model(spark, str(tmp_path / "bare.json")))
    assert score.first().nb == pytest.approx(1 / (1 + math.exp(0.5)))
    files.write_json_model(model.limit(0), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_shown(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (2,)], "k long").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k long").parquet(str(tmp_path / "s")).groupBy("k").count()
    q = live.shown(stream, "shown_now", mode="complete")
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("shown_now").collect())) == [(1, 1), (2, 2)]
    finally:
        q.stop()


def test_word_lists_read_parts(spark):
    got = {r.outcome for r in QUERIES["list_move"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {"exists", "moved", "added"}
