"""Cases of findings of the third round."""

import pytest
from pyspark.sql import functions as F

from aggrolens.functions import normalise as n
from aggrolens.functions import text as t
from aggrolens.functions import vocab as v
from aggrolens.operators import explain, report
from aggrolens.operators import scoring as s
from aggrolens.plans import ORACLE_SQL
from aggrolens.storage import stored
from aggrolens.streaming import quiet


def texts(spark, *given):
    return spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")


def test_words_end_at_other_letters(spark):
    """A word's edge is that of ASCII letters, as in the SQL: 'im' ends before an umlaut."""
    d = texts(spark, "enpfch, im\u00e4verge erbe", "imx verge", "i\x0bam sad")
    assert [r[0] for r in d.orderBy("doc_id").select(t.self_distress(F.col("text"))).collect()] == [True, False, False]
    d = texts(spark, "nice \u00e9but\u00e9 you are stupid")
    assert d.select(t.direct_insult_clause(F.col("text"))).first()[0] == "\u00e9 you are stupid"
    assert texts(spark, "\u00e4kys\u00e4").select(t.split_slang(F.col("text"))).first()[0] == "\u00e4kill yourself\u00e4"


def scans(d, what):
    return d._jdf.queryExecution().optimizedPlan().toString().count(what)


def model(spark):
    return spark.createDataFrame([("idiot", 0, 3, -3.0, -1.0, -0.5, -0.9), ("not_idiot", 1, 2, -2.0, -1.5, -0.5, -0.9), ("lovely", 3, 0, -1.0, -3.0, -0.5, -0.9)], "token string, c0 long, c1 long, ll0 double, ll1 double, prior0 double, prior1 double")


def test_highlights_read_texts_once(spark):
    """What is highlighted comes of stored parts: no plan over the texts is left, and a negation is shown with the word after it."""
    d = texts(spark, "Not an idiot, oh great", "idiot")
    found = report.highlights(d, model(spark))
    assert scans(found, "text#") == 0
    assert {tuple(r) for r in found.collect()} >= {(0, "negation", "Not"), (0, "negation", "idiot"), (0, "sarcasm", "oh great"), (1, "nb", "idiot")}


def test_explanations_read_texts_once(spark):
    m = stored(model(spark), "model")
    d = texts(spark, "you are an idiot", "not an idiot", "lovely day", "", "nothing known")
    found = explain.explained(d, m, ["doc_id"])
    assert scans(found, "LogicalRDD") == 1
    assert [tuple(r)[1:] for r in found.orderBy("doc_id").collect()][0][1].startswith("aggressive-leaning words")


def test_live_words_of_odd_blanks(spark):
    got = texts(spark, "A b　c﻿d\x0be éf​g h\x00i \U0001f600j9-k").select(t.live_words(F.col("text"))).first()[0]
    assert got == ["a", "b", "c", "d", "e", "fg", "hi", "jk"]


def test_letters_apart_are_looked_for_where_a_word_can_begin():
    assert n.begins("5t") and n.begins("stuu") and n.begins("@") and not n.begins("the7") and not n.begins("stü")
    assert n.normalised("so s t u p i d, 1 d i o t and du.m.b a$$") == "so stupid, idiot and dumbass"
    assert n.normalised(" ".join(["word"] * 600 + ["st*pid"])).endswith("word stupid")


def test_whole_lexicon_scores(spark):
    """lexicon_scores knows every term and inflected form that its SQL once had, and both agree on them."""
    assert {"subhuman", "despised", "stupidest", "happily"} <= set(v.whole_lexicon()) and set(v.LEXICON) < set(v.whole_lexicon())
    assert len(v.whole_lexicon()) == 351 and v.whole_lexicon()["stupid"] == v.LEXICON["stupid"]
    sql, d = ORACLE_SQL["lexicon_scores"], texts(spark, "you are the stupidest subhuman", "happily despised")
    assert "WHEN 'subhuman'" in sql and "WHEN 'subhuman'" not in ORACLE_SQL["lexicon_hits"]
    assert all(r.lex != 0 or r.compound != 0 for r in s.score_lexicon(d, lexicon=v.whole_lexicon()).collect())
    assert any(r.lex == 0 for r in s.score_lexicon(texts(spark, "subhuman")).collect())


def test_unfinished_scans_are_an_error():
    """A stream that is stopped before all is written must not pass for a whole one."""

    class Stuck:
        isActive, stopped = True, False

        def stop(self):
            self.stopped = True

    q = Stuck()
    with pytest.raises(TimeoutError):
        quiet.until(q, lambda: 1, 2, seconds=0.3)
    assert q.stopped
