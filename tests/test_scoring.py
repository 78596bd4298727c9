"""Known scores, policy and disguises."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from aggrolens.functions import normalise as n
from aggrolens.functions import render
from aggrolens.functions import text as t
from aggrolens.functions import vocab as v
from aggrolens.operators import lists, logs, pages
from aggrolens.operators import scoring as s
from aggrolens.sources import files
from aggrolens.streaming import detect, live


#: A lexicon that a caller passes.
PASSED = {"worthless": -3.3, "idiot": -3.1, "stupid": -2.9, "moron": -3.0, "pathetic": -2.8, "great": 3.1}


def scores(spark, texts, lexicon=PASSED):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.lex for r in s.score_lexicon(d, lexicon=lexicon).orderBy("doc_id").collect()]


@pytest.mark.parametrize(
    "text,value",
    [
        ("you worthless idiot right there", 0.8965),
        ("a b c d e f g h i worthless idiot", 0.8879),
        ("he is not a stupid person", 0.0),
        ("you are not at all really a moron", 0.0),
        ("not one two three moron", 0.6882),
        ("you are pathetic but you are great", 0.6629),
        ("great idiot", 0.0),
        ("nothing here", 0.0),
    ],
)
def test_valence(spark, text, value):
    got = scores(spark, [text])[0]
    if text == "you are not at all really a moron":
        assert got > 0.6  # the negation is out of reach, the booster in it
    else:
        assert got == pytest.approx(value, abs=1e-4)


def test_another_lexicon(spark):
    """use() reaches scores, recovery and the normaliser's workers, and is undone by the default."""
    default = dict(v.LEXICON)
    try:
        v.use({"zorbish": -3.0, "fine": 2.0})
        assert n.normalised("you z0rb1sh, st*pid") == "you zorbish, st*pid"
        d = spark.createDataFrame([(1, "you zrobish"), (2, "you stupid")], "doc_id long, text string").select("doc_id", n.normalise(F.col("text")).alias("text"))
        assert [(r.text, r.lex > 0.5) for r in s.score_lexicon(d).orderBy("doc_id").collect()] == [("you zorbish", True), ("you stupid", False)]
    finally:
        v.use(default)
    assert n.normalised("st*pid") == "stupid"


def test_emphasis(spark):
    plain, loud, marked, four, nine = scores(spark, ["you idiot", "you IDIOT", "you idiot!", "you idiot!!!!", "you idiot!!!!!!!!!"])
    assert plain < loud and plain < marked < four == nine


def test_policy(spark):
    d = spark.createDataFrame([(0.9, "ang mga ng sila kami"), (0.9, "i hate myself so much it is bad"), (0.9, "you are a bad person and we know it"), (0.4, "ang mga ng sila")], "x double, text string")
    got = [r[0] for r in d.select(F.round(s.guarded(F.col("x"), F.col("text")), 6)).collect()]
    assert got == [0.0, 0.36, 0.9, 0.4]
    assert [r[0] for r in d.select(s.guarded(F.col("x"), F.col("text"), "nb")).collect()] == [0.9, 0.9, 0.9, 0.4]


def test_blend(spark):
    d = spark.createDataFrame([(0.8, 0.2, 3), (0.8, 0.2, 0)], "nb double, lex double, m int")
    assert [round(r[0], 6) for r in d.select(s.blended(F.col("nb"), F.col("lex"), F.col("m"))).collect()] == [0.56, 0.2]


def test_first_words(spark):
    d = spark.createDataFrame([(" ".join(["w"] * 138),), ("a  b",), (None,)], "text string")
    a, b, c = (r[0] for r in d.select(t.first_words(F.col("text"))).collect())
    assert len(a.split(" ")) == 128 and b == "a  b" and c is None


def test_nb_trace_is_score(spark):
    d = spark.createDataFrame([(1, "idiot moron talk", 1), (2, "nice talk", 0), (3, "nice day", 0), (4, "moron", 1)], "doc_id long, text string, label int")
    m = s.train_nb(d)
    got = {r.doc_id: r.nb for r in s.score_nb(d, m).collect()}
    assert got[1] > got[2] and got[4] > 0.5 > got[3]
    assert s.score_nb(spark.createDataFrame([(9, "unknown", 0)], d.schema), m).first().nb == pytest.approx(0.5)


@pytest.mark.parametrize("text,plain", [("you st*pid", "you stupid"), ("1d10t", "idiot"), ("m0r0n!", "moron!"), ("i.d.i.o.t", "idiot"), ("STUP1D", "STUPID"), ("wrothless", "worthless"), ("loooser", "loser"), ("ｔｒａｓｈ", "trash")])
def test_disguises(text, plain):
    assert n.normalised(text) == plain
    assert n.normalised(n.normalised(text)) == plain


@pytest.mark.parametrize("text", ["class act", "a well-known fact", "grass", "1984", "hello world", "user@example.com", "étude", "lesser", ""])
def test_plain_words_stay(text):
    assert n.normalised(text) == text


def test_whole_texts(spark, tmp_path):
    from aggrolens.plans import QUERIES

    long = "word " * 150
    d = spark.createDataFrame([(1, f"{long}you st*pid scum, IDIOT clown")], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["normalize_text"](spark, str(tmp_path)).first().text == f"{long}you stupid scum, IDIOT clown"
    r = QUERIES["mask_segments"](spark, str(tmp_path)).first()
    assert r.masked == "**** " * 150 + "*** ****** ***** IDIOT clown" and r.n_segments == 4


def test_segments():
    assert n.segments("you are ugly super", ["super"]) == [("you are ugly ", False), ("super", True)]
    assert n.segments("AbaB", ["ab", "ba"]) == [("AbaB", True)]
    assert n.segments("", ["x"]) == []


def test_lists(spark):
    d = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("w"), F.array(F.lit("c")).alias("k"))
    white, block, outcome = lists.moved(F.col("w"), F.col("k"), F.lit(" A"))
    assert list(d.select(white, block, outcome).first()) == [["b"], ["c", "a"], "moved"]
    assert d.select(lists.allowed(F.col("w"), F.col("k"), F.lit("c"))).first()[0] == ["a", "b"]
    assert d.select(lists.removed(F.col("w"), F.lit("A "))).first()[0] == ["b"]


def test_pages(spark):
    html = "<nav>Home</nav><p>scum of <b>all</b></p><template shadowrootmode='open'><i>inside</i></template><div style='display: none'>no</div><a>Jane Doe</a><span>12 likes</span><script>x</script>"
    d = spark.createDataFrame([(1, "http://a.b/c", html), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    u = pages.text_units(d)
    assert [r.text for r in pages.readable_units(u).orderBy("seq").collect()] == ["scum of", "all", "inside"]


def test_private(spark):
    d = spark.createDataFrame([("http://mail.example.com/x",), ("http://a.mail.example.com",), ("http://www.example.com/MESSAGES/1",), ("http://example.com/news",), ("nonsense",), ("http://mail.example.com.evil.org/",)], "url string")
    assert [r[0] for r in d.select(pages.private_strict(F.col("url"))).collect()] == [True, True, True, False, True, False]
    assert d.select(pages.private_legacy(F.col("url"))).collect()[5][0]


def test_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "quoted", cell\nof two lines'), (2, "=1+1"), (3, "plain")], "id int, text string")
    files.write_csv(files.safe_export(d).coalesce(1), str(tmp_path / "t.csv"), quote_all=True)
    back = {r.id: r.text for r in files.read_csv(spark, str(tmp_path / "t.csv"), "id int, text string").collect()}
    assert back == {1: 'a "quoted", cell\nof two lines', 2: "'=1+1", 3: "plain"}


def test_prepare(spark):
    d = spark.createDataFrame([(" x ", 0, 1), ("  ", 1, 1), (None, 1, 0), ("y", 0, None)], "comment_text string, toxic int, threat int")
    assert [(r.text, r.label) for r in files.prepare_labelled(d).collect()] == [("x", 1), ("y", 0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, i, "user", "you scum" if (c + i) % 2 else "hello there") for c in range(3) for i in range(8)]
    d = spark.createDataFrame(rows, detect.UNITS)
    d.union(d).repartition(3).write.parquet(str(tmp_path / "u"))
    found = detect.run_available(detect.detections(detect.read_units(spark, str(tmp_path / "u"))))
    batch = detect.detections(d)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
    units = detect.read_units(spark, str(tmp_path / "u")).withColumn("flagged", F.contains("text", F.lit("scum")).cast("int"))
    alerts = detect.run_available(detect.streamed_alerts(units)).collect()
    assert sorted((r.conv_id, r.alert_at) for r in alerts) == [(0, 5), (1, 4), (2, 5)]


def live_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_negated_token_loses_a_quarter(spark):
    model = spark.createDataFrame([("not_idiot", 0, 0, -4.0, -2.0, -0.7, -0.7)], files.MODEL)
    r = s.dampened_nb(live_frame(spark, ["you are not an idiot", "idiot", "gg"]), model).orderBy("doc_id").collect()
    assert [x.matched for x in r] == [1, 0, 0]
    assert r[0].nb == pytest.approx(1 / (1 + 2.718281828459045**-1.5), abs=1e-4)  # three quarters of the difference of two are left
    assert r[1].nb == r[2].nb == 0.5


def test_live_tokens(spark):
    d = spark.createDataFrame([("not not a fine big new car, yeah right",), ("don't you DARE",), ("", ), (None,)], "text string")
    got = [r[0] for r in d.select(t.live_tokens(F.col("text"))).collect()]
    assert got == [["not_fine", "not_big", "new", "car", "yeah", "right", "cue_yeah_right"], ["not_dare"], [], None]


LIVE = {
    "you are an idiot": "exempt", "pure SCUM": "blocked", "scum and clown": "blocked", "you are a l0ser": "aggressive", "you are a l.o.s.e.r": "aggressive", "you are d*mb and pathetic trash": "aggressive", "what a wonderful day for you all": "safe",
    "i feel so stupid and ugly": "safe", "ang mga tao ay stupid stupid stupid po": "safe", "you are stupid": "aggressive", "oh great another meeting, you are so late": "aggressive", "hello": "safe",
}


def test_live_verdicts(spark):
    """Without a known token the lexicon decides alone: disguises count, distress about oneself and other languages don't."""
    model = spark.createDataFrame([("zzz", 1, 1, -1.0, -1.0, -0.7, -0.7)], files.MODEL)
    got = {r.text: (r.verdict, r.score, r.error) for r in s.live_verdicts(live_frame(spark, [*LIVE, None]), model, ["doc_id"]).collect()}
    assert {k: x[0] for k, x in got.items()} == LIVE and all(x[2] is None for x in got.values())
    assert got["pure SCUM"][1] == 1.0 and got["you are an idiot"][1] is None
    none = {r.text: r.score for r in s.live_verdicts(live_frame(spark, ["you are stupid", "hello"]), None, ["doc_id"], "nb").collect()}
    assert none == {"you are stupid": 0.5, "hello": 0.5}


def test_normalise_before_cut(spark):
    text = "s t u p i d " + "word " * 127
    cut = live_frame(spark, [text + "end"]).select(t.first_words(n.normalise(F.col("text")))).first()[0]
    assert cut == "stupid " + "word " * 127 + "end" or cut == ("stupid " + "word " * 127).strip()


@pytest.mark.parametrize("text,plain", [("bithc", "bitch"), ("b***h", "bitch"), ("id**t", "idiot"), ("stpd", "stupid"), ("SUTPID", "STUPID"), ("k.y.s", "kys"), ("iḋiot", "idiot"), ("st\u200bupid", "stupid"), ("wore a shirt, count shot", "wore a shirt, count shot"), ("my assignment in class", "my assignment in class")])
def test_recovery(text, plain):
    assert n.normalised(text) == plain


def test_ui_labels(spark):
    d = spark.createDataFrame([("Like \u00b7 Reply",), ("Comment as Jane",), ("12 mutual friends",), ("I like it",), ("1.2k views | today",)], "text string")
    assert [r[0] for r in d.select(pages.ui_label(F.col("text"))).collect()] == [True, True, True, False, True]


def test_captions_and_cards(spark):
    html = "<p>first</p><span>March 3 at 10:15 am</span><p>caption text</p><span>5 min</span><p>a comment here</p><div aria-label='Friends'><p>in a card</p></div>"
    d = spark.createDataFrame([(1, "http://www.facebook.com/x", html), (2, "http://other.org/x", html)], "page_id long, url string, html string")
    kept = pages.readable_units(pages.with_time_kind(pages.text_units(d))).orderBy("page_id", "seq").collect()
    assert [r.text for r in kept if r.page_id == 2] == ["first", "March 3 at 10:15 am", "5 min", "a comment here", "in a card"] or [r.text for r in kept if r.page_id == 2] == ["first", "March 3 at 10:15 am", "a comment here", "in a card"]
    assert "caption text" not in [r.text for r in kept] and [r.text for r in kept if r.page_id == 1][-1] == "a comment here"


def test_rendering():
    assert render.to_ascii("\u201cna\u00efve\u201d \u2013 \u2026 \u65e5") == '"naive" - ... ?'
    assert render.wrapped("aa bb cc", 5) == ["aa bb", "cc"] and render.wrapped("abcdefg h", 3) == ["abc", "def", "g h"] and render.wrapped("  ") == [""]
    assert re.match(render.host_pattern("*://*.example.com/*"), "example.com") and not re.match(render.host_pattern("*://*.example.com/*"), "example.com.evil.org")


def test_csv_kinds(spark, tmp_path):
    d = spark.createDataFrame([("1", "a, b")], "id string, text string").coalesce(1)
    files.write_csv(d, str(tmp_path / "a"), crlf=True, bom=True)
    part = next((tmp_path / "a").glob("part*")).read_bytes()
    assert part == '\ufeffid,text\r\n1,"a, b"\r\n'.encode()
    (tmp_path / "b.csv").write_text('term,valence\nBad,-2\n"good",1.5\nbroken,x,y\n')
    assert files.read_csv(spark, str(tmp_path / "b.csv"), "term string, valence double", strict=False).count() == 2
    (tmp_path / "c.csv").write_text("term,valence\nBad,-2\ngood,1.5\n")
    assert files.read_lexicon(spark, str(tmp_path / "c.csv")) == {"bad": -2.0, "good": 1.5}
    (tmp_path / "d.json").write_text('[{"a": 1}]')
    assert files.read_table(spark, str(tmp_path / "d.json")).first().a == 1 and files.read_table(spark, str(tmp_path / "c.csv")).count() == 2
    files.write_json(d, str(tmp_path / "j"))
    files.write_lines(d, str(tmp_path / "l"), F.concat_ws(": ", "id", "text"))
    assert spark.read.json(str(tmp_path / "j")).first().text == "a, b" and spark.read.text(str(tmp_path / "l")).first().value == "1: a, b"


def test_models(spark, tmp_path):
    assert files.load_model(spark, str(tmp_path / "none")) is None
    d = spark.createDataFrame([(1, "idiot", 1), (2, "nice", 0)], "doc_id long, text string, label int")
    files.save_model(s.train_nb(d), str(tmp_path / "m"))
    assert files.load_model(spark, str(tmp_path / "m")).count() == 2


def test_quota_and_numbers(spark):
    rows = [(i, int(i % 5 == 0)) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, label int")
    for digits in (1, 4):
        got = {r.doc_id for r in s.first_of_label(d, F.lit(77), digits=digits).where("first").collect()}
        want = {i for y in (0, 1) for i in sorted((i for i, k in rows if k == y), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:77]}
        assert got == want
    got = s.numbered(d.where("doc_id % 3 = 0"), "doc_id", "number", parts=7).orderBy("doc_id").collect()
    assert [r.number for r in got] == list(range(1, len(got) + 1))
    assert s.stratified_split(d.limit(0)).count() == 0 and s.balanced(d.limit(0)).count() == 0


def test_live_stream_equals_batch(spark, tmp_path):
    rows = [(c, i, "user", ["you scum", "you are a l0ser", "hello there", "IDIOT"][(c + i) % 4]) for c in range(3) for i in range(24)]
    d = spark.createDataFrame(rows, detect.UNITS)
    d.union(d).repartition(3).write.parquet(str(tmp_path / "u"))
    stream = detect.read_units(spark, str(tmp_path / "u"))
    model = spark.createDataFrame([("zzz", 1, 1, -1.0, -1.0, -0.7, -0.7)], files.MODEL)
    batch = s.live_verdicts(d, model, ["conv_id", "turn"])
    assert sorted(map(repr, live.live_detections(stream, model, str(tmp_path / "v")).collect())) == sorted(map(repr, batch.collect()))
    found = detect.detections(d)
    whole = live.verdict_stream(stream, model, str(tmp_path / "w"))
    assert sorted(map(repr, detect.run_available(whole).select(batch.columns).collect())) == sorted(map(repr, batch.where("verdict <> 'exempt'").collect()))
    live.start(live.running_log(detect.detections(stream), most=5), str(tmp_path / "g"), mode="update").awaitTermination()
    log = {r.scope: r for r in live.present(live.written(spark, str(tmp_path / "g"), live.LOG)).collect()}
    last = {}
    for r in logs.running_totals(found, "conv_id", "turn").orderBy("turn").collect():
        last[r.conv_id] = (r.total, r.aggressive, r.safe)
    assert {k: (r.total, r.aggressive, r.safe) for k, r in log.items()} == last
    newest = {c: [r.turn for r in logs.last_entries(found, "conv_id", "turn", 5).where(F.col("conv_id") == c).orderBy("age").collect()] for c in log}
    assert {k: r.turns for k, r in log.items()} == newest


def test_visits(spark, tmp_path):
    """A visit's alert needs three flagged units of its own; a scope is warned once."""
    rows = [(1, 0, 1, 1), (1, 0, 2, 1), (1, 1, 3, 1), (1, 1, 4, 1), (1, 1, 4, 1), (1, 1, 5, 1), (1, 2, 6, 1), (1, 2, 7, 1), (1, 2, 8, 1), (2, 0, 1, 1), (2, 0, 2, 0), (2, 0, 3, 1)]
    schema = "conv_id long, visit long, turn long, flagged int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "u"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "u"))
    live.start(live.visit_alerts(stream), str(tmp_path / "a")).awaitTermination()
    assert [(r.conv_id, r.visit, r.alert_at) for r in live.written(spark, str(tmp_path / "a"), "conv_id long, visit long, alert_at long").collect()] == [(1, 1, 5)]


def test_fencing(spark):
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c"), (3, 1, "d")], "tab long, generation long, text string")
    now = spark.createDataFrame([(1, 2, True), (2, 5, False), (4, 1, True)], "tab long, generation long, enabled boolean")
    assert [r.text for r in live.fenced(found, now, "tab").collect()] == ["b"]


def test_vocabularies_are_clean():
    assert not set(v.NEGATORS) & set(v.LEXICON) and all(w == w.lower() for w in v.STOP_WORDS)


def test_streamed_logs_equal_whole_verdicts(spark, tmp_path):
    """Streams by conversation against windows over the batch of whole verdicts; lines of the report against its rows."""
    from aggrolens.plans import QUERIES
    from aggrolens.plans.detection import live_model
    from aggrolens.plans.live import KEY, units

    sf = str(tmp_path)
    for name in ("documents", "labels"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    said = [f"you {v.BLOCKLIST[0]}", "hello there", "a quiet word", f"so {v.WHITELIST[0]} it is", None]
    rows = [(c, i, "user", said[(c * i) % 5]) for c in range(4) for i in range(40)]
    spark.createDataFrame(rows + rows[:9], detect.UNITS).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    found = s.stored(s.live_verdicts(units(spark, sf), live_model(spark, sf), KEY).where("verdict <> 'exempt'"), "found")
    batch = sorted(map(tuple, logs.page_alerts(found.withColumn("unit", F.col("turn")), "conv_id", "turn", "unit").collect()))
    assert batch and sorted(map(tuple, QUERIES["stream_page_alerts"](spark, sf).collect())) == batch
    rows = QUERIES["stream_detections"](spark, sf).select("conv_id", "turn", "verdict", "flagged")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, found.select(rows.columns).collect()))
    totals = found.groupBy("conv_id").agg(F.count("*").alias("total"), F.sum("flagged").alias("aggressive"))
    assert sorted(map(tuple, QUERIES["stream_running_log"](spark, sf).select("scope", "total", "aggressive").collect())) == sorted(map(tuple, totals.collect()))
    lines = QUERIES["log_report_lines"](spark, sf)
    blocked = {(x.conv_id, x.turn) for x in lines.where("verdict = 'BLOCKED'").collect()}
    assert blocked == {(x.conv_id, x.turn) for x in found.where("flagged = 1").collect()}
