"""Recovery by joins against the function that goes text by text."""

import pytest

from aggrolens.functions import normalise as n
from aggrolens.operators import recovery as r
from aggrolens.plans import QUERIES

TEXTS = [
    "you st*pid", "1d10t", "m0r0n!", "i.d.i.o.t", "STUP1D", "wrothless", "loooser", "ｔｒａｓｈ", "class act", "étude", "lesser", "", "s t u p i d me", "ST-UP-ID", "bithc b***h id**t stpd SUTPID k.y.s iḋiot st​upid", "wore a shirt, count shot",
    "abc!stpid", "idíot", "ab\ncd STUPID stu pid.", "%%!", "word***", None, "İdiot", "a$$hole a$hole", "ＩＤＩＯＴ", "аsshole mоron", "m_o_r_o_n m__n mo#on", "you st*pid", "iidiioott IDI0T", "stupid. idiot! worth less", "ASSHOLE asshole", "x" * 300 + " m0ron", "\t\nst*pid\n",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 5 else None, x, "c") for i, x in enumerate(TEXTS)], "doc_id long, text string, token string")


def test_texts(docs):
    got = r.normalised(docs).collect()
    want = [None if x is None else n.normalised(x) for x in TEXTS]
    assert sorted((x.text for x in got), key=repr) == sorted(want, key=repr) and docs.columns == list(got[0].asDict())
    assert {x.doc_id: x.text for x in got if x.doc_id is not None} == {i: w for i, w in enumerate(want) if i != 5}


def test_empty(docs):
    assert r.normalised(docs.limit(0)).count() == 0 and r.dictionary(docs.limit(0)).count() == 0


def test_dictionary(docs):
    """On runs by themselves the joins and the function agree."""
    got = r.dictionary(docs.where("text is not null")).collect()
    assert len(got) > 40 and all(x.recovered == n._typed(n.revealed(x.token)) for x in got)
    assert {x.token: x.n for x in got}["STUPID"] == 1 and {x.token: x.recovered for x in got}["STUP1D"] == "STUPID"


def test_query_equals_normalize_text(spark):
    sf = "/root/testdata/sf0.001"
    joined, plain = ({x.doc_id: x.text for x in QUERIES[q](spark, sf).collect()} for q in ("recovered_texts", "normalize_text"))
    assert joined == plain and any(QUERIES["recovered_tokens"](spark, sf).where("token <> recovered").take(1))


def test_index(spark):
    index = {(x.variant, x.word, x.words) for x in r.spellings(spark).collect()}
    assert index == {(x, w, len(ws)) for x, ws in n.recovery().items() for w in ws}


ODD = [
    "f00lish 455 2023 4b5c snake_case_name **bold** #tag id10t's m0r0n2 stp1d́", "stpid́ ídiot 가idiot іdiot", "aassshole stuppid stuupid beteer hateful", "a!stpid_ $tpid 5tupid! moron_", "sstupid STUPPID sTuPpId",
    "dragged " + "i" * 40 + "diot " + "s" * 5 + "tupid", "worthles wrothles loooooser l o s e r", "id_ot mo#on m**n tr_sh tra$h 7rash",
]


def test_texts_are_read_twice(spark):
    """Once to find what may change and once to give all texts back, however many steps there are."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    d = spark.createDataFrame([(i, x) for i, x in enumerate([*TEXTS, *ODD])], "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    got = {x.doc_id: x.text for x in r.normalised(d).collect()}
    assert got == {i: None if x is None else n.normalised(x) for i, x in enumerate([*TEXTS, *ODD])}
    assert read.value <= 2 * len(got)


def test_only_what_changes_goes_on(spark):
    """Of slips, masks and look-alikes of all harsh words no changed token is left out, and plain words and numbers go no further."""
    words = {x for w in n.harsh_words() for x in (w.upper(), w[0] + "*" + w[2:], w[:2] + "_" + w[3:], w[0] + w, w[:-1] + w[-1] * 3, w.replace("a", "4").replace("i", "!"), w.replace("e", "é"), w.replace("o", "о"), *n.variants(w))}
    moved = {w for w in words if n.DISGUISED.fullmatch(w) and (n.revealed(w) != w or n._typed(w) != w)}
    assert len(moved) > 800
    d = spark.createDataFrame([(" ".join(sorted(words)),), ("as stupid Stupid people in 1924 w0rk for snake_case words, cafés and 3 others!",)], "text string")
    runs = [set(x.runs) for x in d.select(r.may_change(r.F.col("text")).alias("runs")).collect()]
    assert moved <= runs[0] and not runs[1]
