"""Corpus, model, scoring and evaluation queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT as C
from ..functions import text as t
from ..functions import vocab as v
from ..operators import evaluation as e
from ..operators import scoring as s
from ..storage import spread, stored
from . import sql as q

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, for functions that cost more than reading them."""
    return spread(table(spark, sf, "documents"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    d, la = documents(spark, sf), table(spark, sf, "labels")
    return d.where("text is not null").join(la.select("doc_id", F.col("toxic").alias("label")), "doc_id").select("doc_id", "text", "lang", "source", "label")


def split(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus with is_test. Ids and labels alone are ranked, and what comes of it is stored, so that texts take part in no ranking."""
    d = corpus(spark, sf)
    flags = stored(s.stratified_split(d.select("doc_id", "label")).groupBy("doc_id").agg(F.max("is_test").alias("is_test")), "split")
    return d.join(flags, "doc_id")


def live_model(spark: SparkSession, sf: str) -> DataFrame:
    """Naive Bayes of live tokens, negated ones and cues included, from the training rows. Up to a million tokens, some hundred MB, it is broadcast, so that texts' tokens aren't shuffled to it."""
    model = stored(s.train_nb(split(spark, sf).where("not is_test"), t.live_tokens(F.col("text"))), "model")
    return F.broadcast(model) if model.count() <= 1_000_000 else model


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """The test rows with label, lang, source, matched, nb, compound, lex, hybrid, english and distress. The model is stored; the texts of test rows are read once, for both scorers and the policy."""
    d = split(spark, sf)
    model = stored(s.train_nb(d.where("not is_test")), "model")
    test = s.score_lexicon(d.where("is_test")).withColumns({"english": t.looks_english(F.col("text")), "distress": t.self_distress(F.col("text"))})
    found = s.score_nb(test, model, keep=("label", "lang", "source", "compound", "lex", "english", "distress"))
    return found.withColumn("hybrid", s.blended(F.col("nb"), F.col("lex")))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return e.melted(scored(spark, sf)).withColumn("p", (F.round("score", 9) >= C.threshold).cast("int"))


@query("SELECT doc_id, greatest(toxic, 1 - quality) AS label FROM labels")
def label_any_flag(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.greatest("toxic", 1 - F.col("quality")).alias("label"))


@query("SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def clean_corpus(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"))
    return d.where("text is not null and text <> ''")


@query("SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic")
def class_counts(spark, sf):
    return table(spark, sf, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT toxic AS label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY toxic")
def class_share(spark, sf):
    return class_counts(spark, sf).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query(f"WITH {q.CORPUS}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, sum(label) OVER () AS pos FROM corpus) SELECT doc_id, label FROM r WHERE label = 1 OR rn <= {C.negatives_per_positive} * pos")
def balanced_sample(spark, sf):
    return s.balanced(corpus(spark, sf).select("doc_id", "label"))


@query(f"WITH {q.SPLIT} SELECT doc_id, label, is_test FROM split")
def stratified_split(spark, sf):
    return s.stratified_split(corpus(spark, sf).select("doc_id", "label"))


@query(f"WITH {q.CORPUS}, k AS (SELECT label, unnest({q.content('text')}) AS token FROM corpus) SELECT label, token, count(*) AS n FROM k GROUP BY ALL")
def token_counts(spark, sf):
    return s.token_counts(corpus(spark, sf))


@query(f"WITH {q.CORPUS}, k AS (SELECT unnest({q.content('text')}) AS token FROM corpus) SELECT count(DISTINCT token) AS vocab_size FROM k")
def vocab_size(spark, sf):
    return s.token_counts(corpus(spark, sf)).select("token").distinct().agg(F.count("*").alias("vocab_size"))


@query(f"WITH {q.MODEL} SELECT token, c0, c1, round(ll0, 6) AS ll0, round(ll1, 6) AS ll1, round(prior0, 6) AS prior0, round(prior1, 6) AS prior1 FROM model")
def nb_model(spark, sf):
    m = s.train_nb(split(spark, sf).where("not is_test"))
    return m.select("token", "c0", "c1", *[F.round(c, 6).alias(c) for c in ("ll0", "ll1", "prior0", "prior1")])


@query(f"WITH {q.SCORES} SELECT doc_id, matched, round(nb, 6) AS nb FROM nbs")
def nb_scores(spark, sf):
    d = split(spark, sf)
    return s.score_nb(d.where("is_test"), s.train_nb(d.where("not is_test"))).withColumn("nb", F.round("nb", 6))


@query(f"WITH {q.SCORES} SELECT doc_id, CASE WHEN round(nb, 9) >= 0.5 THEN 1 ELSE 0 END AS predicted, CASE WHEN round(nb, 9) >= 0.5 THEN 'aggressive' ELSE 'safe' END AS class FROM nbs")
def nb_predictions(spark, sf):
    d = split(spark, sf)
    p = s.score_nb(d.where("is_test"), s.train_nb(d.where("not is_test"))).withColumn("predicted", s.predicted(F.round("nb", 9)))
    return p.select("doc_id", "predicted", F.when(F.col("predicted") == 1, "aggressive").otherwise("safe").alias("class"))


LIVE = f"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z{v.BLANKS}]', '', 'g'), '[{v.BLANKS}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words),
n AS (SELECT *, list_contains({q.lst(v.NB_NEGATORS)}, w) AS neg FROM u),
o AS (SELECT *, sum(CASE WHEN neg THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM n),
a AS (SELECT *, max(CASE WHEN neg THEN ord END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM o),
plain AS (SELECT doc_id, pos, CASE WHEN since IS NOT NULL AND ord - since <= {C.negation_window} THEN 'not_' || w ELSE w END AS token FROM a WHERE NOT neg AND length(w) > 1 AND NOT list_contains({q.lst([w for w in v.STOP_WORDS if w not in ("not", "no")])}, w)),
mk AS (SELECT doc_id, {q.markers("text")} AS ms FROM documents WHERE text IS NOT NULL),
cues AS (SELECT doc_id, 1000000000 + generate_subscripts(ms, 1) AS pos, 'cue_' || replace(unnest(ms), ' ', '_') AS token FROM mk),
live AS (SELECT * FROM plain UNION ALL SELECT * FROM cues)"""


@query(
    f"""WITH {LIVE} SELECT d.doc_id, count(token) AS n_tokens, count(*) FILTER (starts_with(token, 'not_')) AS n_negated, md5(coalesce(string_agg(token, ' ' ORDER BY pos), '')) AS tokens_md5
FROM documents d LEFT JOIN live ON live.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id"""
)
def nb_runtime_tokens(spark, sf):
    d = documents(spark, sf).where("text is not null").select("doc_id", t.live_tokens(F.col("text")).alias("ts"))
    negated = F.size(F.filter("ts", lambda x: F.startswith(x, F.lit("not_")))).cast("long")
    return d.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), negated.alias("n_negated"), F.md5(F.array_join("ts", " ")).alias("tokens_md5"))


_DAMP = f"CASE WHEN starts_with(token, 'not_') THEN (ll0 + ll1) / 2 + {{sign}} {C.nb_negation_kept}::DOUBLE * (ll1 - ll0) / 2 ELSE {{own}} END"
DAMPENED = f"""{q.SPLIT}, {LIVE},
ltoks AS (SELECT s.label, l.token FROM live l JOIN split s ON s.doc_id = l.doc_id WHERE NOT s.is_test),
lcnt AS (SELECT token, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM ltoks GROUP BY token),
ltot AS (SELECT sum(c0) AS t0, sum(c1) AS t1, count(*) AS v FROM lcnt),
lmodel AS (SELECT token, c0, c1, t0, t1, v, ln((c0 + 1)::DOUBLE / (t0 + v)::DOUBLE) AS ll0, ln((c1 + 1)::DOUBLE / (t1 + v)::DOUBLE) AS ll1 FROM lcnt, ltot),
lprior AS (SELECT ln((count(*) FILTER (label = 0))::DOUBLE / count(*)::DOUBLE) AS prior0, ln((count(*) FILTER (label = 1))::DOUBLE / count(*)::DOUBLE) AS prior1 FROM split WHERE NOT is_test)"""


@query(
    f"""WITH {DAMPENED},
rawl AS (SELECT doc_id, {q.WORDS.format("text")} AS rw FROM documents WHERE text IS NOT NULL),
rawu AS (SELECT doc_id, unnest(rw) AS w, generate_subscripts(rw, 1) AS pos FROM rawl),
nxt AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nw FROM rawu),
sw AS (SELECT doc_id, arg_min(w, pos) AS swear FROM nxt WHERE list_contains({q.lst(v.SWEARS)}, w) AND list_contains({q.lst(t.praise())}, nw) GROUP BY doc_id),
lk AS (SELECT l.doc_id, l.token FROM live l LEFT JOIN sw ON sw.doc_id = l.doc_id WHERE NOT list_contains({q.lst(v.CASUAL)}, l.token) AND NOT coalesce(l.token = sw.swear, false)),
jj AS (SELECT d.doc_id, m.* FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN lk ON lk.doc_id = d.doc_id LEFT JOIN lmodel m ON m.token = lk.token),
ja AS (SELECT doc_id, count(ll0) AS matched, coalesce(sum({_DAMP.format(sign="-", own="ll0")}), 0) AS s0, coalesce(sum({_DAMP.format(sign="+", own="ll1")}), 0) AS s1 FROM jj GROUP BY doc_id)
SELECT doc_id, matched, round(1 / (1 + exp(least((s0 + prior0) - (s1 + prior1), 700))), 4) AS nb FROM ja, lprior"""
)
def nb_dampened_scores(spark, sf):
    return s.dampened_nb(documents(spark, sf).where("text is not null"), live_model(spark, sf))


@query(f"WITH src AS (SELECT doc_id, text AS txt FROM documents WHERE text IS NOT NULL), {q.hits('src')} SELECT doc_id, pos, word, round(base, 6) AS base, round(valence, 6) AS valence FROM hit")
def lexicon_hits(spark, sf):
    d = s.with_hits(documents(spark, sf).where("text is not null").select("doc_id", "text"), "text")
    h = d.select("doc_id", F.explode_outer("_hits").alias("h")).where("h is not null").select("doc_id", "h.*")  # explode() would have its size test pushed down, expressions and all
    return h.select("doc_id", F.col("pos").cast("long").alias("pos"), "word", F.round("base", 6).alias("base"), F.round("valence", 6).alias("valence"))


@query(f"WITH src AS (SELECT doc_id, text AS raw FROM documents WHERE text IS NOT NULL), {q.lexicon('src', v.whole_lexicon())} SELECT doc_id, comp AS compound, lex FROM lexs")
def lexicon_scores(spark, sf):
    """Scores by all terms that the default lexicon ever had."""
    return s.score_lexicon(documents(spark, sf).where("text is not null").select("doc_id", "text"), lexicon=v.whole_lexicon()).select("doc_id", "compound", "lex")


@query(f"SELECT conv_id, turn, least(len({q.markers('text')}) * 0.5::DOUBLE, 1::DOUBLE) AS cue, array_to_string({q.markers('text')}, '|') AS markers FROM conversations")
def sarcasm_cues(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", t.sarcasm_cue(F.col("text")).alias("cue"), F.array_join(t.sarcasm_markers(F.col("text")), "|").alias("markers"))


@query(f"SELECT conv_id, turn, {q.clause('text')} AS clause FROM conversations")
def clause_override(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", t.direct_insult_clause(F.col("text")).alias("clause"))


@query(f"WITH {q.HYBRID} SELECT doc_id, round(nb, 6) AS nb, lex, round(hybrid, 6) AS hybrid, round(CASE WHEN h2 >= 0.5 AND NOT {q.english('text')} THEN 0::DOUBLE WHEN h2 >= 0.5 AND {q.distress('text')} THEN h2 * {C.distress_factor}::DOUBLE ELSE h2 END, 6) AS decided FROM (SELECT *, CASE WHEN matched = 0 THEN lex ELSE round(hybrid, 9) END AS h2 FROM hyb)")
def hybrid_scores(spark, sf):
    d = scored(spark, sf).withColumn("h2", F.when(F.col("matched") == 0, F.col("lex")).otherwise(F.round("hybrid", 9)))
    return d.select("doc_id", F.round("nb", 6).alias("nb"), "lex", F.round("hybrid", 6).alias("hybrid"), F.round(s.guarded(F.col("h2"), F.lit(""), english=F.col("english"), distress=F.col("distress")), 6).alias("decided"))


@query(
    f"""WITH {q.HYBRID} SELECT row_number() OVER (ORDER BY doc_id) AS sample_id, doc_id, label, CASE WHEN label = 1 THEN 'aggressive' ELSE 'safe' END AS actual_class,
round(nb, 6) AS nb, CASE WHEN round(nb, 9) >= 0.5 THEN 1 ELSE 0 END AS nb_predicted, comp AS compound, lex, CASE WHEN lex >= 0.5 THEN 1 ELSE 0 END AS lex_predicted, round(hybrid, 6) AS hybrid, CASE WHEN round(hybrid, 9) >= 0.5 THEN 1 ELSE 0 END AS hybrid_predicted FROM hyb"""
)
def prediction_table(spark, sf):
    d = scored(spark, sf)
    name = F.when(F.col("label") == 1, "aggressive").otherwise("safe")
    number = s.numbered(split(spark, sf).where("is_test").select("doc_id"), "doc_id", "sample_id")
    scores = d.select(
        "doc_id",
        "label",
        name.alias("actual_class"),
        F.round("nb", 6).alias("nb"),
        s.predicted(F.round("nb", 9)).alias("nb_predicted"),
        "compound",
        "lex",
        s.predicted(F.col("lex")).alias("lex_predicted"),
        F.round("hybrid", 6).alias("hybrid"),
        s.predicted(F.round("hybrid", 9)).alias("hybrid_predicted"),
    )
    return number.join(scores, "doc_id").select("sample_id", *scores.columns)


@query(f"WITH {q.MELT} SELECT model, label, p AS predicted, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY model, label), 6) AS share FROM pred GROUP BY model, label, p")
def confusion(spark, sf):
    c = predictions(spark, sf).groupBy("model", "label", F.col("p").alias("predicted")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("model", "label")), 6))


@query(f"WITH {q.MELT}, c AS (SELECT model, {q.COUNTS} FROM pred GROUP BY model) SELECT model, tn, fp, fn, tp, {q.metrics()} FROM c")
def metrics(spark, sf):
    return e.with_metrics(predictions(spark, sf).groupBy("model").agg(*e.counts("label", F.col("p"))))


_REPORT = "per AS (SELECT k AS class, count(*) FILTER (label = k AND p = k) AS tp, count(*) FILTER (label <> k AND p = k) AS fp, count(*) FILTER (label = k AND p <> k) AS fn FROM pred, (SELECT unnest([0, 1]) AS k) WHERE model = 'hybrid' GROUP BY k), m AS (SELECT CAST(class AS VARCHAR) AS class, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM per), a AS (SELECT * FROM m UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM m UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM m)"


@query(f"WITH {q.MELT}, {_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM a")
def classification_report(spark, sf):
    return e.class_report(predictions(spark, sf).where("model = 'hybrid'").withColumnRenamed("p", "predicted"))


_SWEEP = f"{q.HYBRID}, st AS (SELECT hyb.*, k FROM hyb, (SELECT unnest(range(21)) AS k)), pp AS (SELECT k, label, CASE WHEN round((k::DOUBLE / 20) * nb + (1 - k::DOUBLE / 20) * lex, 9) >= 0.5 THEN 1 ELSE 0 END AS p FROM st), c AS (SELECT k, {q.COUNTS} FROM pp GROUP BY k), sw AS (SELECT tn, fp, fn, tp, {q.metrics()}, round(k::DOUBLE / 20, 2) AS nb_weight FROM c)"


@query(f"WITH {_SWEEP} SELECT * FROM sw")
def weight_sweep(spark, sf):
    return e.sweep(scored(spark, sf))


@query(f"WITH {_SWEEP} SELECT row_number() OVER (ORDER BY f1 DESC, precision DESC, recall DESC, nb_weight) AS rank, nb_weight, round(1 - nb_weight, 2) AS lexicon_weight, precision, recall, f1, CAST(CAST(round(nb_weight * 100) AS INT) AS VARCHAR) || '/' || CAST(CAST(round(100 - nb_weight * 100) AS INT) AS VARCHAR) AS split FROM sw")
def weight_ranking(spark, sf):
    pct = F.round(F.col("nb_weight") * 100).cast("int")
    return e.ranked(e.sweep(scored(spark, sf))).select(F.col("rank").cast("long"), "nb_weight", F.round(1 - F.col("nb_weight"), 2).alias("lexicon_weight"), "precision", "recall", "f1", F.concat_ws("/", pct.cast("string"), (100 - pct).cast("string")).alias("split"))


_RANKS = ", ".join(f"rank() OVER (ORDER BY {m} DESC) AS {m}_rank, row_number() OVER (ORDER BY {m} DESC, nb_weight) AS {m}_place" for m in ("precision", "recall", "f1"))


@query(f"WITH {_SWEEP} SELECT nb_weight, {_RANKS} FROM sw")
def weight_ranks_min(spark, sf):
    d = e.sweep(scored(spark, sf))
    r = [x for m in ("precision", "recall", "f1") for x in (F.rank().over(W.orderBy(F.desc(m))).cast("long").alias(f"{m}_rank"), F.row_number().over(W.orderBy(F.desc(m), "nb_weight")).cast("long").alias(f"{m}_place"))]
    return d.select("nb_weight", *r)


@query(f"WITH {_SWEEP} SELECT arg_max(nb_weight, f1 * 1000 - nb_weight / 1000) AS best_weight, max(f1) AS best_f1, max(CASE WHEN abs(nb_weight - 0.6) < 1e-8 THEN f1 END) AS used_f1 FROM sw")
def best_weight(spark, sf):
    d = e.sweep(scored(spark, sf))
    return d.agg(F.max_by("nb_weight", F.col("f1") * 1000 - F.col("nb_weight") / 1000).alias("best_weight"), F.max("f1").alias("best_f1"), F.max(F.when(F.abs(F.col("nb_weight") - 0.6) < 1e-8, F.col("f1"))).alias("used_f1"))


@query(f"WITH {q.MELT}, c AS (SELECT model, lang, {q.COUNTS} FROM pred GROUP BY GROUPING SETS ((model), (model, lang))) SELECT model, coalesce(lang, 'all') AS lang, tn, fp, fn, tp, round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS false_positive_rate, {q.metrics()} FROM c")
def eval_by_category_mode(spark, sf):
    g = predictions(spark, sf).groupingSets([["model"], ["model", "lang"]], "model", "lang").agg(*e.counts("label", F.col("p")))
    g = e.with_metrics(g).withColumn("false_positive_rate", F.round(F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double")), 6))
    return g.withColumn("lang", F.coalesce("lang", F.lit("all")))


@query(f"SELECT doc_id, {q.first_words('text')} AS text FROM documents WHERE text IS NOT NULL")
def truncate_128(spark, sf):
    return documents(spark, sf).where("text is not null").select("doc_id", t.first_words(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {q.english('text')} AS english FROM documents WHERE text IS NOT NULL")
def english_guard(spark, sf):
    return documents(spark, sf).where("text is not null").select("doc_id", t.looks_english(F.col("text")).alias("english"))


@query(f"SELECT conv_id, turn, {q.distress('text')} AS distress FROM conversations WHERE text IS NOT NULL")
def distress_guard(spark, sf):
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", t.self_distress(F.col("text")).alias("distress"))


@query(f"SELECT doc_id FROM documents WHERE {q.listed('text', v.BLOCKLIST)}")
def blocklist_hits(spark, sf):
    return table(spark, sf, "documents").where(s.listed(F.col("text"), v.BLOCKLIST)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {q.listed('text', v.WHITELIST)} AND NOT {q.listed('text', v.BLOCKLIST)}")
def whitelist_exempt(spark, sf):
    return table(spark, sf, "documents").where(s.listed(F.col("text"), v.WHITELIST) & ~s.listed(F.col("text"), v.BLOCKLIST)).select("doc_id")


@query(
    f"""WITH cut AS (SELECT doc_id, text, {q.first_words("text")} AS raw FROM documents WHERE text IS NOT NULL), {q.lexicon("cut")}
SELECT c.doc_id, CASE WHEN {q.listed("c.text", v.BLOCKLIST)} THEN 'blocked' WHEN {q.listed("c.text", v.WHITELIST)} THEN 'exempt' WHEN l.lex >= 0.5 THEN 'aggressive' ELSE 'safe' END AS verdict, CASE WHEN {q.listed("c.text", v.BLOCKLIST)} THEN 1::DOUBLE WHEN {q.listed("c.text", v.WHITELIST)} THEN NULL ELSE l.lex END AS score FROM cut c JOIN lexs l ON l.doc_id = c.doc_id"""
)
def verdict_precedence(spark, sf):
    d = documents(spark, sf).where("text is not null").select("doc_id", "text", t.first_words(F.col("text")).alias("cut"))
    d = s.score_lexicon(d, "cut").withColumn("verdict", s.verdict(F.col("text"), F.col("lex"), v.BLOCKLIST, v.WHITELIST))
    return d.select("doc_id", "verdict", F.when(F.col("verdict") == "blocked", 1.0).when(F.col("verdict") != "exempt", F.col("lex")).alias("score"))
