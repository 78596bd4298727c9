"""Queries on log reports, anomalies, formats and highlights, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT as C
from ..functions import render as r
from ..functions import text as t
from ..functions import vocab as v
from ..operators import explain, pages, report
from ..operators import scoring as s
from . import sql as q
from .detection import DAMPENED, documents, live_model, split, table
from .serving import FOUND, HOST, found

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LOG = f"{FOUND}, lg AS (SELECT conv_id, turn, text, round(score, 3) AS score, flagged FROM found)"


def log(spark, sf):
    return found(spark, sf).withColumn("score", F.round("score", 3))


@query(f"WITH {LOG} SELECT conv_id, turn, score, CASE WHEN flagged = 1 OR score >= {C.threshold} THEN 'blocked' ELSE 'safe' END AS shown FROM lg")
def log_filter(spark, sf):
    d = log(spark, sf)
    return d.select("conv_id", "turn", "score", F.when(report.shown_as_blocked(F.col("flagged"), F.col("score")), "blocked").otherwise("safe").alias("shown"))


@query(
    f"""WITH {LOG} SELECT conv_id, turn, lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS VARCHAR), 3, '0') AS number, CASE WHEN flagged = 1 THEN 'BLOCKED' ELSE 'SAFE' END AS verdict,
printf('%.1f%%', round(score * 100, 1)) AS percentage, 'LEXICON' AS mode FROM lg"""
)
def log_report(spark, sf):
    d = log(spark, sf).withColumn("mode", F.lit("lexicon"))
    return report.report_rows(d, "conv_id", "turn").drop("text")


@query("SELECT l_orderkey, min(l_returnflag) AS first, max(l_returnflag) AS last, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def unequal_groups(spark, sf):
    return report.unequal(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return report.duplicated(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def unknown_ids(spark, sf):
    return report.unknown(table(spark, sf, "events"), "user_id", table(spark, sf, "supplier"), "s_suppkey")


_RAW = "CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Passed' ELSE lower('Passed') END"


@query(f"SELECT status, replaced, count(*) AS n FROM (SELECT CASE WHEN x IN ('Passed', 'Failed', 'Not Tested') THEN x ELSE 'Not Tested' END AS status, x NOT IN ('Passed', 'Failed', 'Not Tested') AS replaced FROM (SELECT {_RAW} AS x FROM orders)) GROUP BY ALL")
def status_anomalies(spark, sf):
    status, replaced = report.status_of(F.expr(_RAW))
    return table(spark, sf, "orders").select(status.alias("status"), replaced.alias("replaced")).groupBy("status", "replaced").agg(F.count("*").alias("n"))


@query(
    "SELECT o_orderstatus AS status, format('{:,}', count(*)) AS n, printf('%.1f%%', round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 1)) AS share, CASE WHEN length(CAST(count(*) AS VARCHAR)) >= 6 THEN CAST(count(*) AS VARCHAR) ELSE lpad(CAST(count(*) AS VARCHAR), 6, '0') END AS number FROM orders GROUP BY o_orderstatus"
)
def formatted_counts(spark, sf):
    o = table(spark, sf, "orders")
    total = o.agg(F.count("*").alias("total"))
    d = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("c")).crossJoin(F.broadcast(total))  # one row
    return d.select("status", r.with_commas(F.col("c")).alias("n"), r.percent(F.col("c") / F.col("total")).alias("share"), r.padded(F.col("c"), 6).alias("number"))


_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"SELECT page_id, md5({_ESC.format('html')}) AS html_md5, md5(replace({_ESC.format('html')}, '''', '&apos;')) AS xml_md5 FROM pages WHERE html IS NOT NULL")
def escaped_pages(spark, sf):
    d = table(spark, sf, "pages").where("html is not null")
    return d.select("page_id", F.md5(r.escaped(F.col("html"))).alias("html_md5"), F.md5(r.escaped(F.col("html"), apostrophe="&apos;")).alias("xml_md5"))


PATTERNS = ["*://*.example.com/*", "*://example.org/*", "*://*.net/*", "*://site1.*.com/*"]


@query(f"SELECT page_id, array_to_string(list_filter({q.lst(PATTERNS)}, lambda p: regexp_matches(h, CASE p " + " ".join(f"WHEN '{p}' THEN '{r.host_pattern(p)}'" for p in PATTERNS) + f" END)), ',') AS patterns FROM (SELECT page_id, {HOST} AS h FROM pages)")
def host_patterns(spark, sf):
    h = pages.host_of(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_compact(F.array(*[F.when(h.rlike(r.host_pattern(p)), p) for p in PATTERNS])), ",").alias("patterns"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(floor(extract('millisecond' FROM ts))::INT % 1000 AS VARCHAR), 3, '0') || 'Z' AS at, 'log-' || strftime(ts, '%Y-%m-%d-%H-%M') || '.txt' AS file FROM events")
def event_times(spark, sf):
    return table(spark, sf, "events").select("event_id", r.iso_time(F.col("ts")).alias("at"), F.concat(F.lit("log-"), r.file_stamp(F.col("ts")), F.lit(".txt")).alias("file"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event\":{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"},\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS packed FROM events")
def nested_json(spark, sf):
    d = table(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return d.select("event_id", "k", F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")).alias("event"), "k")).alias("packed"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IS NOT NULL ORDER BY doc_id LIMIT 5")
def preview(spark, sf):
    return table(spark, sf, "documents").where("doc_id is not null").orderBy("doc_id").select("doc_id", "lang", "source").limit(5)


@query("SELECT conv_id, turn, CAST(ceil(row_number() OVER (PARTITION BY conv_id ORDER BY turn)::DOUBLE / 5) AS BIGINT) AS batch FROM conversations")
def scan_batches(spark, sf):
    return report.in_batches(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query(f"WITH {q.MODEL} SELECT token, c0 AS raw0, c1 AS raw1 FROM model")
def raw_counts(spark, sf):
    return report.raw_counts(s.train_nb(split(spark, sf).where("not is_test")))


@query("SELECT event_type, event_id, age FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 50")
def diagnostics_last50(spark, sf):
    d = report.last_of(table(spark, sf, "events").select("event_type", "event_id", "ts"), "event_type", [F.desc("ts"), F.desc("event_id")], 50)
    return d.select("event_type", "event_id", F.col("age").cast("long").alias("age"))


@query("SELECT user_id AS \"key\", arg_max(event_type, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def latest_settings(spark, sf):
    d = table(spark, sf, "events")
    value = F.when(F.col("event_type") != "error", F.col("event_type"))
    return report.latest_settings(d.select(F.col("user_id").alias("key"), value.alias("value"), F.col("event_id").alias("seq")))


_SAVED = "CASE event_type WHEN 'view' THEN 'hybrid' WHEN 'click' THEN 'nb' WHEN 'purchase' THEN 'lexicon' WHEN 'signup' THEN 'vote' END"


@query(f"SELECT saved, expert, CASE WHEN expert AND saved IN ('hybrid', 'nb', 'lexicon') THEN saved ELSE 'hybrid' END AS mode, count(*) AS n FROM (SELECT {_SAVED} AS saved, event_id % 2 = 0 AS expert FROM events) GROUP BY ALL")
def resolved_modes(spark, sf):
    """The mode that each event's saved one comes to, every second user in the expert view."""
    d = table(spark, sf, "events").select(F.expr(_SAVED).alias("saved"), (F.col("event_id") % 2 == 0).alias("expert"))
    return d.groupBy("saved", "expert", report.resolved_mode(F.col("saved"), F.col("expert")).alias("mode")).agg(F.count("*").alias("n"))


@query(f"WITH {q.CORPUS}, k AS (SELECT DISTINCT unnest({q.WORDS.format('text')}) AS word FROM corpus), p AS (SELECT word, {q.case_map(v.LEXICON, 'word')} AS valence FROM k) SELECT word, valence > 0 AS positive FROM p WHERE valence IS NOT NULL")
def word_polarity(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id").where("text is not null")
    words = d.select(F.explode(F.array_distinct(t.letter_words(F.col("text")))).alias("word")).where(F.col("word").isin(list(v.LEXICON))).distinct()
    return words.select("word", F.col("word").isin(t.praise()).alias("positive"))


_GROUPS = "gr AS (SELECT item_id % 4 AS kind, list(text ORDER BY item_id) AS texts FROM benchmark WHERE text IS NOT NULL GROUP BY item_id % 4)"


@query(
    f"""WITH {_GROUPS}, flat AS (SELECT kind, generate_subscripts(texts, 1) AS place, unnest(texts) AS text FROM gr)
SELECT CAST(kind AS VARCHAR) AS kind, CAST(place AS BIGINT) AS place, text FROM flat
UNION ALL SELECT 'long', item_id, trim(repeat(regexp_extract(text, '[^ ]+( [^ ]+)?') || ' ', 60)) FROM benchmark WHERE item_id % 16 = 0 AND text IS NOT NULL"""
)
def fixture_cases(spark, sf):
    """Benchmark items in groups, laid flat again, and long texts made of the first two words of every sixteenth."""
    d = table(spark, sf, "benchmark").where("text is not null")
    groups = d.groupBy((F.col("item_id") % 4).cast("string").alias("kind")).agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("texts"))
    flat = groups.select("kind", F.posexplode("texts").alias("place", "x")).select("kind", (F.col("place") + 1).cast("long").alias("place"), "x.text")
    phrase = F.regexp_extract("text", "[^ ]+( [^ ]+)?", 0)
    long = d.where("item_id % 16 = 0").select(F.lit("long").alias("kind"), "item_id", F.trim(F.repeat(F.concat(phrase, F.lit(" ")), F.lit(60))).alias("text"))
    return flat.union(long)


_FW = q.lst(v.FUNCTION_WORDS)
_HIGH = f"""{DAMPENED}, hsrc AS (SELECT doc_id, text AS txt FROM documents WHERE text IS NOT NULL), {q.hits("hsrc")},
rawl AS (SELECT doc_id, {q.WORDS.format("text")} AS rw FROM documents WHERE text IS NOT NULL),
rawu AS (SELECT doc_id, unnest(rw) AS w, generate_subscripts(rw, 1) AS pos FROM rawl),
nxt AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nw FROM rawu),
sw AS (SELECT doc_id, arg_min(w, pos) AS swear FROM nxt WHERE list_contains({q.lst(v.SWEARS)}, w) AND list_contains({q.lst(t.praise())}, nw) GROUP BY doc_id),
lk AS (SELECT DISTINCT l.doc_id, l.token FROM live l LEFT JOIN sw ON sw.doc_id = l.doc_id JOIN lmodel m ON m.token = l.token AND m.ll1 > m.ll0 WHERE NOT list_contains({q.lst(v.CASUAL)}, l.token) AND NOT coalesce(l.token = sw.swear, false) AND NOT starts_with(l.token, 'cue_')),
ps AS (SELECT doc_id, starts_with(token, 'not_') AS negated, regexp_replace(token, '^not_', '') AS word FROM lk),
pw AS (SELECT * FROM ps WHERE NOT list_contains({_FW}, word)),
hw AS (SELECT doc_id, word, valence, negated FROM hit WHERE NOT list_contains({_FW}, word)),
ng AS (SELECT doc_id, word FROM pw WHERE negated UNION SELECT doc_id, word FROM hw WHERE negated),
nbw AS (SELECT DISTINCT doc_id, word FROM pw WHERE NOT negated AND NOT list_contains({q.lst(t.praise())}, word)),
ot AS (SELECT DISTINCT doc_id, word FROM hw WHERE valence < 0 AND NOT EXISTS (SELECT 1 FROM ng WHERE ng.doc_id = hw.doc_id AND ng.word = hw.word) AND NOT EXISTS (SELECT 1 FROM nbw WHERE nbw.doc_id = hw.doc_id AND nbw.word = hw.word)),
tk0 AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z'']+') AS ts FROM documents WHERE text IS NOT NULL),
tk1 AS (SELECT doc_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS pos FROM tk0),
fl AS (SELECT DISTINCT a.doc_id, a.w AS word FROM tk1 a JOIN tk1 b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + {C.negation_window} JOIN ng ON ng.doc_id = a.doc_id AND ng.word = lower(b.w) WHERE list_contains({q.lst(v.NEGATION_TRIGGERS)}, lower(a.w))),
cu AS (SELECT doc_id, unnest(ms) AS word FROM mk)"""


@query(
    f"WITH {_HIGH} SELECT DISTINCT doc_id, kind, pattern FROM (SELECT doc_id, 'sarcasm' AS kind, word AS pattern FROM cu UNION ALL SELECT doc_id, 'negation', word FROM ng UNION ALL SELECT doc_id, 'negation', word FROM fl UNION ALL SELECT doc_id, 'nb', word FROM nbw UNION ALL SELECT doc_id, 'lexicon', word FROM ot)"
)
def highlight_entries(spark, sf):
    d = documents(spark, sf).where("text is not null").select("doc_id", "text")
    return report.highlights(d, live_model(spark, sf))


@query(f"WITH {_HIGH} SELECT doc_id, word AS trigger FROM fl")
def negation_triggers(spark, sf):
    d = documents(spark, sf).where("text is not null").select("doc_id", "text")
    return report.highlights(d, live_model(spark, sf), only_triggers=True)


_KEPT = f"""{DAMPENED},
rawl AS (SELECT doc_id, {q.WORDS.format("text")} AS rw FROM documents WHERE text IS NOT NULL),
rawu AS (SELECT doc_id, unnest(rw) AS w, generate_subscripts(rw, 1) AS pos FROM rawl),
nxt AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nw FROM rawu),
sw AS (SELECT doc_id, arg_min(w, pos) AS swear FROM nxt WHERE list_contains({q.lst(v.SWEARS)}, w) AND list_contains({q.lst(t.praise())}, nw) GROUP BY doc_id),
kp AS (SELECT l.doc_id, l.token, l.pos FROM live l LEFT JOIN sw ON sw.doc_id = l.doc_id WHERE NOT list_contains({q.lst(v.CASUAL)}, l.token) AND NOT coalesce(l.token = sw.swear, false)),
pu AS (SELECT kp.doc_id, kp.token, count(*) AS n, min(kp.pos) AS place, (any_value(m.ll1) - any_value(m.ll0)) * CASE WHEN starts_with(kp.token, 'not_') THEN {C.nb_negation_kept}::DOUBLE ELSE 1::DOUBLE END AS push FROM kp JOIN lmodel m ON m.token = kp.token GROUP BY kp.doc_id, kp.token)"""


def live_pushes(spark, sf):
    docs = documents(spark, sf).where("text is not null").select("doc_id", "text")
    return explain.pushes(docs, live_model(spark, sf), ["doc_id"])


@query(f"WITH {_KEPT}, rk AS (SELECT doc_id, token, round(push, 6) AS push, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(push), 9) DESC, place) AS rank FROM pu WHERE NOT list_contains({_FW}, regexp_replace(token, '^not_', ''))) SELECT * FROM rk WHERE rank <= 6")
def explain_live_top6(spark, sf):
    """The six live tokens of each text that push its score most, function words aside."""
    return explain.strongest(live_pushes(spark, sf), ["doc_id"]).withColumn("push", F.round("push", 6))


@query(f"WITH {_KEPT} SELECT doc_id, round(coalesce(sum(push * n) FILTER (push > 0), 0), 4) AS aggressive, round(coalesce(-sum(push * n) FILTER (push < 0), 0), 4) AS safe, CAST(sum(n) AS BIGINT) AS tokens FROM pu GROUP BY doc_id")
def push_totals(spark, sf):
    """How far all occurrences of each text's live tokens push its score to either class."""
    return explain.push_totals(live_pushes(spark, sf), ["doc_id"]).withColumns({c: F.round(c, 4) for c in ("aggressive", "safe")})


def _listed(pairs: list[tuple[str, str]], none: str) -> str:
    said = ", ".join(f"CASE WHEN {test} THEN '{words}' END" for test, words in pairs)
    return f"coalesce(nullif(array_to_string(list_filter([{said}], lambda x: x IS NOT NULL), ', '), ''), '{none}')"


_DAMP = f"CASE WHEN starts_with(kp.token, 'not_') THEN (ll0 + ll1) / 2 + {{sign}} {C.nb_negation_kept}::DOUBLE * (ll1 - ll0) / 2 ELSE {{own}} END"
_UP = _listed([("coalesce(negated_up, false)", v.REASONS[0]), ("coalesce(plain_up, false)", v.REASONS[1]), ("cue", v.REASONS[2]), ("comp < -0.3::DOUBLE", v.REASONS[3])], v.NO_REASON[0])
_DOWN = _listed([("coalesce(negated_down, false)", v.SAFE_REASONS[0]), ("NOT coalesce(any_up, false)", v.SAFE_REASONS[1]), ("NOT cue AND comp >= -0.3::DOUBLE", v.SAFE_REASONS[2])], v.NO_REASON[1])


@query(
    f"""WITH {_KEPT}, esrc AS (SELECT doc_id, text AS raw FROM documents WHERE text IS NOT NULL), {q.lexicon("esrc")},
sg AS (SELECT doc_id, bool_or(starts_with(token, 'not_') AND push > 0) AS negated_up, bool_or(starts_with(token, 'not_') AND push < 0) AS negated_down, bool_or(NOT starts_with(token, 'not_') AND NOT starts_with(token, 'cue_') AND push > 0) AS plain_up, bool_or(NOT starts_with(token, 'cue_') AND push > 0) AS any_up FROM pu GROUP BY doc_id),
ja AS (SELECT e.doc_id, count(m.ll0) AS matched, coalesce(sum({_DAMP.format(sign="-", own="ll0")}), 0) AS s0, coalesce(sum({_DAMP.format(sign="+", own="ll1")}), 0) AS s1 FROM esrc e LEFT JOIN kp ON kp.doc_id = e.doc_id LEFT JOIN lmodel m ON m.token = kp.token GROUP BY e.doc_id),
nb AS (SELECT doc_id, matched, round(1 / (1 + exp(least((s0 + prior0) - (s1 + prior1), 700))), 4) AS nb FROM ja, lprior),
sc AS (SELECT e.doc_id, e.raw, l.comp, len({q.markers("e.raw")}) > 0 AS cue, CASE WHEN nb.matched = 0 THEN l.lex ELSE round({C.nb_weight}::DOUBLE * nb.nb + {C.lexicon_weight}::DOUBLE * l.lex, 9) END AS h FROM esrc e JOIN lexs l ON l.doc_id = e.doc_id JOIN nb ON nb.doc_id = e.doc_id),
fl AS (SELECT *, CASE WHEN h >= 0.5 AND NOT {q.english("raw")} THEN 0::DOUBLE WHEN h >= 0.5 AND {q.distress("raw")} THEN h * {C.distress_factor}::DOUBLE ELSE h END >= {C.threshold} AS hit FROM sc)
SELECT fl.doc_id, CAST(hit AS INT) AS flagged, CASE WHEN hit THEN {_UP} ELSE {_DOWN} END AS reasons FROM fl LEFT JOIN sg ON sg.doc_id = fl.doc_id"""
)
def explain_reasons(spark, sf):
    docs = documents(spark, sf).where("text is not null").select("doc_id", "text")
    return explain.explained(docs, live_model(spark, sf), ["doc_id"])


@query(
    """WITH a AS (SELECT o_orderstatus AS dimension, o_custkey % 5 AS item, 5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS level FROM orders WHERE substr(o_orderpriority, 1, 1) < '5'),
i AS (SELECT dimension, item, count(*) AS n, floor(sum(level)::DOUBLE / count(*) * 100 + 0.5) / 100 AS mean FROM a GROUP BY ALL)
SELECT dimension, count(*) AS items, floor(round(avg(mean) * 100, 6) + 0.5) / 100 AS mean, count(DISTINCT n) = 1 AS same_n FROM i GROUP BY dimension"""
)
def likert_dimensions(spark, sf):
    d = table(spark, sf, "orders").withColumn("level", F.substring("o_orderpriority", 1, 1)).where("level < '5'")
    answers = d.select(F.col("o_orderstatus").alias("dimension"), (F.col("o_custkey") % 5).alias("item"), (5 - F.col("level").cast("int")).alias("level"))
    return report.dimension_means(answers)
