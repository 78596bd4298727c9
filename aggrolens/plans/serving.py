"""Queries on pages, logs, lists, explanations and reports, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT as C
from ..functions import normalise as n
from ..functions import text as t
from ..functions import vocab as v
from ..operators import lists, logs, nodes, pages
from ..operators import scoring as s
from ..sources import files
from ..streaming import changes, detect
from . import sql as q
from .detection import documents, split, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def normalize_text(spark, sf):
    d = documents(spark, sf).where("text is not null")
    return d.select("doc_id", n.normalise(F.col("text")).alias("text"))


@query()
def mask_segments(spark, sf):
    d = documents(spark, sf).where(s.listed(F.col("text"), v.BLOCKLIST) & s.listed(F.col("text"), v.WHITELIST))
    m = d.select("doc_id", n.mask_segments(F.col("text"), v.WHITELIST).alias("segments"))
    return m.withColumn("masked", F.array_join(F.transform("segments", lambda x: F.when(x["visible"], x["text"]).otherwise(F.regexp_replace(x["text"], r"\S", "*"))), "")).select("doc_id", "masked", F.size("segments").alias("n_segments"))


@query(
    f"""WITH {q.MODEL}, tk AS (SELECT DISTINCT doc_id, unnest({q.content("text")}) AS token FROM split WHERE is_test), p AS (SELECT tk.doc_id, tk.token, m.ll1 - m.ll0 AS push FROM tk JOIN model m ON m.token = tk.token),
r AS (SELECT doc_id, token, round(push, 6) AS push, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(push), 9) DESC, token) AS rank FROM p) SELECT * FROM r WHERE rank <= 6"""
)
def explain_nb_top6(spark, sf):
    d = split(spark, sf)
    m = s.train_nb(d.where("not is_test")).select("token", (F.col("ll1") - F.col("ll0")).alias("push"))
    tk = d.where("is_test").select("doc_id", F.explode(F.array_distinct(t.content_tokens(F.col("text")))).alias("token")).join(m, "token")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.round(F.abs("push"), 9)), "token"))
    return tk.withColumn("rank", rank.cast("long")).where("rank <= 6").select("doc_id", "token", F.round("push", 6).alias("push"), "rank")


@query()
def page_text_units(spark, sf):
    return pages.text_units(table(spark, sf, "pages"))


@query()
def page_ui_filtered(spark, sf):
    return pages.readable_units(pages.text_units(table(spark, sf, "pages")))


@query()
def page_captions(spark, sf):
    """Units after a time, by its kind, and what is read when captions are left out."""
    u = pages.with_time_kind(pages.text_units(table(spark, sf, "pages")))
    return pages.readable_units(u).groupBy("page_id", "time_kind").agg(F.count("*").alias("n"))


@query()
def page_caption_walk(spark, sf):
    """Each text that is shown and whether the nearest time in the tree before it tells a comment or a caption."""
    return nodes.with_time_before(nodes.nodes(table(spark, sf, "pages")))


@query()
def stream_subtree_scans(spark, sf):
    """Texts that a stream of the pages' change records makes scanned, each once."""
    return changes.scan_changes(table(spark, sf, "pages"))


HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '')"
PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
_STRICT = " OR ".join(["h = ''", *(f"h = '{x}' OR ends_with(h, '.{x}')" for x in v.PRIVATE_HOSTS), *(f"((h = '{x}' OR ends_with(h, '.{x}')) AND starts_with(lower(p), '{y}'))" for x, y in v.PRIVATE_PATHS)])
_LEGACY = " OR ".join([*(f"contains(h, '{x}')" for x in v.PRIVATE_HOSTS), *(f"(contains(h, '{x}') AND starts_with(p, '{y}'))" for x, y in v.PRIVATE_PATHS)])


@query(f"SELECT page_id, ({_STRICT}) AS private FROM (SELECT page_id, {HOST} AS h, {PATH} AS p FROM pages)")
def url_private_strict(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.private_strict(F.col("url")).alias("private"))


@query(f"SELECT page_id, ({_LEGACY}) AS private FROM (SELECT page_id, {HOST} AS h, {PATH} AS p FROM pages)")
def url_private_legacy(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.private_legacy(F.col("url")).alias("private"))


_PLATFORM = "CASE h " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in v.PLATFORMS.items()) + " ELSE h END"


@query(f"SELECT {_PLATFORM} AS platform, count(*) AS n FROM (SELECT {HOST} AS h FROM pages) GROUP BY ALL")
def url_platform(spark, sf):
    return table(spark, sf, "pages").groupBy(pages.platform(F.col("url")).alias("platform")).agg(F.count("*").alias("n"))


FOUND = f"""cs AS (SELECT conv_id * 1000000 + turn AS doc_id, conv_id, turn, text, {q.first_words("text")} AS raw FROM conversations WHERE text IS NOT NULL), {q.lexicon("cs")},
fd AS (SELECT c.conv_id, c.turn, c.text, CASE WHEN {q.listed("c.text", v.BLOCKLIST)} THEN 1::DOUBLE ELSE l.lex END AS score, CASE WHEN {q.listed("c.text", v.BLOCKLIST)} THEN 'blocked' WHEN {q.listed("c.text", v.WHITELIST)} THEN 'exempt' WHEN l.lex >= 0.5 THEN 'aggressive' ELSE 'safe' END AS verdict FROM cs c JOIN lexs l ON l.doc_id = c.doc_id),
found AS (SELECT *, CASE WHEN verdict IN ('blocked', 'aggressive') THEN 1 ELSE 0 END AS flagged FROM fd WHERE verdict <> 'exempt')"""


def found(spark, sf):
    return detect.detections(table(spark, sf, "conversations"))


@query(f"WITH {FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM found) SELECT conv_id, turn, substr(text, 1, {C.log_chars}) AS text, round(score, 3) AS score, flagged, age FROM r WHERE age <= {C.log_rows}")
def detection_log_last200(spark, sf):
    return logs.last_entries(found(spark, sf), "conv_id", "turn").select("conv_id", "turn", "text", "score", "flagged", F.col("age").cast("long"))


@query(f"WITH {FOUND} SELECT conv_id, turn, count(*) OVER w AS total, CAST(sum(flagged) OVER w AS BIGINT) AS aggressive, CAST(greatest(0, count(*) OVER w - sum(flagged) OVER w) AS BIGINT) AS safe FROM found WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, sf):
    return logs.running_totals(found(spark, sf), "conv_id", "turn").select("conv_id", "turn", "total", "aggressive", "safe")


@query(f"WITH {FOUND}, r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM found WHERE flagged = 1) SELECT conv_id, turn AS alert_at FROM r WHERE n = {C.alert_after}")
def page_alerts(spark, sf):
    return logs.page_alerts(found(spark, sf).withColumn("unit", F.col("turn")), "conv_id", "turn", "unit")


_COMPAT = "defs AS (SELECT r_name AS browser, r_regionkey AS r, n_nationkey AS test FROM region, nation WHERE n_nationkey < 12), seen AS (SELECT r_name AS browser, n_nationkey AS test, CASE WHEN (n_nationkey * 7 + r_regionkey) % 11 = 5 THEN 'Failed' ELSE 'Passed' END AS status FROM region JOIN nation ON (n_nationkey + r_regionkey) % 9 <> 3 OR r_regionkey = 2), m AS (SELECT d.browser, d.test, coalesce(s.status, 'Not Tested') AS status FROM defs d LEFT JOIN seen s ON s.browser = d.browser AND s.test = d.test)"


def _matrix(spark, sf):
    r, na = table(spark, sf, "region"), table(spark, sf, "nation")
    pairs = F.broadcast(r.select(F.col("r_name").alias("browser"), F.col("r_regionkey").alias("r"))).crossJoin(na.where("n_nationkey < 12").select(F.col("n_nationkey").alias("test")))  # five by twelve definitions
    status = F.when((F.col("test") * 7 + F.col("r")) % 11 == 5, "Failed").otherwise("Passed")
    seen = pairs.where("(test + r) % 9 <> 3 or r = 2").select("browser", "test", status.alias("status"))
    return pairs.join(seen, ["browser", "test"], "left").select("browser", "test", F.coalesce("status", F.lit("Not Tested")).alias("status"))


@query(f"WITH {_COMPAT} SELECT browser, test, status FROM m")
def compat_matrix(spark, sf):
    return _matrix(spark, sf)


@query(f"WITH {_COMPAT}, c AS (SELECT browser, count(*) FILTER (status = 'Passed') AS passed, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Not Tested') AS untested FROM m GROUP BY browser) SELECT *, CASE WHEN passed = 12 THEN 'Passed' WHEN failed > 0 THEN 'Failed' ELSE 'Not Tested' END AS overall FROM c")
def compat_summary(spark, sf):
    c = _matrix(spark, sf).groupBy("browser").agg(*[F.count_if(F.col("status") == x).alias(k) for k, x in (("passed", "Passed"), ("failed", "Failed"), ("untested", "Not Tested"))])
    return c.withColumn("overall", F.when(F.col("passed") == 12, "Passed").when(F.col("failed") > 0, "Failed").otherwise("Not Tested"))


@query("SELECT o_orderstatus AS item, count(*) AS n, floor(sum(5 - CAST(substr(o_orderpriority, 1, 1) AS INT))::DOUBLE / count(*) * 100 + 0.5) / 100 AS mean FROM orders WHERE substr(o_orderpriority, 1, 1) < '5' GROUP BY o_orderstatus")
def likert_means(spark, sf):
    d = table(spark, sf, "orders").withColumn("level", F.substring("o_orderpriority", 1, 1)).where("level < '5'")
    return d.groupBy(F.col("o_orderstatus").alias("item")).agg(F.count("*").alias("n"), (F.floor(F.sum(5 - F.col("level").cast("int")) / F.count("*") * 100 + 0.5) / 100).alias("mean"))


_PARTS = "p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS listed, list_distinct(string_split(lower(p_name), ' ')) AS names, list_distinct(string_split(lower(p_type), ' ')) AS types, lower(trim(string_split(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END, ' ')[1])) AS word FROM part)"


def _parts(spark, sf):
    """For each part the words of its name as a whitelist, those of its type as a blocklist, and a word to add, as a user may type it."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    of = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END")
    typed = F.concat(F.lit(" "), F.upper(F.get(F.split(of, " "), F.lit(0))), F.lit("  "))
    return table(spark, sf, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("listed"), words(F.col("p_name")).alias("names"), words(F.col("p_type")).alias("types"), typed.alias("typed"))


_JOINED = "array_to_string(list_sort({0}), ',')"


@query(
    f"""WITH {_PARTS} SELECT p_partkey, word, CASE WHEN list_contains(types, word) THEN 'exists' WHEN list_contains(names, word) THEN 'moved' ELSE 'added' END AS outcome,
{_JOINED.format("list_filter(names, lambda x: x <> word)")} AS whitelist, {_JOINED.format("CASE WHEN list_contains(types, word) THEN types ELSE list_append(types, word) END")} AS blocklist FROM p"""
)
def list_move(spark, sf):
    """What adding a word to a blocklist does to it and to the whitelist."""
    white, block, outcome = lists.moved(F.col("names"), F.col("types"), F.col("typed"))
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return _parts(spark, sf).select("p_partkey", lists.tidy(F.col("typed")).alias("word"), outcome.alias("outcome"), joined(white).alias("whitelist"), joined(block).alias("blocklist"))


@query(f"WITH {_PARTS} SELECT p_partkey, {_JOINED.format('CASE WHEN list_contains(types, word) OR list_contains(names, word) THEN names ELSE list_append(names, word) END')} AS whitelist, {_JOINED.format('list_filter(types, lambda x: x <> word)')} AS blocklist FROM p")
def list_changes(spark, sf):
    """A word added to a whitelist unless it is blocked or there already, and the same word taken from the blocklist."""
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return _parts(spark, sf).select("p_partkey", joined(lists.allowed(F.col("names"), F.col("types"), F.col("typed"))).alias("whitelist"), joined(lists.removed(F.col("types"), F.col("typed"))).alias("blocklist"))


@query(f"WITH {_PARTS} SELECT p_partkey, array_to_string(list_filter(listed, lambda x: contains(x, word[1:2])), ',') AS words FROM p")
def list_search(spark, sf):
    """The words of a list that hold what a user has typed so far, in the list's order."""
    part = F.concat(F.lit("  "), F.substring(F.trim("typed"), 1, 2), F.lit(" "))
    return _parts(spark, sf).select("p_partkey", F.array_join(lists.found(F.col("listed"), part), ",").alias("words"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality, CASE WHEN quality = toxic THEN '''-' || toxic ELSE CAST(toxic AS VARCHAR) END AS signed FROM labels")
def csv_safe_export(spark, sf):
    d = table(spark, sf, "labels").withColumn("signed", F.concat(F.when(F.col("quality") == F.col("toxic"), "-").otherwise(""), F.col("toxic").cast("string")))
    return files.safe_export(d.select("doc_id", "quality", "signed"))


@query()
def file_fingerprint(spark, sf):
    return files.fingerprints(spark, f"{sf}/labels.parquet")
