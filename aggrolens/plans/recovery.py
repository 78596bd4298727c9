"""Queries on disguised words and what they stand for, over the words of documents, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalise as n
from ..functions import vocab as v
from ..operators import recovery as r
from ..storage import spread
from . import sql as q
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


def texts(spark, sf):
    return table(spark, sf, "documents").where("text is not null")


# --- SQL ---------------------------------------------------------------------------------------

LEX = f"lex AS (SELECT word, {q.case_map(v.LEXICON, 'word')} AS valence FROM (SELECT unnest({q.lst(list(v.LEXICON))}) AS word))"
HARSH = f"{LEX}, hw AS (SELECT word FROM lex WHERE valence <= {n.HARSH} AND length(word) >= 4)"
INDEX = f"""{HARSH}, sp AS (SELECT word, unnest(list_transform(range(1, length(word)), lambda i: word[1:i - 1] || word[i + 1] || word[i] || word[i + 2:])) AS variant FROM hw WHERE length(word) >= 5
UNION ALL SELECT word, unnest(list_transform(range(2, length(word)), lambda i: word[1:i - 1] || word[i + 1:])) FROM hw WHERE length(word) >= 6
UNION ALL SELECT word, regexp_replace(word, '[aeiou]', '', 'g') FROM hw),
dv AS (SELECT DISTINCT variant, word FROM sp WHERE variant <> word AND length(variant) >= 4 AND NOT list_contains({q.lst(list(v.LEXICON))}, variant) AND NOT list_contains({q.lst(v.RECOVERY_SAFE)}, variant)),
ix AS (SELECT variant, word, count(*) OVER (PARTITION BY variant) AS words FROM dv),
typos AS (SELECT t.form, t.word FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in v.ABUSE_TYPOS.items())}) AS t(form, word) WHERE t.form NOT IN (SELECT word FROM lex) AND NOT list_contains({q.lst(v.RECOVERY_SAFE)}, t.form)),
forms AS (SELECT word AS form, word FROM lex UNION ALL SELECT * FROM typos UNION ALL SELECT variant, word FROM ix WHERE words = 1 AND NOT list_contains({q.lst(list(v.ABUSE_TYPOS))}, variant))"""
WORDS = f"wd AS (SELECT word, count(*) AS n FROM (SELECT unnest({q.WORDS.format('text')}) AS word FROM documents WHERE text IS NOT NULL) GROUP BY word)"


def masks(source: str) -> str:
    """CTEs hid and unm(form, word): forms of source with hidden letters that one harsh word fits."""
    return f"""hid AS (SELECT DISTINCT form, replace(replace(form, '*', '_'), '#', '_') AS shape FROM {source} WHERE regexp_full_match(form, '[a-z][a-z*#_]{{3,}}[a-z]') AND regexp_matches(form, '[*#_]')),
unm AS (SELECT form, min(word) AS word FROM hid JOIN hw ON length(word) = length(form) AND word LIKE shape GROUP BY form HAVING count(*) = 1)"""


def squeezed(word: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        word = f"regexp_replace({word}, '{c}+', '{c}', 'g')"
    return word


_SIGNS = "!*#_@$"
_TOKENS = f"""runs AS (SELECT unnest(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}{_SIGNS}]+'), lambda x: regexp_replace(x, '^[{_SIGNS}\\p{{M}}]+|[{_SIGNS}]+$', '', 'g'))) AS token FROM documents WHERE text IS NOT NULL),
known AS (SELECT token, count(*) AS n FROM runs WHERE length(token) BETWEEN 3 AND {n.DISGUISED_MOST + 2} GROUP BY token),
low AS (SELECT token, lower(token) AS low FROM known),
open_ AS (SELECT * FROM low WHERE low NOT IN (SELECT word FROM lex) AND NOT list_contains({q.lst(v.RECOVERY_SAFE)}, low)),
plain AS (SELECT token, low, translate(strip_accents(low), '{"".join(n.LOOKS)}', '{"".join(n.LOOKS.values())}') AS plain FROM open_),
fm AS (SELECT DISTINCT token, form FROM (SELECT token, unnest([low, plain, {squeezed("plain")}]) AS form FROM plain) WHERE NOT list_contains({q.lst(v.RECOVERY_SAFE)}, form)),
{masks("fm")}, resp AS (SELECT * FROM forms UNION ALL SELECT * FROM unm),
strong AS (SELECT word FROM lex WHERE valence <= {n.HARSH} AND (length(word) >= 4 OR list_contains({q.lst(v.SHORT_ABUSE)}, word))),
rev AS (SELECT token, min(r.word) AS word FROM fm JOIN resp r ON r.form = fm.form JOIN strong s ON s.word = r.word GROUP BY token HAVING min(r.word) = max(r.word)),
typ AS (SELECT token, r.word FROM low JOIN resp r ON r.form = low.low AND r.form <> r.word WHERE regexp_full_match(low, '[a-z][a-z*#_]{{2,{n.PLAIN_MOST}}}[a-z]') AND NOT list_contains({q.lst(v.RECOVERY_SAFE)}, low)),
res AS (SELECT k.token, k.n, coalesce(rev.word, typ.word) AS word FROM known k LEFT JOIN rev ON rev.token = k.token LEFT JOIN typ ON typ.token = k.token)"""


# --- queries -----------------------------------------------------------------------------------


@query(f"WITH {INDEX}, {_TOKENS} SELECT token, n, CASE WHEN word IS NULL THEN token WHEN token = upper(token) AND regexp_matches(token, '\\p{{Lu}}') THEN upper(word) ELSE word END AS recovered FROM res")
def recovered_tokens(spark, sf):
    """Every different run of letters and signs in documents, how often it occurs, and what it stands for."""
    return r.dictionary(texts(spark, sf))


@query()
def recovered_texts(spark, sf):
    """Whole texts with disguises undone by joins; the tests hold it against the function that goes text by text."""
    return r.normalised(texts(spark, sf).select("doc_id", "text"))


def word_counts(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return spread(texts(spark, sf).select("text")).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {INDEX}, {WORDS} SELECT ix.variant, ix.word, ix.words, coalesce(wd.n, 0) AS n FROM ix LEFT JOIN wd ON wd.word = ix.variant")
def recovery_index(spark, sf):
    """Each spelling of each harsh word, how many words it may stand for, and how often documents have it."""
    n_of = word_counts(spark, sf).withColumnRenamed("word", "variant")
    return r.spellings(spark).join(n_of, "variant", "left").select("variant", "word", "words", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {HARSH}, {WORDS} SELECT row_number() OVER (ORDER BY length(hw.word) DESC, hw.word) AS place, hw.word, coalesce(wd.n, 0) AS n FROM hw LEFT JOIN wd ON wd.word = hw.word")
def recovery_order(spark, sf):
    """Harsh words in the order in which they are looked for, and how often documents have them. The lexicon alone is ranked."""
    place = F.row_number().over(W.orderBy(F.desc(F.length("word")), "word"))
    return r.harsh(spark).withColumn("place", place.cast("long")).join(word_counts(spark, sf), "word", "left").select("place", "word", F.coalesce("n", F.lit(0)).alias("n"))


_MASKED = "tk AS (SELECT form, sum(n) AS n FROM (SELECT word[1] || regexp_replace(word[2:length(word) - 1], '[aeiou]', '*', 'g') || word[-1] AS form, n FROM wd WHERE length(word) >= 5) GROUP BY form)"


@query(f"WITH {HARSH}, {WORDS}, {_MASKED}, {masks('tk')} SELECT tk.form AS token, unm.word, CAST(tk.n AS BIGINT) AS n FROM unm JOIN tk ON tk.form = unm.form WHERE length(replace(replace(replace(tk.form, '*', ''), '#', ''), '_', '')) >= 2")
def masked_words(spark, sf):
    """Words of documents with their inner vowels hidden, where one harsh word alone fits what is left."""
    inner = F.regexp_replace(F.expr("substring(word, 2, length(word) - 2)"), "[aeiou]", "*")
    masked = F.concat(F.substring("word", 1, 1), inner, F.expr("right(word, 1)")).alias("form")
    d = word_counts(spark, sf).where("length(word) >= 5").groupBy(masked).agg(F.sum("n").alias("n"))
    return r.unmasked(d).join(d, "form").select(F.col("form").alias("token"), "word", "n")
