"""Rows of log reports, diagnostics, status tables and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import render as r
from ..functions import text as t
from ..functions import vocab as v
from ..storage import stored
from . import scoring as s

MODES = ("hybrid", "nb", "lexicon")


def resolved_mode(saved: Column, expert: Column) -> Column:
    """The saved mode where the expert view is on and it is a mode; else hybrid."""
    return F.when(expert & saved.isin(*MODES), saved).otherwise("hybrid")


def latest_settings(changes: DataFrame) -> DataFrame:
    """key and value of each setting's last change (key, value, seq); removed ones (null) are left out."""
    return changes.groupBy("key").agg(F.max_by("value", "seq").alias("value")).where("value is not null")


def shown_as_blocked(flagged: Column, score: Column, threshold: float = DEFAULT.threshold) -> Column:
    """How the log list judges an entry: by its flag or by its score as logged, with three digits."""
    return (F.coalesce(flagged, F.lit(0)) == 1) | (F.coalesce(F.round(score, 3), F.lit(0.0)) >= threshold)


def report_rows(entries: DataFrame, scope: str, order: str) -> DataFrame:
    """Numbered report rows of a log, the newest first: number, verdict by the flag first, percentage and mode."""
    number = F.row_number().over(W.partitionBy(scope).orderBy(F.desc(order)))
    blocked = F.coalesce(F.col("flagged") == 1, F.col("score") >= DEFAULT.threshold, F.lit(False))
    return entries.select(scope, order, r.padded(number).alias("number"), F.when(blocked, "BLOCKED").otherwise("SAFE").alias("verdict"), r.percent(F.coalesce("score", F.lit(0.0))).alias("percentage"), F.upper(F.coalesce("mode", F.lit("hybrid"))).alias("mode"), "text")


def last_of(rows: DataFrame, scope: str, order: list[Column], most: int) -> DataFrame:
    """The newest `most` rows of each scope. Spark limits each partition before the shuffle."""
    return rows.withColumn("age", F.row_number().over(W.partitionBy(scope).orderBy(*order))).where(F.col("age") <= most)


def status_of(raw: Column) -> tuple[Column, Column]:
    """(status, whether it had to be replaced): only the exact words count."""
    known = raw.isin("Passed", "Failed", "Not Tested")
    return F.when(known, raw).otherwise("Not Tested"), ~F.coalesce(known, F.lit(False))


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unequal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose rows don't all hold the same value, with how many they hold."""
    return rows.groupBy(key).agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count_distinct(value).alias("n_values")).where("n_values > 1")


def unknown(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Keys that a table of known ones lacks."""
    return rows.select(key).distinct().join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def in_batches(rows: DataFrame, scope: str, order: str, size: int = 5) -> DataFrame:
    """rows with batch: runs of `size` rows of a scope in order, from 1."""
    at = F.row_number().over(W.partitionBy(scope).orderBy(order))
    return rows.withColumn("batch", F.ceil(at / size).cast("long"))


def raw_counts(model: DataFrame) -> DataFrame:
    """token, raw0, raw1: counts got back from the likelihoods."""
    totals = model.agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"), F.count("*").alias("v"))
    back = lambda k: F.round(F.exp(f"ll{k}") * (F.col(f"t{k}") + F.col("v")) - 1).cast("long").alias(f"raw{k}")
    return model.crossJoin(F.broadcast(totals)).select("token", back(0), back(1))  # one row


def negations(text: Column) -> Column:
    """Negations as written in a text, each with the lower-case words that follow it within three words: an array of (trigger, after)."""
    after = lambda low, i: F.slice(low, i + 2, F.lit(DEFAULT.negation_window))
    at = lambda tk: lambda low: F.transform(tk, lambda w, i: F.when(F.get(low, i).isin(v.NEGATION_TRIGGERS), F.struct(w.alias("trigger"), after(low, i).alias("after"))))
    found = lambda tk: t.let(F.transform(tk, F.lower), lambda low: F.when(t.any_in(low, v.NEGATION_TRIGGERS), F.array_compact(at(tk)(low))))
    return t.let(F.regexp_extract_all(text, F.lit("([a-zA-Z']+)"), F.lit(1)), found)


def highlights(docs: DataFrame, model: DataFrame, key: str = "doc_id", only_triggers: bool = False) -> DataFrame:
    """key, kind, pattern of what to highlight in each text of docs (key, text): sarcastic phrases, negated words and their negations, words that Naive Bayes counts as aggressive, and other words of negative valence.

    With only_triggers: key, trigger of the negations alone. Function words are never shown, nor are words of positive valence for Naive Bayes' sake.
    Texts are read once: what they hold of tokens, lexicon words, phrases and negations is stored, and the rest works on that.
    """
    d = s.with_hits(docs.select(key, "text"), "text")
    hit = F.transform("_hits", lambda h: F.struct(h["word"].alias("word"), (h["valence"] < 0).alias("low"), h["negated"].alias("negated")))
    parts = stored(d.select(key, F.array_distinct(s.counted_tokens(F.col("text"))).alias("tokens"), F.array_distinct(hit).alias("hits"), negations(F.col("text")).alias("negations"), t.sarcasm_markers(F.col("text")).alias("cues")), "parts")
    shown = ~F.col("word").isin(v.FUNCTION_WORDS)
    push = parts.select(key, F.explode("tokens").alias("token")).where(~F.startswith(F.col("token"), F.lit("cue_"))).join(model.where("ll1 > ll0").select("token"), "token")
    push = stored(push.select(key, F.startswith(F.col("token"), F.lit("not_")).alias("negated"), F.regexp_replace("token", "^not_", "").alias("word")).where(shown), "pushes")
    hits = parts.select(key, F.explode("hits").alias("h")).select(key, "h.*").where(shown)
    negated = push.where("negated").select(key, "word").union(hits.where("negated").select(key, "word")).distinct()
    near = parts.select(key, F.explode("negations").alias("n")).select(key, F.col("n.trigger").alias("trigger"), F.explode("n.after").alias("word"))
    flips = near.join(negated, [key, "word"]).select(key, F.col("trigger").alias("word")).distinct()
    if only_triggers:
        return flips.select(key, F.col("word").alias("trigger"))
    nb = push.where(~F.col("negated") & ~F.col("word").isin(t.praise())).select(key, "word")
    known = negated.union(nb).distinct()
    other = hits.where("low").select(key, "word").distinct().join(known, [key, "word"], "left_anti")
    cues = parts.select(key, F.explode("cues").alias("word"))
    kinds = [("sarcasm", cues), ("negation", negated), ("negation", flips), ("nb", nb), ("lexicon", other)]
    out = None
    for kind, d in kinds:
        d = d.select(key, F.lit(kind).alias("kind"), F.col("word").alias("pattern"))
        out = d if out is None else out.union(d)
    return out.distinct()


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounded with halves up; what binary fractions are off by is taken out first."""
    return F.floor(F.round(x * 10**digits, 6) + 0.5) / 10**digits


def dimension_means(answers: DataFrame) -> DataFrame:
    """dimension, items, mean (of the items' rounded means), same_n (every item has as many answers), from dimension, item and level of each answer."""
    items = answers.groupBy("dimension", "item").agg(F.count("*").alias("n"), (F.floor(F.sum("level") / F.count("*") * 100 + 0.5) / 100).alias("mean"))
    return items.groupBy("dimension").agg(F.count("*").alias("items"), half_up(F.avg("mean")).alias("mean"), (F.count_distinct("n") == 1).alias("same_n"))
