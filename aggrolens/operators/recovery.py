"""Disguised words recovered by joins: distinct tokens against an index of spellings, results mapped back into texts."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalise as n
from ..functions import vocab as v
from ..functions.text import let
from ..storage import spread, stored

SIGN = r"\p{L}\p{N}"
BEFORE, AFTER = rf"(?<![{SIGN}])", rf"(?![{SIGN}])"
#: Words with signs that stand for letters, words with hidden letters, and what runs() cuts texts into.
DISGUISED = rf"(?<![{SIGN}\p{{M}}])[{SIGN}][{SIGN}\p{{M}}!*#_@$]{{1,{n.DISGUISED_MOST}}}[{SIGN}\p{{M}}](?![{SIGN}\p{{M}}])"
PLAIN = rf"(?i){BEFORE}[a-z][a-z*#_]{{2,{n.PLAIN_MOST}}}[a-z]{AFTER}"
SIGNS = "!*#_@$"
IN_RUN = rf"{SIGN}\p{{M}}{SIGNS}"
RUN = rf"[{IN_RUN}]+"
FIRST, WHOLE = rf"(?<![{IN_RUN}])", rf"(?![{IN_RUN}])"
#: A run with anything but ASCII letters.
MIXED = rf"{FIRST}[A-Za-z]*+[{IN_RUN}&&[^A-Za-z]][{IN_RUN}]*+"


# --- the index ---------------------------------------------------------------------------------


def lexicon(spark: SparkSession) -> DataFrame:
    """word, valence of the lexicon in use: a small table (sources.files.read_lexicon bounds it)."""
    return spark.createDataFrame(list(v.LEXICON.items()), "word string, valence double")


def harsh(spark: SparkSession) -> DataFrame:
    """The words that disguises are recovered to."""
    return lexicon(spark).where((F.col("valence") <= n.HARSH) & (F.length("word") >= 4)).select("word")


def spellings(spark: SparkSession) -> DataFrame:
    """variant, word, words: each slip or dodge of each harsh word, and how many words a variant may stand for.

    Neighbours swapped (from five letters), an inner letter deleted (from six), vowels left out;
    what is itself in the lexicon or on the safe list is no variant.
    """
    word, size = F.col("word"), F.length("word")
    part = lambda a, b: F.substring(word, a, b)
    swapped = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.concat(part(F.lit(1), i - 1), part(i + 1, F.lit(1)), part(i, F.lit(1)), part(i + 2, size)))
    shorter = F.transform(F.sequence(F.lit(2), size - 1), lambda i: F.concat(part(F.lit(1), i - 1), part(i + 1, size)))
    none = F.array().cast("array<string>")
    forms = F.concat(F.when(size >= 5, swapped).otherwise(none), F.when(size >= 6, shorter).otherwise(none), F.array(F.regexp_replace(word, "[aeiou]", "")))
    d = harsh(spark).select("word", F.explode(forms).alias("variant")).where("variant <> word and length(variant) >= 4").distinct()
    d = d.join(lexicon(spark).select(F.col("word").alias("variant")), "variant", "left_anti").where(~F.col("variant").isin(v.RECOVERY_SAFE))
    return d.join(d.groupBy("variant").agg(F.count("*").alias("words")), "variant")


def known_forms(spark: SparkSession) -> DataFrame:
    """form, word: lexicon words themselves, listed typos, and variants of one word only. Of a form that is several of these the first counts."""
    words = lexicon(spark).select(F.col("word").alias("form"), "word")
    typos = spark.createDataFrame(list(v.ABUSE_TYPOS.items()), "form string, word string").join(words.select("form"), "form", "left_anti").where(~F.col("form").isin(v.RECOVERY_SAFE))
    slips = spellings(spark).where("words = 1").select(F.col("variant").alias("form"), "word").where(~F.col("form").isin(list(v.ABUSE_TYPOS)))
    return words.union(typos).union(slips)


# --- forms of tokens ---------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _without_marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)), na_action="ignore")


def folded(low: Column) -> Column:
    """Lower-case tokens in plain letters. Only tokens beyond ASCII leave the JVM."""
    bare = F.coalesce(_without_marks(F.when(low.rlike(r"[^\x00-\x7f]"), low)), low)
    return F.translate(bare, "".join(n.LOOKS), "".join(n.LOOKS.values()))


def squeezed(word: Column) -> Column:
    return F.regexp_replace(word, r"([a-z])\1+", "$1")


def cased(word: Column, like: Column) -> Column:
    return F.when((like == F.upper(like)) & like.rlike(r"\p{Lu}"), F.upper(word)).otherwise(word)


def unmasked(forms: DataFrame) -> DataFrame:
    """form, word: the one harsh word of a form's length that its shown letters fit; both ends and two letters must show. An equality join on length and ends, then a look at what lies between."""
    hidden = forms.select("form").where(F.col("form").rlike(r"^[a-z][a-z*#_]{3,}[a-z]$") & F.col("form").rlike(r"[*#_]")).distinct()
    ends = lambda c: [F.length(c).alias("size"), F.substring(c, 1, 1).alias("first"), F.right(F.col(c), F.lit(1)).alias("last")]
    words = harsh(forms.sparkSession).select("word", *ends("word"))
    pairs = hidden.select("form", *ends("form")).join(words, ["size", "first", "last"])
    fits = F.forall(F.arrays_zip(F.split("form", "").alias("a"), F.split("word", "").alias("b")), lambda x: x["a"].isin("*", "#", "_") | (x["a"] == x["b"]))
    return pairs.where(fits).groupBy("form").agg(F.min("word").alias("word"), F.count("*").alias("words")).where("words = 1").select("form", "word")


def respelled(forms: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """form, word of the forms that are known (known_forms(), if not given), a slip or a mask of one word. Safe words are none."""
    d = forms.where(~F.col("form").isin(v.RECOVERY_SAFE)).select("form").distinct()
    return d.join(known_forms(forms.sparkSession) if known is None else known, "form").union(unmasked(d))


def revealed(tokens: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """token, word of the disguised tokens that stand for one harsh word, as they are, in plain letters, or without repeated letters. Lexicon words and safe words stay."""
    d = tokens.select("token").distinct().withColumn("low", F.lower("token"))
    d = d.join(lexicon(tokens.sparkSession).select(F.col("word").alias("low")), "low", "left_anti").where(~F.col("low").isin(v.RECOVERY_SAFE))
    d = d.withColumn("plain", folded(F.col("low")))
    d = d.select("token", F.explode(F.array_distinct(F.array("low", "plain", squeezed(F.col("plain"))))).alias("form"))
    strong = lexicon(tokens.sparkSession).where((F.col("valence") <= n.HARSH) & ((F.length("word") >= 4) | F.col("word").isin(v.SHORT_ABUSE))).select("word")
    found = d.join(respelled(d, known), "form").join(strong, "word", "left_semi").groupBy("token").agg(F.min("word").alias("word"), F.max("word").alias("other"))
    return found.where("word = other").select("token", cased(F.col("word"), F.col("token")).alias("word")).where("word <> token")


def typed(tokens: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """token, word of plain tokens that are a slip or a mask of one word."""
    d = tokens.select("token", F.lower("token").alias("form")).distinct()
    return d.join(respelled(d, known), "form").where("form <> word").select("token", cased(F.col("word"), F.col("token")).alias("word"))


def put_together(tokens: DataFrame) -> DataFrame:
    """token, word of the harsh words whose letters stand apart, repeat or have look-alikes: an equality join on the letters without repetitions."""
    spark = tokens.sparkSession
    words = harsh(spark).union(spark.createDataFrame([(w,) for w in v.SHORT_ABUSE], "word string")).distinct()
    letters = squeezed(F.regexp_replace(F.translate(F.lower("token"), "".join(n.LOOKS), "".join(n.LOOKS.values())), "[^a-z]", ""))
    # of words that are alike without repetitions, the one that comes first in the order of recovery
    index = words.groupBy(squeezed(F.col("word")).alias("letters")).agg(F.max_by("word", F.struct(-F.length("word"), "word")).alias("word"))
    d = tokens.select("token").distinct().withColumn("letters", letters).join(index, "letters").where(F.col("word") != F.lower("token"))
    return d.select("token", cased(F.col("word"), F.col("token")).alias("word"))


@lru_cache(1)
def separated() -> str:
    """The pattern of harsh words with repeated letters, look-alikes and up to four separators between letters."""
    return "(?iu)" + n.separated()[0].pattern.replace(n.separators(), r"[ \p{P}\p{S}]{0,4}").replace(n.START, BEFORE).replace(n.END, AFTER)


v.FORGOTTEN.append(separated.cache_clear)


# --- texts -------------------------------------------------------------------------------------


@lru_cache(1)
def unsettled() -> str:
    """Characters that composed() may change, as a pattern: all but Latin letters and common marks that it leaves alone."""
    points = [i for i in [*range(0x250), *range(0x2010, 0x2030)] if unicodedata.normalize("NFKC", chr(i)) == chr(i) and not n.INVISIBLE.match(chr(i))]
    starts = [i for i, p in enumerate(points) if i == 0 or points[i - 1] != p - 1]
    ranges = [(points[a], points[z - 1]) for a, z in zip(starts, [*starts[1:], len(points)], strict=True)]
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in ranges) + "]"


@F.pandas_udf(T.StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(lambda x: n.INVISIBLE.sub("", unicodedata.normalize("NFKC", x)), na_action="ignore")


def composed(text: Column) -> Column:
    """Texts with compatibility forms composed and invisible characters taken out. Only texts with such characters leave the JVM."""
    beyond = F.regexp_replace(text, r"[\x00-\x7f]+", "")  # what is left of most texts is short
    return F.coalesce(_composed(F.when(beyond.rlike(unsettled()), text)), text)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


@lru_cache(1)
def plainest() -> tuple[list[str], list[str], list[str], str, str]:
    """What a token is judged by before any join: slips and strong words in plain letters without repetitions; words that stay; ends and length of harsh words; and characters, what stands for them in plain letters, those that go being last. Characters that are no ASCII then, either, are left out."""
    strong = [*n.harsh_words(), *(w for w in v.SHORT_ABUSE if v.LEXICON.get(w, 0) <= n.HARSH)]
    known = {n.REPEATED.sub(r"\1", x) for w in {*strong, *(n.respellable() - v.LEXICON.keys())} for x in (w, n.folded(w))}
    shapes = sorted({f"{w[0]}{w[-1]}{len(w)}" for w in n.harsh_words()})
    letters = {c: n.folded(c) for c in map(chr, range(0x20000))}
    letters = sorted(((c, x) for c, x in letters.items() if x != c and len(x) < 2 and x.isascii()), key=lambda p: (-len(p[1]), p[0]))
    return sorted(known), [*v.LEXICON, *v.RECOVERY_SAFE], shapes, "".join(c for c, _ in letters), "".join(x for _, x in letters)


def _branches(words: Collection[str], at: int = 0) -> str:
    """What may follow `at` common letters of some words, each letter once or more."""
    nexts = defaultdict(list)
    for w in words:
        nexts[w[at : at + 1]].append(w)
    forms = [c + "+" + _branches(ws, at + 1) for c, ws in sorted(nexts.items()) if c]
    return "(?:" + "|".join(forms + ([WHOLE] if "" in nexts else [])) + ")"


@lru_cache(1)
def spelled() -> str:
    """The pattern of runs of ASCII letters that are, repetitions aside, a slip or a strong word. Look-ups of every run, one by one, take longer."""
    words = [w for w in plainest()[0] if re.fullmatch("[a-z]+", w)]
    return f"(?i){FIRST}(?=[a-z]{{{min(map(len, words), default=1)}}}){_branches(words)}"


v.FORGOTTEN += [plainest.cache_clear, spelled.cache_clear]


def may_stand_for(token: Column) -> Column:
    """Whether a disguised or plain token may change: true for all that revealed() or typed() change, and for few others, so that little goes into the joins. In plain letters and without repetitions it is a slip or a strong word, or it has hidden letters and a harsh word's ends and length."""
    known, settled, shapes, letters, plain = plainest()

    def hidden(plain: Column) -> Column:
        shape = lambda c: F.concat(F.substring(c, 1, 1), F.right(c, F.lit(1)), F.length(c).cast("string")).isin(shapes)
        some = plain.contains("*") | plain.contains("#") | plain.contains("_")
        return some & plain.rlike("^[a-z][a-z*#_]*[a-z]$") & (shape(plain) | shape(squeezed(plain)))

    def judged(low: Column) -> Column:
        found = let(F.translate(low, letters, plain), lambda x: squeezed(x).isin(known) | hidden(x))
        if not all(w.isascii() for w in known):
            found = found | low.rlike(r"[^\x00-\x7f]")
        return found & ~low.isin(settled)

    return let(F.lower(token), judged)


def may_change(text: Column) -> Column:
    """The different runs of texts with a token that may change. A run without signs and marks, but for signs at its ends, is one token."""

    def judged(run: Column) -> Column:
        parts = F.concat(matches(run, DISGUISED), matches(run, PLAIN))
        return let(F.trim(run, F.lit(SIGNS)), lambda x: F.when(x.rlike(rf"[{SIGNS}\p{{M}}]"), F.exists(parts, may_stand_for)).otherwise(may_stand_for(x)))

    letters = F.filter(F.array_distinct(matches(text, spelled())), may_stand_for)
    return F.concat(letters, F.filter(F.array_distinct(matches(text, MIXED)), judged))


def kept_apart(token: Column) -> Column:
    """Whether letters that separated() found are kept apart, repeated or have look-alikes."""
    return F.lower(token).rlike(r"[^a-z]|([a-z])\1")


def changed(tokens: DataFrame, pattern: str, recover: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run, token, word: what matches pattern in runs and recover changes."""
    parts = stored(tokens.select("run", F.explode(F.filter(matches(F.col("run"), pattern), may_stand_for)).alias("token")), "parts")
    return parts.join(recover(parts), "token")


def searched(text: Column) -> Column:
    """text, runs, apart as a struct: a text, its runs with a token that may change, and letters kept apart. Texts are searched here alone."""
    apart = F.array_distinct(F.filter(matches(text, separated()), kept_apart))
    return F.struct(text.alias("text"), may_change(text).alias("runs"), apart.alias("apart"))


def candidates(keyed: DataFrame) -> DataFrame:
    """key, text, runs, apart of the texts that may change."""
    # a filter on named columns would be pushed below them and search the texts twice
    found = F.filter(F.array(searched(F.col("text"))), lambda x: (F.size(x["runs"]) > 0) | (F.size(x["apart"]) > 0))
    return keyed.select("key", F.inline(found))


def within(docs: DataFrame, pattern: str) -> DataFrame:
    """key, token of what matches pattern in the runs of docs and may change."""
    return docs.select("key", F.explode("runs").alias("run")).select("key", F.explode(F.filter(matches(F.col("run"), pattern), may_stand_for)).alias("token")).distinct()


def replaced(docs: DataFrame, pattern: str, tokens: DataFrame, recover: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs (key, text, runs, apart) with what of text matches pattern replaced as recover says of tokens (key, token). What changes goes back as a small map for each text that has any; such texts are searched again."""
    tokens = stored(tokens, "tokens")
    maps = tokens.join(recover(tokens), "token").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("token", "word"))).alias("words"))
    found = F.transform(matches(F.col("text"), pattern), lambda w: F.coalesce(F.try_element_at("words", w), w))
    whole = F.array_join(F.flatten(F.zip_with(F.split("text", pattern, -1), found, lambda gap, w: F.array(gap, F.coalesce(w, F.lit(""))))), "")
    new = F.when(F.col("words").isNull(), F.struct("text", "runs", "apart")).otherwise(let(whole, searched))
    return docs.join(maps, "key", "left").select("key", F.inline(F.array(new)))


def normalised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with disguises of harsh words in text undone, as functions.normalise does text by text: disguised words, letters kept apart, then slips of the pen.

    Texts are searched once; of their runs of letters and signs, those that may change are made
    distinct before anything is looked up, so the joins grow with what is disguised and not with
    the texts. Texts that hold a run, or letters kept apart, which one of the dictionaries changes
    are set aside, each different one once, and rewritten by the same joins in order; all others
    are known to stay. Null texts stay, too.
    """
    forms = stored(known_forms(docs.sparkSession), "forms")
    disguised, slips = (lambda d: revealed(d, forms)), (lambda d: typed(d, forms))
    d = spread(docs).withColumn(text, composed(F.col(text)))
    keyed = d.select(F.md5(text).alias("key"), F.col(text).alias("text")).where("text is not null")
    found = stored(candidates(keyed), "candidates")
    runs = stored(found.select("key", F.explode("runs").alias("run")), "runs")
    known = stored(runs.select("run").distinct(), "known")
    odd = changed(known, DISGUISED, disguised).select("run").union(changed(known, PLAIN, slips).select("run")).distinct()
    apart = stored(found.select("key", F.explode("apart").alias("token")), "apart")
    keys = runs.join(odd, "run").select("key").union(apart.join(put_together(apart), "token").select("key"))
    keys = stored(keys.distinct(), "keys")  # its size decides on the join with the candidates
    first = F.first(F.struct("text", "runs", "apart")).alias("x")
    some = stored(found.join(keys, "key", "left_semi").groupBy("key").agg(first).select("key", "x.*"), "affected")
    for pattern, recover in ((DISGUISED, disguised), (separated(), put_together), (PLAIN, slips)):
        tokens = some.select("key", F.explode("apart").alias("token")) if recover is put_together else within(some, pattern)
        some = stored(replaced(some, pattern, tokens, recover), "rewritten")
    out = d.withColumn("_key", F.md5(text)).join(some.select(F.col("key").alias("_key"), F.col("text").alias("_new")), "_key", "left")
    return out.withColumn(text, F.coalesce("_new", F.col(text))).select(*docs.columns)


def runs(text: Column) -> Column:
    """Runs of letters, digits, marks and signs that stand for letters, without signs at their ends, of 3 to 40 characters."""
    ends = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda x: F.regexp_replace(x, r"^[!*#_@$\p{M}]+|[!*#_@$]+$", ""))
    return F.filter(ends, lambda x: F.length(x).between(3, n.DISGUISED_MOST + 2))


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, n, recovered of every distinct run of the texts: the word that it stands for, or itself."""
    known = stored(spread(docs.select(text)).select(F.explode(runs(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), "tokens")
    forms = stored(known_forms(docs.sparkSession), "forms")
    first = revealed(known, forms)
    plain = known.where(F.col("token").rlike(PLAIN.replace(BEFORE, "^").replace(AFTER, "$")))
    second = typed(plain, forms)
    d = known.join(first.withColumnRenamed("word", "_a"), "token", "left").join(second.withColumnRenamed("word", "_b"), "token", "left")
    return d.select("token", "n", F.coalesce("_a", "_b", "token").alias("recovered"))
