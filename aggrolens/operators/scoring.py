"""Naive Bayes and lexicon scoring, blending and policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import normalise as n
from ..functions import text as t
from ..functions import vocab as v
from ..storage import stored


def md5_order(key: str = "doc_id") -> list[Column]:
    return [F.md5(F.col(key).cast("string")), F.col(key)]


def first_of_label(df: DataFrame, quota: Column, label: str = "label", digits: int = 4) -> DataFrame:
    """df with first: whether a row is among the first `quota` of its label in md5 order of ids. quota: of the columns n_label (rows of the label) and n_positive (rows of label 1).

    Rows are counted by label and the first hexadecimal digits of their md5, 65,536 cells a label, so
    the quota's cell is known from a small table, which is broadcast; only the rows of that cell are ranked.
    """
    cell = F.substring(F.md5(F.col("doc_id").cast("string")), 1, digits)
    d = df.withColumn("_cell", cell)
    by_label = W.partitionBy(label)
    cells = d.groupBy(label, "_cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(by_label.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).withColumn("n_label", F.sum("n").over(by_label))
    positive = df.agg(F.count_if(F.col(label) == 1).alias("n_positive"))
    cells = cells.crossJoin(F.broadcast(positive)).select(F.col(label).alias("_label"), F.col("_cell").alias("_of"), "n", (quota - F.col("before")).alias("_left"))  # one row
    d = d.join(F.broadcast(cells), (F.col(label) == F.col("_label")) & (F.col("_cell") == F.col("_of"))).drop("_cell", "_of", "_label")
    cut = (F.col("_left") > 0) & (F.col("_left") < F.col("n"))
    sure = d.where(~cut).withColumn("first", F.col("_left") > 0)
    rank = F.row_number().over(by_label.orderBy(*md5_order()))
    return sure.unionByName(d.where(cut).withColumn("first", rank <= F.col("_left"))).drop("n", "_left")


def stratified_split(df: DataFrame, label: str = "label", share: float = DEFAULT.test_share) -> DataFrame:
    """df with is_test: of each label's rows, in md5 order of their ids, the first `share`."""
    return first_of_label(df, F.floor(F.col("n_label") * share + 0.5), label).withColumnRenamed("first", "is_test")


def balanced(df: DataFrame, label: str = "label", most: int = DEFAULT.negatives_per_positive) -> DataFrame:
    """All positives and at most `most` negatives for each, the first in md5 order."""
    quota = F.when(F.col(label) == 1, F.col("n_label")).otherwise(most * F.col("n_positive"))
    return first_of_label(df, quota, label).where("first").drop("first")


def numbered(df: DataFrame, key: str, name: str, parts: int = 64) -> DataFrame:
    """df with name: 1, 2, ... in the order of a numeric key without ties, nulls or gaps in between. Ranges of the key, by approximate percentiles, are counted, and rows ranked within theirs."""
    splits = df.agg(F.approx_percentile(key, F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]), F.lit(10_000)).alias("splits"))
    d = df.crossJoin(F.broadcast(splits)).withColumn("_part", F.size(F.filter("splits", lambda x: x < F.col(key)))).drop("splits")  # one row
    counts = d.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    d = d.join(F.broadcast(counts), "_part")
    return d.withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(key))).drop("_part", "_before")


def token_counts(corpus: DataFrame, tokens: Column | None = None) -> DataFrame:
    """label, token, n. Counts are combined before the shuffle."""
    return corpus.select("label", F.explode(t.content_tokens(F.col("text")) if tokens is None else tokens).alias("token")).groupBy("label", "token").agg(F.count("*").alias("n"))


def train_nb(corpus: DataFrame, tokens: Column | None = None) -> DataFrame:
    """token, c0, c1, ll0, ll1, prior0, prior1: multinomial Naive Bayes with add-one smoothing, as a table.

    One pass over the texts: a null token at each text's end counts the texts. The counts, as many
    as there are different tokens, are stored, as totals and likelihoods both need them.
    """
    tokens = F.coalesce(t.content_tokens(F.col("text")) if tokens is None else tokens, F.array().cast("array<string>"))
    d = corpus.select("label", F.explode(F.concat(tokens, F.array(F.lit(None).cast("string")))).alias("token"))
    of = lambda k: F.count_if(F.col("label") == k).alias(f"c{k}")
    all_counts = stored(d.groupBy("token").agg(of(0), of(1)), "counts")
    counts = all_counts.where("token is not null")
    totals = counts.agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"), F.count("*").alias("v"))
    docs = all_counts.where("token is null").agg(F.sum("c0").alias("d0"), F.sum("c1").alias("d1"))
    one = totals.crossJoin(docs)  # one row by one row
    m = counts.crossJoin(F.broadcast(one))
    ll = lambda k: F.log((F.col(f"c{k}") + 1) / (F.col(f"t{k}") + F.col("v"))).alias(f"ll{k}")
    prior = lambda k: F.log(F.col(f"d{k}") / (F.col("d0") + F.col("d1"))).alias(f"prior{k}")
    return m.select("token", "c0", "c1", ll(0), ll(1), prior(0), prior(1))


def softmax(s0: Column, s1: Column) -> Column:
    return 1 / (1 + F.exp(F.least(s0 - s1, F.lit(700.0))))


def score_nb(docs: DataFrame, model: DataFrame, tokens: Column | None = None, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, matched tokens and nb: probability of the positive class; texts without known tokens get the prior's. keep: short columns of docs that come along, so that nothing has to be joined back."""
    d = docs.select(key, *keep, F.explode_outer(t.content_tokens(F.col("text")) if tokens is None else tokens).alias("token"))
    prior = model.select("prior0", "prior1").limit(1)
    sums = [F.count("ll0").alias("matched"), F.coalesce(F.sum("ll0"), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("ll1"), F.lit(0.0)).alias("s1")]
    s = d.join(model.select("token", "ll0", "ll1"), "token", "left").groupBy(key).agg(*sums, *[F.first(c).alias(c) for c in keep])
    s = s.crossJoin(F.broadcast(prior))  # one row
    return s.select(key, *keep, "matched", softmax(F.col("s0") + F.col("prior0"), F.col("s1") + F.col("prior1")).alias("nb"))


def counted_tokens(text: Column) -> Column:
    """The live tokens of a text that count, in their places, with nulls for those that don't: a swear before praise and casual words."""

    def praised(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.when(a.isin(v.SWEARS) & b.isin(t.praise()), a))
        return F.when(t.any_in(words, v.SWEARS), F.get(F.array_compact(pairs), F.lit(0)))

    counts = lambda x, swear: ~x.isin(v.CASUAL) & ~F.coalesce(x == swear, F.lit(False))
    kept = lambda swear: F.transform(t.live_tokens(text), lambda x: F.when(counts(x, swear), x))
    return t.let(t.let(t.letter_words(text), praised), kept)


def page_tokens(docs: DataFrame, text: str, key: list[str]) -> DataFrame:
    """key, place (from 0, null for a text without tokens) and token of each live token that counts. Texts without any keep a row with a null."""
    return docs.select(*key, F.posexplode_outer(counted_tokens(F.col(text))).alias("place", "token"))


def dampened_nb(docs: DataFrame, model: DataFrame, key: str | list[str] = "doc_id", text: str = "text", keep: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """key, matched, nb of page texts by a model of live tokens. A negated word is a token of its own, not_word, of which a quarter of the difference between the classes is taken off, half from either side.

    keep: short columns of docs that come along, so that nothing has to be joined back; more: further aggregates, with names, of each text's token, ll0 and ll1.
    """
    key = [key] if isinstance(key, str) else key
    j = page_tokens(docs, text, [*key, *keep]).join(model.select("token", "ll0", "ll1"), "token", "left")
    mean, kept = (F.col("ll0") + F.col("ll1")) / 2, DEFAULT.nb_negation_kept
    drawn = lambda c: F.when(F.startswith(F.col("token"), F.lit("not_")), mean + kept * (F.col(c) - mean)).otherwise(F.col(c))
    s = j.groupBy(*key).agg(F.count("ll0").alias("matched"), F.coalesce(F.sum(drawn("ll0")), F.lit(0.0)).alias("s0"), F.coalesce(F.sum(drawn("ll1")), F.lit(0.0)).alias("s1"), *[F.first(c).alias(c) for c in keep], *more)
    s = s.crossJoin(F.broadcast(model.select("prior0", "prior1").limit(1)))
    found = F.round(softmax(F.col("s0") + F.col("prior0"), F.col("s1") + F.col("prior1")), 4)
    return s.withColumn("nb", found).drop("s0", "s1", "prior0", "prior1")


def with_hits(docs: DataFrame, text: str, lexicon: dict[str, float] = v.LEXICON) -> DataFrame:
    """docs with _tokens and _hits of a text whose slang is taken apart. Each step is a column, made once."""
    d = docs.withColumn("_apart", t.split_slang(F.col(text)))
    d = d.withColumn("_tokens", t.lexicon_tokens(F.col("_apart"))).withColumn("_low", F.transform("_tokens", t.bare))
    return d.withColumn("_hits", t.lexicon_hits(F.col("_tokens"), F.col("_low"), lexicon)).drop("_apart", "_low")


def score_lexicon(docs: DataFrame, text: str = "text", lexicon: dict[str, float] = v.LEXICON) -> DataFrame:
    """docs with compound and lex: valence of the text or of its first insulting clause, in the light of sarcasm. All in the JVM, no shuffle."""
    d = docs.withColumn("_scored", F.coalesce(t.direct_insult_clause(F.col(text)), F.col(text)))
    d = with_hits(d, "_scored", lexicon)
    d = d.withColumn("_plain", t.compound(F.col("_scored"), F.col("_hits"), F.size("_tokens"))).withColumn("_cue", t.sarcasm_cue(F.col(text)))
    d = d.withColumn("_compound", t.corrected(F.col("_plain"), F.col("_cue")))
    return d.withColumn("compound", F.round("_compound", 4)).withColumn("lex", t.aggression(F.col("_compound"))).drop("_scored", "_compound", "_plain", "_cue", "_tokens", "_hits")


def blended(nb: Column, lex: Column, matched: Column | None = None) -> Column:
    """The weighted score; the lexicon's alone where Naive Bayes knew no token."""
    both = DEFAULT.nb_weight * nb + DEFAULT.lexicon_weight * lex
    return both if matched is None else F.when(matched == 0, lex).otherwise(both)


def by_mode(nb: Column, lex: Column, matched: Column, text: Column, mode: str | Column = "hybrid") -> Column:
    """The deciding score of a mode; an unknown one is hybrid. With nothing matched, the hybrid mode rests on the lexicon alone."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "nb", nb).when(mode == "lexicon", lex).otherwise(t.let(blended(nb, lex, matched), lambda x: guarded(x, text)))


def guarded(score: Column, text: Column, mode: str = "hybrid", english: Column | None = None, distress: Column | None = None) -> Column:
    """The policy on blended scores over the threshold: 0 for texts not in English, less for distress about oneself. Single scorers are left alone. english and distress, if known, spare a look at the text."""
    if mode in ("nb", "lexicon"):
        return score
    english, distress = t.looks_english(text) if english is None else english, t.self_distress(text) if distress is None else distress
    return F.when((score >= DEFAULT.threshold) & ~english, 0.0).when((score >= DEFAULT.threshold) & distress, score * DEFAULT.distress_factor).otherwise(score)


def predicted(score: Column) -> Column:
    return (score >= DEFAULT.threshold).cast("int")


def listed(text: Column, words: list[str]) -> Column:
    """Whether the raw text holds one of the words, in any case, inside others too."""
    low, test = F.lower(text), F.lit(False)
    for w in words:
        test = test | F.contains(low, F.lit(w.lower()))
    return test


def verdict(text: Column, score: Column, blocklist: list[str], whitelist: list[str]) -> Column:
    """Which rule decides: the blocklist, then the whitelist, then the score."""
    return F.when(listed(text, blocklist), "blocked").when(listed(text, whitelist), "exempt").when(score >= DEFAULT.threshold, "aggressive").otherwise("safe")


def live_scores(units: DataFrame, model: DataFrame | None, key: list[str], blocklist: list[str] | None = None, whitelist: list[str] | None = None) -> DataFrame:
    """key, text, listed, cut, lex, matched, nb of batch rows, as a live scan finds them.

    The raw text goes through the blocklist, then the whitelist: listed says blocked or exempt, and such rows have no
    scores. The others are normalised, cut to the first 128 words and scored by both scorers. Without a model Naive Bayes
    gives 0.5 and counts as having matched. Null texts have no row; key must tell rows apart.
    """
    block, white = v.BLOCKLIST if blocklist is None else blocklist, v.WHITELIST if whitelist is None else whitelist
    text = F.col("text")
    d = units.where("text is not null").select(*key, "text", F.when(listed(text, block), "blocked").when(listed(text, white), "exempt").alias("listed"))
    ruled = d.where("listed is not null")
    rest = score_lexicon(d.where("listed is null").select(*key, "text", t.first_words(n.normalise(text)).alias("cut")), "cut")
    if model is None:
        rest = rest.withColumn("matched", F.lit(1).cast("long")).withColumn("nb", F.lit(0.5))
    else:
        rest = stored(rest.select(*key, "text", "cut", "lex"), "scored")  # normalised once
        rest = rest.join(dampened_nb(rest.select(*key, "cut"), model, key, "cut"), key)
    return ruled.unionByName(rest.select(*key, "text", "cut", "lex", "matched", "nb"), allowMissingColumns=True)


def decided(scores: DataFrame, key: list[str], mode: str | Column = "hybrid") -> DataFrame:
    """key, text, verdict, score, flagged, error of live_scores: blocked rows score 1, exempt ones have no score, the policy of the mode decides on the others. A text whose normalisation failed is safe, and error says so."""
    score = by_mode(F.col("nb"), F.col("lex"), F.col("matched"), F.col("cut"), mode)
    d = scores.withColumn("score", F.when(F.col("listed") == "blocked", 1.0).when(F.col("listed").isNull(), score))
    verdict = F.when(F.col("listed").isNotNull(), F.col("listed")).when(F.col("score") >= DEFAULT.threshold, "aggressive").otherwise("safe")
    d = d.withColumn("verdict", verdict).withColumn("error", F.when(F.col("listed").isNull() & F.col("cut").isNull(), "normalisation"))
    return d.select(*key, "text", "verdict", "score", F.col("verdict").isin("blocked", "aggressive").cast("int").alias("flagged"), "error")


def live_verdicts(units: DataFrame, model: DataFrame | None, key: list[str], mode: str = "hybrid", **lists) -> DataFrame:
    """key, text, verdict, score, flagged, error of batch rows by the whole order of a live scan."""
    return decided(live_scores(units, model, key, **lists), key, mode)
