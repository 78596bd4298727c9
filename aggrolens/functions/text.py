"""Column expressions on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT
from . import vocab as v

SPACES = r"(?U)\s+"


def strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def numbers(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def praise() -> list[str]:
    return [w for w, x in v.LEXICON.items() if x > 0]


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x made once, however often body uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def any_in(words: Column, known: list[str]) -> Column:
    """Whether an array holds one of the known words, by a hash set."""
    return F.exists(words, lambda w: w.isin(known))


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def content_tokens(text: Column) -> Column:
    """Lower-case letter runs of two letters or more, without stop words."""
    return F.filter(letter_words(text), lambda t: (F.length(t) > 1) & ~t.isin(v.STOP_WORDS))


def live_words(text: Column) -> Column:
    """Words of a text, of their letters alone. What is neither a letter nor a blank goes first, beyond ASCII by a look at such characters only; blanks are all that then parts letters."""
    low = F.regexp_replace(F.lower(text), r"[\x00-\x08\x0e-\x1f!-`{-\x7f]+", "")
    plain = let(low, lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.regexp_replace(x, rf"[^\x00-\x7f](?<![{v.BLANKS}])", "")).otherwise(x))
    return F.filter(F.split(plain, "[^a-z]+"), lambda w: w != "")


def marked_words(words: Column) -> Column:
    """Tokens of live_words: not_ before those with a negation among the three words before them; no negations, stop words or single letters."""
    kept = lambda w: (F.length(w) > 1) & ~w.isin([x for x in v.STOP_WORDS if x not in ("not", "no")]) & ~w.isin(v.NB_NEGATORS)

    def marks(negations: Column) -> Column:
        near = lambda i: sum((F.coalesce(F.get(negations, i - d), F.lit(False)).cast("int") for d in range(1, DEFAULT.negation_window + 1)), F.lit(0)) > 0
        return F.array_compact(F.transform(words, lambda w, i: F.when(kept(w), F.when(near(i), F.concat(F.lit("not_"), w)).otherwise(w))))

    return F.when(any_in(words, v.NB_NEGATORS), let(F.transform(words, lambda w: w.isin(v.NB_NEGATORS)), marks)).otherwise(F.filter(words, kept))


def live_tokens(text: Column) -> Column:
    """Tokens of a text as met on pages: its marked words, then a cue token for each sarcastic phrase."""
    cues = F.transform(sarcasm_markers(text), lambda m: F.concat(F.lit("cue_"), F.replace(m, F.lit(" "), F.lit("_"))))
    return F.concat(let(live_words(text), marked_words), cues)


def first_words(text: Column, n: int = DEFAULT.max_words) -> Column:
    """The text itself if it has at most n words, else its first n joined by spaces. A leading blank counts as an empty word."""
    words = F.split(text, SPACES)
    return F.when(F.size(words) <= n, text).otherwise(F.array_join(F.slice(words, 1, n), " "))


def looks_english(text: Column) -> Column:
    def judged(words: Column) -> Column:
        share = lambda known: F.size(F.filter(words, lambda w: w.isin(known))) / F.size(words)
        return F.when(F.size(words) < 3, True).when(share(v.TAGALOG) >= DEFAULT.language_ratio, False).otherwise(share(v.ENGLISH) >= DEFAULT.language_ratio)

    return let(F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1)), judged)


def self_distress(text: Column) -> Column:
    """Harsh words that a writer turns on themselves: nobody else is meant and no profanity occurs."""
    others = v.SECOND_PERSON + v.THIRD_PARTY + v.SWEARS + v.PROFANITY

    def judged(low: Column) -> Column:
        return low.rlike(v.SELF) & ~low.rlike(v.SEEN) & let(letter_words(low), lambda words: (F.size(words) > 0) & ~any_in(words, others))

    return let(F.replace(F.lower(text), F.lit("'"), F.lit("")), judged)


def sarcasm_markers(text: Column) -> Column:
    """Sarcastic phrases in a text; some don't count where they are all it says."""

    def held(low: Column) -> Column:
        bare = F.regexp_replace(F.trim(F.regexp_replace(low, r"[!?.,\s]+$", "")), v.LEADING_SUBJECT, "")
        meant = lambda found: F.when(F.size(found) == 0, found).otherwise(let(bare, lambda b: F.filter(found, lambda m: ~(m.isin(v.SINCERE_ALONE) & (b == m)))))
        return let(F.filter(strings(v.SARCASM), lambda m: F.contains(low, m)), meant)

    return let(F.lower(text), held)


def sarcasm_cue(text: Column) -> Column:
    return F.least(F.size(sarcasm_markers(text)) * F.lit(0.5), F.lit(1.0))


def split_slang(text: Column) -> Column:
    """Joined slang taken apart, one word after the other; texts without any, by one look, stay as they are."""
    apart = text
    for joined, words in v.SLANG.items():
        apart = F.regexp_replace(apart, rf"(?i){v.OPENS}{joined}{v.CLOSES}", words)
    return F.when(text.rlike(rf"(?i){v.OPENS}(" + "|".join(v.SLANG) + f"){v.CLOSES}"), apart).otherwise(text)


def lexicon_tokens(text: Column) -> Column:
    """Blank-separated words of their letters, apostrophes and !?. Other characters go from the whole text at once."""
    return F.filter(F.split(F.regexp_replace(text, r"(?U)[^a-zA-Z'!?\s]", ""), SPACES), lambda t: t != "")


def bare(token: Column) -> Column:
    return F.trim(F.lower(token), F.lit("!?"))


def all_caps(token: Column) -> Column:
    return (F.length(token) > 1) & (token == F.upper(token)) & token.rlike("[A-Z]")


def lexicon_hits(tokens: Column, low: Column, lexicon: dict[str, float] = v.LEXICON) -> Column:
    """Lexicon words of a text: pos, word, base, valence, with emphasis, boosters and negation of the three tokens before. tokens and low (the same, bare) should be columns of the frame, so that they are made once."""
    c = DEFAULT
    known, boost = numbers(lexicon), numbers(v.BOOSTERS)
    at = F.when(any_in(low, list(lexicon)), F.array_compact(F.transform(low, lambda w, i: F.when(w.isin(list(lexicon)), i)))).otherwise(F.array().cast("array<int>"))

    def hit(i: Column) -> Column:
        token, word = F.get(tokens, i), F.get(low, i)
        base = F.try_element_at(known, word)
        emphatic = base + F.when(all_caps(token), F.signum(base) * c.caps_step).otherwise(0.0)
        before = lambda d: F.when(i >= d, F.get(low, i - d))
        push = sum((F.coalesce(F.try_element_at(boost, before(d)), F.lit(0.0)) * (1.0 if d == 1 else c.far_booster) for d in (3, 2, 1)), F.lit(0.0))
        negated = F.coalesce(before(1).isin(v.NEGATORS), F.lit(False)) | F.coalesce(before(2).isin(v.NEGATORS), F.lit(False)) | F.coalesce(before(3).isin(v.NEGATORS), F.lit(False))
        value = (emphatic + F.signum(emphatic) * push) * F.when(negated, c.negation_scalar).otherwise(1.0)
        return F.struct((i + 1).alias("pos"), word.alias("word"), base.alias("base"), value.alias("valence"), negated.alias("negated"))

    return F.transform(at, hit)


def compound(text: Column, hits: Column, n_tokens: Column) -> Column:
    """Valence of a text between -1 and 1 from its lexicon hits; exclamation marks push on."""
    c = DEFAULT
    total = F.aggregate(hits, F.lit(0.0), lambda s, h: s + h["valence"])
    marks = F.least(F.regexp_count(text, F.lit("!")), F.lit(c.exclamations_at_most)) * c.exclamation
    total = total + F.when(total >= 0, marks).otherwise(-marks)
    alpha = F.greatest(F.lit(c.alpha_floor), F.least(F.lit(c.alpha_top), n_tokens))
    return F.when(F.size(hits) > 0, total / F.sqrt(total * total + alpha)).otherwise(0.0)


def direct_insult_clause(text: Column) -> Column:
    """The first of a text's contrasted clauses that insults the reader, if there are several; else null."""

    def first(clauses: Column) -> Column:
        insulting = F.filter(clauses, lambda x: x.rlike(v.YOU_ARE) & any_in(letter_words(x), v.INSULTS))
        return F.when(F.size(clauses) > 1, F.get(insulting, F.lit(0)))

    return F.when(text.rlike(v.YOU_ARE) & text.rlike(v.CONTRAST), let(F.filter(F.transform(F.split(text, v.CONTRAST), F.trim), lambda x: x != ""), first))


def corrected(value: Column, cue: Column) -> Column:
    """A compound in the light of sarcasm: praise turns, the rest is pushed a little; within -1 and 1."""
    turned = F.when((cue > 0) & (value > 0), -value - 0.4 * cue).when(cue > 0, value - 0.2 * cue).otherwise(value)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), turned))


def aggression(compound_value: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), -compound_value), 4)
