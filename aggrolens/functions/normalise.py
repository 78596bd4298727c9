"""Undoing disguised spelling. Unicode work that SQL functions lack, in one Arrow function."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v

# Look-alike characters and the letters that they stand for, in disguised words and between separators; marks that hide a letter; characters that show nothing.
LOOKS = {"0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "\u0430": "a", "\u0435": "e", "\u0456": "i", "\u043e": "o", "\u0455": "s", "\u0442": "t", "\u03c5": "u", "\u0441": "c", "\u0440": "p", "\u0445": "x", "\u0443": "y"}
HIDERS = "*#_"
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]")
#: Most letters between the ends of a disguised word and of a plain slip; the valence from which a word counts as harsh.
DISGUISED_MOST, PLAIN_MOST, HARSH = 38, 18, -2.0
#: A letter or digit, and no letter or digit before or after.
SIGN = r"[^\W_]"
START, END = rf"(?<!{SIGN})", rf"(?!{SIGN})"
MARK = re.compile("[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u0900-\u0903\u093a-\u094f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
MARKED = re.compile(rf"\w+(?:{MARK.pattern}\w*)+")
DISGUISED = re.compile(rf"{START}{SIGN}[\w!*#@$]{{1,{DISGUISED_MOST}}}{SIGN}{END}")
PLAIN = re.compile(rf"{START}[a-z][a-z*#_]{{2,{PLAIN_MOST}}}[a-z]{END}", re.I)
REPEATED = re.compile(r"([a-z])\1+")
#: Texts that a worker turns into Python strings at once.
PIECE = 500


@lru_cache(1)
def harsh_words() -> tuple[str, ...]:
    """Words that disguises are recovered to, the longest first."""
    return tuple(sorted((w for w, x in v.LEXICON.items() if x <= HARSH and len(w) >= 4), key=lambda w: (-len(w), w)))


def variants(word: str) -> set[str]:
    """Spellings that a slip or a dodge makes of a word: neighbours swapped (from five letters), an inner letter left out (from six), its vowels left out."""
    out = {"".join(c for c in word if c not in "aeiou")}
    if len(word) >= 5:
        out |= {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    if len(word) >= 6:
        out |= {word[:i] + word[i + 1 :] for i in range(1, len(word) - 1)}
    return {x for x in out if x != word and len(x) >= 4 and x not in v.LEXICON and x not in v.RECOVERY_SAFE}


@lru_cache(1)
def recovery() -> dict[str, set[str]]:
    """Each variant and the words that it may stand for."""
    out: dict[str, set[str]] = defaultdict(set)
    for w in harsh_words():
        for x in variants(w):
            out[x].add(w)
    return dict(out)


@lru_cache(1)
def _by_length() -> dict[int, list[str]]:
    out: dict[int, list[str]] = defaultdict(list)
    for w in harsh_words():
        out[len(w)].append(w)
    return out


def only(candidates: Collection[str]) -> str | None:
    return next(iter(candidates)) if len(candidates) == 1 else None


def unmasked(token: str) -> str | None:
    """The one harsh word of the same length that a token with hidden inner letters fits. Both ends and two letters at least must show."""
    if len(token) < 5 or token[0] in HIDERS or token[-1] in HIDERS or not any(c in HIDERS for c in token):
        return None
    if not all("a" <= c <= "z" or c in HIDERS for c in token) or sum(c not in HIDERS for c in token) < 2:
        return None
    return only([w for w in _by_length().get(len(token), []) if all(c in HIDERS or c == x for c, x in zip(token, w, strict=True))])


def respelled(token: str) -> str:
    """A lower-case token, or the harsh word that it is a known slip, an unambiguous variant or a masked form of."""
    if token in v.LEXICON or token in v.RECOVERY_SAFE:
        return token
    return v.ABUSE_TYPOS.get(token) or only(recovery().get(token, ())) or unmasked(token) or token


@lru_cache(1)
def respellable() -> frozenset[str]:
    """Unmasked tokens that respelled() makes, or leaves, a lexicon word."""
    return frozenset([*v.LEXICON, *v.ABUSE_TYPOS, *(x for x, words in recovery().items() if len(words) == 1)])


def folded(token: str) -> str:
    """A token in plain letters: marks dropped, look-alikes replaced."""
    return "".join(LOOKS.get(c, c) for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))


def cased(word: str, like: str) -> str:
    return word.upper() if like == like.upper() and any(c.isupper() for c in like) else word


@lru_cache(1 << 16)
def revealed(token: str) -> str:
    """The one harsh word that a disguised token stands for, or the token itself."""
    low = token.lower()
    if low in v.LEXICON or low in v.RECOVERY_SAFE:
        return token
    plain = low
    if not low.isascii() or not low.isalpha():
        plain = folded(low)
    elif low not in respellable() and REPEATED.sub(r"\1", low) not in respellable():
        return token
    found = {respelled(x) for x in (low, plain, REPEATED.sub(r"\1", plain))}
    word = only({w for w in found if v.LEXICON.get(w, 0) <= HARSH and (len(w) >= 4 or w in v.SHORT_ABUSE)})
    return cased(word, token) if word else token


@lru_cache(1)
def separators() -> str:
    """Up to four blanks, punctuation marks or symbols, as a pattern. Planes from the second on have none."""
    points = [i for i in range(0x20000) if unicodedata.category(chr(i))[0] in "PS"]
    starts = [i for i, p in zip(range(len(points)), points, strict=True) if i == 0 or points[i - 1] != p - 1]
    ranges = [(points[a], points[z - 1]) for a, z in zip(starts, [*starts[1:], len(points)], strict=True)]
    return "[ " + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in ranges) + "]{0,4}"


def _looks(letter: str) -> str:
    return f"[{letter}{re.escape(''.join(c for c, x in LOOKS.items() if x == letter))}]+"


def _branches(words: list[str], at: int) -> str:
    """What may follow `at` common letters of some words: their next letters, each with its own branches, and the end if a word is over."""
    nexts: dict[str, list[str]] = defaultdict(list)
    for w in words:
        nexts[w[at] if len(w) > at else ""].append(w)
    forms = [(separators() if at else "") + _looks(c) + _branches(ws, at + 1) for c, ws in sorted(nexts.items()) if c]
    return "(?:" + "|".join(forms + ([END] if "" in nexts else [])) + ")"


@lru_cache(1)
def separated() -> tuple[re.Pattern, dict[str, str]]:
    """One pattern of all harsh words with repeated letters, look-alikes and up to four separators between letters, the longest first; and each word by its letters without repetitions."""
    words = [*harsh_words(), *v.SHORT_ABUSE]
    return re.compile(START + _branches(words, 0)), {REPEATED.sub(r"\1", w): w for w in words}


#: Where letters kept apart may start: a whole run of letters and digits, or a sign that stands for a letter.
RUN = re.compile(rf"{SIGN}+|[{re.escape(''.join(c for c in LOOKS if not c.isalnum()))}]")


@lru_cache(1)
def beginnings() -> frozenset[str]:
    """What harsh words without repeated letters start with."""
    return frozenset(w[:i] for w in separated()[1] for i in range(1, len(w) + 1))


@lru_cache(1 << 16)
def begins(run: str) -> bool:
    """Whether a harsh word with separators may start with a run: no separator can stand in it, so all of it must be the word's first letters."""
    return REPEATED.sub(r"\1", "".join(LOOKS.get(c, c) for c in run)) in beginnings()


def joined(text: str) -> str:
    """The text with harsh words whose letters stand apart, repeat or have look-alikes put together. The pattern is tried only where a run can begin a word."""
    low = text.lower()
    if len(low) != len(text):  # lower case of a few letters is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    pattern, words = separated()
    out, at, past = [], 0, 0
    for run in RUN.finditer(low):
        if run.start() < past or not begins(run[0]) or not (m := pattern.match(low, run.start())):
            continue
        past = m.end()
        letters = "".join(x for x in (LOOKS.get(c, c) for c in m[0]) if x.isalpha())
        word = words.get(REPEATED.sub(r"\1", letters))
        if word and word != m[0]:
            out += [text[at : m.start()], cased(word, text[m.start() : m.end()])]
            at = m.end()
    return "".join([*out, text[at:]])


@lru_cache(1 << 16)
def _typed(token: str) -> str:
    if token.isalpha() and token.lower() not in respellable():
        return token
    word = respelled(token.lower())
    return token if word == token.lower() else cased(word, token)


v.FORGOTTEN += [f.cache_clear for f in (harsh_words, recovery, _by_length, respellable, revealed, separated, beginnings, begins, _typed)]


def changed(text: str, pattern: re.Pattern, change: Callable[[str], str]) -> str:
    """The text with its matches of pattern changed. Each different one is looked at once, and most texts hold none that changes."""
    words = {w: x for w in set(pattern.findall(text)) if (x := change(w)) != w}
    return pattern.sub(lambda m: words.get(m[0], m[0]), text) if words else text


def normalised(text: str) -> str:
    """The text with compatibility forms, invisible characters and disguises of harsh words undone; other words stay as they are.

    Disguised words first, then letters kept apart by separators (the longest word wins), then plain slips of the pen.
    """
    plain = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if not plain.isascii() and MARK.search(plain):
        plain = MARKED.sub(lambda m: revealed(m[0]), plain)
    return changed(joined(changed(plain, DISGUISED, revealed)), PLAIN, _typed)


def _or_none(text: str) -> str | None:
    try:
        return normalised(text)
    except (ValueError, UnicodeError, RecursionError):
        return None


def normalise(text: Column) -> Column:
    """normalised(), Arrow batch by batch; nulls stay, and a text that can't be normalised becomes one. Keep cheap filters ahead of it. A worker holds PIECE texts at a time as Python strings, whatever a batch has."""

    lexicon = dict(v.LEXICON)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v.use(lexicon)
        for b in batches:
            pieces = [pa.array([x if x is None else _or_none(x) for x in b.slice(i, PIECE).to_pylist()], pa.string()) for i in range(0, len(b), PIECE)]
            yield pa.concat_arrays(pieces) if pieces else b

    return run(text)


def segments(text: str, terms: list[str]) -> list[tuple[str, bool]]:
    """Pieces of a text, in order, and whether each is one of the visible terms (any case; overlapping ones join)."""
    low, spans = text.lower(), []
    for term in {t.lower() for t in terms if t}:
        at = low.find(term)
        while at >= 0:
            spans.append((at, at + len(term)))
            at = low.find(term, at + 1)
    out, at = [], 0
    for a, z in sorted(spans):
        if a > at:
            out.append((text[at:a], False))
        if z > at:
            start = max(a, at)
            if out and out[-1][1] and start == at:
                out[-1] = (out[-1][0] + text[start:z], True)
            else:
                out.append((text[start:z], True))
            at = z
    return out + ([(text[at:], False)] if at < len(text) else [])


def mask_segments(text: Column, terms: list[str]) -> Column:
    @F.pandas_udf("array<struct<text:string,visible:boolean>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: None if x is None else [{"text": a, "visible": s} for a, s in segments(x, terms)])

    return run(text)
