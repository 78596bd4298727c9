"""Word lists kept as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(word: Column) -> Column:
    return F.lower(F.trim(word))


def added(words: Column, word: Column) -> Column:
    return F.when((tidy(word) == "") | F.array_contains(words, tidy(word)), words).otherwise(F.array_append(words, tidy(word)))


def removed(words: Column, word: Column) -> Column:
    return F.array_remove(words, tidy(word))


def moved(white: Column, block: Column, word: Column) -> tuple[Column, Column, Column]:
    """(whitelist, blocklist, outcome) after a word is put on the blocklist: exists, moved or added."""
    w = tidy(word)
    outcome = F.when(F.array_contains(block, w), "exists").when(F.array_contains(white, w), "moved").otherwise("added")
    return F.array_remove(white, w), added(block, word), outcome


def allowed(white: Column, block: Column, word: Column) -> Column:
    """The whitelist after a word is added to it, unless it is blocked."""
    return F.when(F.array_contains(block, tidy(word)), white).otherwise(added(white, word))


def found(words: Column, part: Column) -> Column:
    return F.filter(words, lambda x: F.contains(x, tidy(part)))
