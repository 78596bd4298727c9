"""How values are shown: numbers, dates, escaped and plain texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with a plain equivalent of their own, for what keeps to ASCII.
PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "→": "->", "•": "-", "·": "-"}


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(share * 100, digits)), F.lit("%"))


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def padded(n: Column, width: int = 3) -> Column:
    """n with leading zeros; longer numbers stay whole."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH-mm")


def escaped(text: Column, quote: str = "&quot;", apostrophe: str | None = None) -> Column:
    """Text for HTML; with an apostrophe's entity also for XML."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', quote)] + ([("'", apostrophe)] if apostrophe else [])
    for c, entity in pairs:
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def to_ascii(text: str) -> str:
    """Typographic signs and accents in plain characters; what is left over is a question mark."""
    for c, plain in PLAIN.items():
        text = text.replace(c, plain)
    text = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", text))
    return re.sub(r"[^\x20-\x7e]", "?", text)


def wrapped(text: str, width: int = 86) -> list[str]:
    """Lines of at most `width` characters; longer words are cut. Blank texts are one empty line."""
    lines, line = [], ""
    for word in to_ascii(text).split():
        while len(word) > width:
            lines += [line] * bool(line) + [word[:width]]
            line, word = "", word[width:]
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return lines + [line] if line or not lines else lines


def wrapped_lines(text: Column, width: int = 86) -> Column:
    """wrapped(), Arrow batch by batch; nulls stay."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: wrapped(x, width), na_action="ignore")

    return run(text)


def host_pattern(pattern: str) -> str:
    """A regular expression for hosts that a manifest pattern like *://*.example.com/* covers; a leading *. also covers the bare host."""
    host = re.sub(r"/\*$", "", re.sub(r"^\*://", "", pattern))
    optional = host.startswith("*.")
    parts = [r"[a-z0-9-]+" if p == "*" else re.escape(p) for p in host.removeprefix("*.").split(".")]
    return "(?i)^" + (r"(?:[a-z0-9-]+\.)?" if optional else "") + r"\.".join(parts) + "$"
