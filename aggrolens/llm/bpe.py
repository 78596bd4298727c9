"""BPE encoding and decoding with forced boundaries."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fragments that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
OTHER_SPACE = re.compile(r"[^\S \n]")


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 characters are themselves, the others follow from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def inner_pairs(tokenizer_file: str) -> set[tuple[int, int]]:
    """Pairs of bytes that stand side by side inside some token of the vocabulary, but for those whose first byte ends a white-space character there."""
    of = byte_symbols()
    with open(tokenizer_file, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pairs = set()
    for token in vocab:
        t = bytes(of[x] for x in token if x in of)
        pairs |= {(t[i], t[i + 1]) for i in range(len(t) - 1) if not ends_in_space(t[: i + 1])}
    return pairs


def ends_in_space(t: bytes) -> bool:
    return any(t[-n:].decode(errors="replace").isspace() for n in (1, 2, 3) if n <= len(t))


def fragment_pattern(inner: set[tuple[int, int]]) -> re.Pattern:
    """Matches the fragments of a text.

    A cut lies before an ASCII space, tab or newline that follows a character that isn't white
    space, if no token holds any non-space byte followed by that byte. No merge crosses such a
    pair, and the splitting pattern of byte-level BPE has a boundary there too, since it takes
    white space only at the start of a piece and looks ahead from white space alone. Added tokens
    hold no white space. So fragments can be encoded one by one.
    """
    cuts = [c for c in (0x20, 0x0A, 0x09) if not any(b == c for _, b in inner)]
    if not cuts:
        return re.compile(r"(?s).+")
    c = "".join(map(re.escape, map(chr, cuts)))
    return re.compile(rf"\s*\S+(?:(?![{c}])\s+\S+)*(?:(?![{c}])\s+\Z)?|\s+")


def letter_cuts(inner: set[tuple[int, int]]) -> set[str]:
    """Pairs of Latin letters, or of a letter and one of the marks .,;:!?()*#%$, whose bytes no token joins.

    A run of letters is one piece of the splitting pattern, and a run of marks another, so that
    either side of such a cut is split as it was in the whole.
    """
    letters = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha()]
    return {a + b for a in letters for b in [*letters, *".,;:!?()*#%$"] if (a.encode()[-1], b.encode()[0]) not in inner}


class Codec:
    """Encodes and decodes texts with a tokenizers file, fragment by fragment."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        inner = inner_pairs(tokenizer_file)
        self.pattern, self.cuts = fragment_pattern(inner), letter_cuts(inner)
        self.plain = all(self.pattern.findall(f"a{c}a") == ["a", f"{c}a"] for c in " \n")
        self.known: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.after_space: dict[str, str] = {}

    def pieces(self, fragment: str) -> list[str]:
        """A fragment cut between letters, or a letter and a mark after it, that no token joins."""
        out, at, cuts = [], 0, self.cuts
        for i in range(1, len(fragment)):
            if fragment[i - 1 : i + 1] in cuts:
                out.append(fragment[at:i])
                at = i
        out.append(fragment[at:])
        return out

    def learn(self, fragments: list[str]) -> None:
        """Remember the ids (comma-joined) of fragments, and their decoded form where it differs."""
        cut = {x: self.pieces(x) for x in fragments if x not in self.known}
        new = list({p for ps in cut.values() for p in ps if p not in self.known})
        if new:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.known.update(zip(new, [",".join(map(str, i)) for i in ids], strict=True))
            decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            self.odd.update((x, d) for x, d in zip(new, decoded, strict=True) if x != d)
        for x, ps in cut.items():
            if len(ps) > 1:
                self.known[x] = ",".join([self.known[p] for p in ps])
                if self.odd and any(p in self.odd for p in ps):
                    self.odd[x] = "".join([self.odd.get(p, p) for p in ps])

    def simple_parts(self, text: str) -> list[str] | None:
        """The fragments of a text whose white space is single spaces and newlines between words; those after the first without their leading space (a newline stays). None for other texts."""
        if not self.plain or OTHER_SPACE.search(text):
            return None
        parts = text.replace("\n", " \n").split(" ")
        return None if "" in parts or "\n" in parts else parts

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        for text in texts:
            if len(self.known) > REMEMBERED:
                self.known, self.odd, self.after_space = {}, {}, {}
            parts = self.simple_parts(text)
            if parts:
                first, *rest = parts
                missing = [x for x in set(rest) if x not in self.after_space]
                whole = [x if x[0] == "\n" else " " + x for x in missing]
                self.learn([first, *whole])
                self.after_space.update((x, self.known[w]) for x, w in zip(missing, whole, strict=True))
                ids = ",".join([self.known[first], *map(self.after_space.__getitem__, rest)])
                parts = self.pattern.findall(text) if self.odd else ()
            else:
                parts = self.pattern.findall(text)
                self.learn(parts)
                ids = ",".join(map(self.known.__getitem__, parts))
            yield ids, "".join([self.odd.get(x, x) for x in parts]) if self.odd else text


@lru_cache(1)
def codec_of(tokenizer_file: str) -> Codec:
    """The codec that a worker keeps from task to task."""
    return Codec(tokenizer_file)


def encode(docs: DataFrame, tokenizer_file: str, digests: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token ids of every whole text, and what they decode to.

    digests: return n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256;
    else n_tokens, ids (array of int) and decoded. One pass over the rows, no shuffle; a worker
    holds a batch of texts and a bounded memory of fragments. Null and empty texts have no tokens.
    Repeated rows are each encoded; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                rows = list(codec.encode([x or "" for x in b.column(1).to_pylist()]))
                n = pa.array([i.count(",") + 1 if i else 0 for i, _ in rows], pa.int64())
                if digests:
                    sha = lambda k: pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string())  # noqa: B023, E731
                    out = [sha(0), sha(1)]
                else:
                    out = [pa.array([[int(x) for x in i.split(",")] if i else [] for i, _ in rows], pa.list_(pa.int32())), pa.array([d for _, d in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), n, *out], ["doc_id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kinds = ("string", "string") if digests else ("array<int>", "string")
    key_type = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"doc_id {key_type}, n_tokens long, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}")
