"""Toxicity by compression distance to two dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent

WORD = re.compile(r"\w+")
#: Set off each word, in dictionaries and in windows, so that a match can span a short word whole. These bytes occur in no UTF-8 text.
START, END = b"\xff", bytes([0xF8, 0xF9, 0xFA, 0xFB, 0xFC, 0xFD, 0xFE, 0xC0, 0xF8, 0xFA, 0xFC, 0xFE, 0xF9, 0xFB, 0xFD, 0xC1])
WINDOW = 64
BEGINNINGS = (4,)
REMEMBERED = 400_000
#: Words in both dictionaries. Longer ones make zstd's match search miss words.
COMMON = 200


def units(word: str) -> list[str]:
    """A word and, marked as such, its beginnings: what inflects a stem."""
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) > n)]


def windows(text: str) -> set[bytes]:
    """The different windows of a whole text: its words in lower case, those over 64 bytes cut, and their beginnings."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        b = w.encode()
        out.update([b] if len(b) <= WINDOW else (b[i : i + WINDOW] for i in range(0, len(b), WINDOW)))
        out.update([x.encode() for x in units(w)[1:]])
    return out


def _content(words: list[str]) -> bytes:
    return b"".join(START + w.encode() + END for w in words)


@dataclass
class Model:
    """Two dictionaries with a common part, the usual length of a wholly matched window, and a calibration."""

    common: list[str]
    toxic: list[str]
    ordinary: list[str]
    weights: tuple[float, ...] = ()

    def compressor(self, own: list[str]):
        import zstandard as z

        p = z.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, strategy=z.STRATEGY_LAZY2, min_match=4, window_log=18, hash_log=16, chain_log=16, search_log=5)
        d = z.ZstdCompressionDict(_content(self.common) + _content(own), dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return z.ZstdCompressor(dict_data=d, compression_params=p)

    def distances(self) -> Distances:
        return Distances(self.compressor(self.toxic), self.compressor(self.ordinary), self.toxic)

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(features @ w[1:] + w[0], -30, 30)))


class Distances:
    """Compression distance of windows: how much shorter the toxic dictionary makes them, less what of them it leaves unmatched."""

    def __init__(self, toxic, ordinary, words: list[str]):
        self.toxic, self.ordinary, self.known = toxic, ordinary, {}
        self.least = int(np.median([len(toxic.compress(START + w.encode() + END)) for w in words])) if words else 0

    def of(self, window: bytes) -> int:
        d = self.known.get(window)
        if d is None:
            x = START + window + END
            t = len(self.toxic.compress(x))
            d = len(self.ordinary.compress(x)) - t - (t - self.least)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[window] = d
        return d

    def features(self, text: str) -> tuple[float, float, float]:
        """The two largest distances of a text (at least -8, at most 24), and the log of how many are over 2."""
        d = sorted(map(self.of, windows(text)), reverse=True)
        top = [min(24, max(-8, x)) for x in [*d[:2], -8, -8][:2]]
        return top[0], top[1], float(np.log1p(sum(x > 2 for x in d)))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of a few rows, so that few texts are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _features(docs: DataFrame, model: Model, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = model.distances()
        for b in pieces(batches):
            f = np.array([d.features(x or "") for x in b.column(1).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in f.T), pa.array(model.score(f))], ["key", "f1", "f2", "f3", "score"])

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {dict(docs.dtypes)[key]}, f1 double, f2 double, f3 double, score double")


def held_out(key: str = "doc_id", folds: int = 5):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Where the sample's F1 is best; halfway to the next lower score."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[np.append(s[1:] == s[:-1], False)] = -1
    i = int(f1.argmax())
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, words: int = 3000, least: int = 7, folds: int = 5) -> Model:
    """Learn from labelled documents outside the held-out fold.

    sample: at most so many toxic rows and three times as many others, by hash of their doc_id (a bounded fit; 12,000 short
    identifiers are broadcast). A word, or a beginning of words, counts once for each word that stands before it, so that
    copies of a document count as one. The toxic dictionary's own part holds the words that at
    least `least` words precede in toxic texts and that are twenty times as frequent there; the
    other dictionary's own part holds as many ordinary words, and both begin with the most common
    ones; each holds at most `words` of them, and training passes over words of more than 64 characters.
    Features of the sample fit a logistic curve and its threshold. Without toxic or ordinary
    rows, as with empty tables, every score is 0. Null labels and doc_ids are left out; of contradictory labels the
    higher counts, of several texts of a doc_id the smallest.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id", folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    picked = [known.where(F.col("toxic") == y).orderBy(F.crc32(F.concat(F.lit("s"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(sample * (3 - 2 * y)) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").where("text is not null")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = WORD.findall(text.lower())
                seen = list(dict.fromkeys((u, p) for p, x in zip(["", *w], w, strict=False) if len(x) <= WINDOW for u in units(x)))
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(seen), pa.int32()), pa.array([x for x, _ in seen]), pa.array([p for _, p in seen])], ["y", "word", "after"])

    p = rows.select("toxic", "text").mapInArrow(pairs, "y int, word string, after string").select("y", "word", F.xxhash64("after").alias("after")).distinct()
    counts = p.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")).cache()
    totals = counts.agg(F.sum("n1"), F.sum("n0")).first()
    t1, t0 = (max(1, x or 0) for x in totals)
    marked = counts.where(F.col("n1") >= least).where((F.col("n1") + 0.5) / t1 > 20 * (F.col("n0") + 0.5) / t0)
    toxic = most_frequent(marked, "word", "n1", words)[::-1]
    common = most_frequent(counts.where("n0 > 0"), "word", "n0", COMMON + words)
    counts.unpersist()
    model = Model(common[:COMMON][::-1], toxic, common[COMMON:][: len(toxic)][::-1])
    if not toxic:
        return model
    sampled = _features(rows.withColumn("key", F.col("toxic")), model, "key").toPandas()
    x, y = sampled[["f1", "f2", "f3"]].to_numpy(), sampled["key"].to_numpy(float)
    if y.min() == y.max():
        return model
    w = _logistic(x, y)
    at = _threshold(np.column_stack([np.ones(len(x)), x]) @ w, y)
    model.weights = (float(w[0] - at), *map(float, w[1:]))
    return model


def classify(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, in one pass without a shuffle.

    Null and empty texts get the score of a text without windows. Repeated rows are each scored;
    other columns are not read.
    """
    s = _features(docs, model, "doc_id").withColumnRenamed("key", "doc_id")
    return s.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is not predicted toxic."""
    i, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = model.distances()
        for b in pieces(batches):
            f = np.array([d.features(x or "") for x in b.column(i).to_pylist()], float).reshape(-1, 3)
            yield b.filter(pa.array(model.score(f) < 0.5))

    return docs.mapInArrow(run, schema)
