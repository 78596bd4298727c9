"""Quality of texts by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- what of a text is looked at ---------------------------------------------------------------

LETTER, UPPER, DIGIT, STOP, SHOUT, SYMBOL, BREAK, SPACE = range(8)
FEATURES = [
    "log_words", "word_length", "upper", "digits", "stops", "shouts", "symbols", "breaks", "capitals",
    "short_words", "distinct_words", "distinct_pairs", "repeated_neighbours", "commonest_word", "distinct_lines",
]


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        out[i] = UPPER if c in ("Lu", "Lt") else LETTER if c[0] in "LM" else DIGIT if c[0] == "N" else SPACE if c[0] == "Z" else SYMBOL
    for chars, kind in ((".,;:", STOP), ("!?", SHOUT), ("\n\r\x0b\x0c", BREAK), ("\t", SPACE)):
        out[[ord(c) for c in chars]] = kind
    return out


def features(text: str) -> list[float]:
    """The FEATURES of a whole text; without words all are 0 but those of its characters."""
    n = np.bincount(kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=8)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, chars = max(len(words), 1), max(len(text), 1)
    count, letters = Counter(words), max(n[LETTER] + n[UPPER], 1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(words)), letters / w, n[UPPER] / letters, n[DIGIT] / chars, n[STOP] / w, n[SHOUT] / w, n[SYMBOL] / w, n[BREAK] / w, sum(k for x, k in count.items() if x[0].isupper()) / w,
        sum(k for x, k in count.items() if len(x) <= 3) / w, len(count) / w, pairs / max(w - 1, 1), sum(map(str.__eq__, words, words[1:])) / w, max(count.values(), default=0) / w, len(set(lines)) / max(len(lines), 1),
    ]


# --- the model ---------------------------------------------------------------------------------


@dataclass
class Model:
    """A base score, a table per feature and one per pair of features; the tables' axes are bins cut at edges."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of rows of features: the tables' entries of their bins, added."""
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for (j, k), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.coarse[j], x[:, j], "right"), np.searchsorted(self.coarse[k], x[:, k], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges between at most `bins` bins of about equally many values; a frequent value has a bin of its own."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


class Boosting:
    """Logistic boosting of tables, one at a time in turn, by shallow trees over their bins."""

    def __init__(self, y: np.ndarray, base: float, rate: float, ridge: float, least: int):
        self.y, self.total, self.rate, self.ridge, self.least = y, np.full(len(y), base), rate, ridge, least

    def slopes(self) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(self.total, -30, 30)))
        return self.y - p, p * (1 - p)

    def sums(self, cells: np.ndarray, shape: tuple[int, ...], rows: np.ndarray) -> np.ndarray:
        """Slopes, curvatures and numbers of rows per bin."""
        g, h = self.slopes()
        size = int(np.prod(shape))
        return np.stack([np.bincount(cells[rows], v[rows], size).reshape(shape) for v in (g, h, np.ones(len(g)))])

    def best_cut(self, s: np.ndarray) -> tuple[float, int]:
        """Gain and place of the best cut of bins s (3 by bins) in two; place 0: none."""
        left = np.cumsum(s, axis=1)[:, :-1]
        right = s.sum(axis=1)[:, None] - left
        whole = s[0].sum() ** 2 / (s[1].sum() + self.ridge)
        gain = left[0] ** 2 / (left[1] + self.ridge) + right[0] ** 2 / (right[1] + self.ridge) - whole
        gain = np.where((left[2] >= self.least) & (right[2] >= self.least), gain, 0)
        return (float(gain.max()), int(gain.argmax()) + 1) if gain.size and gain.max() > 0 else (0.0, 0)

    def leaf(self, s: np.ndarray) -> float:
        return self.rate * s[0].sum() / (s[1].sum() + self.ridge)

    def line(self, s: np.ndarray) -> np.ndarray:
        """A tree of up to three leaves over the bins of one feature."""
        _, at = self.best_cut(s)
        spans = [(0, at), (at, s.shape[1])] if at else [(0, s.shape[1])]
        gain, more, span = max(((*self.best_cut(s[:, a:z]), (a, z)) for a, z in spans if z > a), default=(0, 0, None))
        if gain > 0 and at:
            spans = [x for x in spans if x != span] + [(span[0], span[0] + more), (span[0] + more, span[1])]
        out = np.zeros(s.shape[1])
        for a, z in spans:
            out[a:z] = self.leaf(s[:, a:z])
        return out

    def quadrants(self, s: np.ndarray) -> tuple[float, np.ndarray]:
        """The best cut of a grid (3 by bins by bins) along one side, each part cut along the other: gain, and the values."""
        best = (0.0, np.zeros(s.shape[1:]))
        for turned in (False, True):
            t = s.transpose(0, 2, 1) if turned else s
            left = np.cumsum(t, axis=1)
            for at in range(1, t.shape[1]):
                out, gain = np.zeros(t.shape[1:]), 0.0
                for part, sums in ((slice(0, at), left[:, at - 1]), (slice(at, None), left[:, -1] - left[:, at - 1])):
                    more, cut = self.best_cut(sums)
                    gain += more
                    for a, z in [(0, cut), (cut, None)] if cut else []:
                        out[part, a:z] = self.leaf(sums[:, a:z])
                if gain > best[0]:
                    best = (gain, out.T if turned else out)
        return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 12, n_pairs: int = 6, rounds: int = 150, rate: float = 0.1, ridge: float = 1.0, least: int = 10) -> Model:
    """Tables by cyclic boosting: each round adds a tree of up to three leaves to every feature's table; then the pairs whose residuals a grid explains best get tables in the same way.

    A seventh of the rows measures; boosting stops when that has got no better for fifteen rounds.
    """
    if not len(y) or y.min() == y.max():
        return Model(30.0 * (2 * float(y[0]) - 1) if len(y) else 0.0, [np.array([])] * x.shape[1], [np.zeros(1)] * x.shape[1])
    check = np.arange(len(y)) % 7 == 6
    rows, tests = np.flatnonzero(~check), np.flatnonzero(check)
    share = np.clip(y[rows].mean(), 0.001, 0.999)
    m = Model(float(np.log(share / (1 - share))), [cut_points(x[:, j], bins) for j in range(x.shape[1])], [])
    m.coarse = [cut_points(x[:, j], coarse_bins) for j in range(x.shape[1])]
    fine = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(m.edges)]
    rough = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(m.coarse)]
    b = Boosting(y, m.base, rate, ridge, least)

    def loss() -> float:
        return float(np.logaddexp(0, np.where(y[tests] == 1, -1, 1) * b.total[tests]).mean()) if len(tests) else 0.0

    def boosted(cells: list[np.ndarray], shapes: list[tuple[int, ...]], tree) -> list[np.ndarray]:
        tables = [np.zeros(s) for s in shapes]
        best, kept, since = loss(), ([t.copy() for t in tables], b.total.copy()), 0
        for _ in range(rounds):
            for c, t, s in zip(cells, tables, shapes, strict=True):
                step = tree(b.sums(c, s, rows))
                t += step
                b.total += step.reshape(-1)[c]
            since += 1
            if (now := loss()) < best - 1e-6 or not len(tests):
                best, kept, since = now, ([t.copy() for t in tables], b.total.copy()), 0
            if since >= 15:
                break
        b.total = kept[1]
        return kept[0]

    m.tables = boosted(fine, [(len(c) + 1,) for c in m.edges], b.line)
    grid = lambda j, k: (len(m.coarse[j]) + 1, len(m.coarse[k]) + 1)
    cell = lambda j, k: rough[j] * (len(m.coarse[k]) + 1) + rough[k]
    gains = {p: b.quadrants(b.sums(cell(*p), grid(*p), rows))[0] for p in itertools.combinations(range(x.shape[1]), 2)}
    m.pairs = sorted((p for p, g in gains.items() if g > 0), key=lambda p: (-gains[p], p))[:n_pairs]
    m.grids = boosted([cell(*p) for p in m.pairs], [grid(*p) for p in m.pairs], lambda s: b.quadrants(s)[1])
    return m


# --- on frames ---------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id's decimal text, modulo folds, is fold; not so of a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> Model:
    """A model of at most `most` labelled documents outside the held-out fold, the first by a hash of their ids; it is fit at the driver on their features, a few numbers each.

    Ids with labels that differ or are null are left out; of a repeated doc_id one text counts, null texts are empty.
    """
    sure = labels.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_most"), F.count_if(F.col("quality").isNull()).alias("_none"))
    sure = sure.where("doc_id is not null and y = _most and _none = 0 and y in (0, 1)").select("doc_id", "y")
    known = docs.select(F.col("doc_id").alias("_id"))
    picked = sure.join(known, F.col("doc_id") == F.col("_id"), "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # `most` rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [features(t or "") for t in b["text"]]})

    got = texts.mapInPandas(run, "doc_id long, y int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r["y"]) for r in got]))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text alone; null texts count as empty. Null and repeated ids keep a row each; an empty table gives none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "score": sent.value.score(np.array([features(t or "") for t in b["text"]]))})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
