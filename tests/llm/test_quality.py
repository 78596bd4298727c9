"""The additive model: its scores are sums of table entries, its labels come from the training folds, its held-out verdicts are right."""

import bisect
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aggrolens.llm import quality
from aggrolens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def by_hand(m, row):
    total = m.base
    for j, x in enumerate(row):
        total += m.tables[j][bisect.bisect_right(list(m.edges[j]), x)]
    for (j, k), grid in zip(m.pairs, m.grids, strict=True):
        total += grid[bisect.bisect_right(list(m.coarse[j]), row[j])][bisect.bisect_right(list(m.coarse[k]), row[k])]
    return 1 / (1 + math.exp(-total))


def test_additive_and_pairwise():
    r = np.random.default_rng(4)
    x = r.uniform(-1, 1, (4000, 4))
    alone = (x[:, 0] > 0.3).astype(float)
    m = quality.fit(x, alone)
    assert ((m.score(x) > 0.5) == (alone == 1)).mean() > 0.99
    both = ((x[:, 1] > 0) ^ (x[:, 2] > 0)).astype(float)  # no single feature tells
    m = quality.fit(x, both)
    assert m.pairs[0] == (1, 2) and ((m.score(x) > 0.5) == (both == 1)).mean() > 0.95
    flat = quality.fit(x, both, n_pairs=0)
    assert ((flat.score(x) > 0.5) == (both == 1)).mean() < 0.7
    assert np.allclose(m.score(x[:50]), [by_hand(m, row) for row in x[:50]])


def test_little_to_learn_from():
    x = np.zeros((5, 3))
    assert quality.fit(x[:0], np.array([])).score(x).tolist() == [0.5] * 5
    assert (quality.fit(x, np.ones(5)).score(x) > 0.99).all() and (quality.fit(x, np.zeros(5)).score(x) < 0.01).all()
    assert len(quality.fit(x, np.array([0.0, 1, 0, 1, 1])).score(x)) == 5


@pytest.mark.parametrize("text", ["", " \n\t", "x", "Ab ab. AB!\nAb ab. AB!\n12 %%", "é" * 100_000, "\x00   \U0001f600"])
def test_features_are_numbers(text):
    f = dict(zip(quality.FEATURES, quality.features(text), strict=True))
    assert all(map(math.isfinite, f.values()))
    if text.startswith("Ab"):
        assert f["distinct_lines"] == 2 / 3 and f["upper"] == 6 / 12 and f["digits"] == 2 / len(text) and f["distinct_words"] == 5 / 8


def test_query(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = QUERIES["op12_additive_quality"](spark, SF).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    want = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    assert sum(p == q for p, q in judged) / len(judged) > 0.95
    model = quality.train(docs, labels)
    turned = quality.train(docs, labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert all((a == b).all() for a, b in zip([*model.tables, *model.grids], [*turned.tables, *turned.grids], strict=True))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(abs(r.score - by_hand(model, quality.features(texts[r.doc_id] or ""))) < 1e-9 for r in got)


def test_odd_rows(spark):
    schema = "doc_id long, text string, score string, x double, y int"
    rows = [(i, ("good words here. " if i % 2 else "%% ## %% ") * (i % 7 + 1), "s", 0.5, 1) for i in range(400)]
    rows += [(None, None, None, None, None), (7, "again, with other text", None, None, None), (900, "", None, None, None), (901, "long " * 200_000, None, None, None), rows[3]]
    labels = [(i, i % 2, 0) for i in range(400)] + [(2, 1, 0), (4, None, 0), (None, 1, 0), (5, 1, 0)]
    d, la = spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(d, la)
    got = quality.scored(d, model).collect()
    assert len(got) == len(rows) and {r.predicted for r in got if r.doc_id is not None and 10 < r.doc_id < 400 and r.doc_id % 2} == {1}
    assert {r.predicted for r in got if r.doc_id is not None and 10 < r.doc_id < 400 and not r.doc_id % 2} == {0}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.scored(d.limit(0), model).count() == 0
    assert {r.score for r in quality.scored(d, quality.train(d.limit(0), la)).collect()} == {0.5}
    assert {r.score for r in quality.scored(d, quality.train(d, la.limit(0))).collect()} == {0.5}
