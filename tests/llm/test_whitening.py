"""Whitening against exact integers and a local decomposition."""

import math

import numpy as np
import pytest

from aggrolens.llm import whitening
from aggrolens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def brute(vectors):
    """n, deviations, and by component the variance and the projections, up to sign."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    rest = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    dev = [sum(c * c for c in r) for r in rest]
    c = np.array([[k / n for k in r] for r in rest])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    return n, dev, e / np.trace(c.T @ c / n), c @ u / np.sqrt(np.maximum(e, 1e-300))


def check(got, ids, vectors):
    n, dev, share, white = brute(vectors)
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(rows) == len(got) == len(ids) * min(32, len(vectors[0]))
    for k in range(white.shape[1]):
        mine = np.array([rows[i, k + 1].whitened for i in ids])
        theirs = white[:, k] * np.sign((mine * white[:, k]).sum())
        assert np.abs(mine - theirs).max() < 1e-6
        assert all(abs(rows[i, k + 1].explained / share[k] - 1) < 1e-9 for i in ids)
    assert all(rows[i, 1].n == n and rows[i, 1].deviation == d for i, d in zip(ids, dev, strict=True))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("dims", [3, 40])
def test_whitening_is_brute_force(spark, dims):
    r = np.random.default_rng(dims)
    v = [list(map(float, np.float32(x))) for x in r.standard_normal((300, dims)) @ r.standard_normal((dims, dims)) + 5]
    v += [v[0]] * 90 + [[0.0] * dims]
    bad = [None, [], [None] + v[0][1:], [float("nan")] * dims, [float("inf")] + v[0][1:], [1.0]]
    rows = [(i, x, 7, "x") for i, x in enumerate(v)] + [(1000 + i, x, 7, "x") for i, x in enumerate(bad)]
    check(whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect(), list(range(len(v))), v)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(QUERIES["op11_whitening"](spark, sf).collect(), [r.vec_id for r in rows], [list(r.embedding) for r in rows])


def test_flat_and_few(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 3.0], 0, ""), (2, [1.0, 3.0], 0, ""), (None, [1.0, 2.0], 0, "")], SCHEMA)
    got = whitening.whitened(d).collect()
    assert len(got) == 8 and {r.vec_id for r in got} == {1, 2, None}
    assert sorted(abs(round(r.whitened, 9)) for r in got if r.component == 1) == [1, 1, 1, 1] and {r.whitened for r in got if r.component == 2} == {None}
    assert {(r.n, r.deviation) for r in got} == {(4, (4 * 32) ** 2)} and got[0].identity_error < 1e-12
    one = whitening.whitened(d.where("vec_id = 1")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    assert whitening.whitened(d.limit(0)).count() == 0 and whitening.whitened(d.select("vec_id", "embedding").where("vec_id > 5")).columns[0] == "vec_id"


def test_huge_components(spark):
    """Whole numbers beyond 64 bits are kept within bounds, and what doesn't fit is null."""
    d = spark.createDataFrame([(1, [1e30, 0.5], 0, ""), (2, [-1e30, 0.25], 0, ""), (3, [3e14, 0.25], 0, "")], SCHEMA)
    got = whitening.whitened(d).collect()
    assert {r.deviation for r in got} == {None} and all(r.whitened is None or abs(r.whitened) < 2 for r in got)


def test_exact_numbers():
    x = whitening.whole(np.array([[-0.5, 0.015625, 1e300, -1e300]])).tolist()[0]
    assert x[:2] == [999_968, 1_000_001] and abs(x[2] - (1 << 62)) < 2000 and x[3] == 1_000_000 - (1 << 62)
    root = math.isqrt((1 << 63) - 1)
    d = np.array([[3, 4], [1 << 40, 0], [root, 0], [root, 1 << 20], [1 << 62, 1 << 62]])
    assert whitening.deviations(d) == whitening.deviations(d.astype(object)) == [25, None, root * root, None, None]
    assert whitening.centred(np.array([[1 << 61]]), 1000, [5]).tolist() == [[1000 * (1 << 61) - 5]]
