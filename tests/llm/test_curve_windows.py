"""Windows of the curve search are as large as sampled queries need, up to all of the index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aggrolens.llm import ann


@pytest.mark.parametrize("kind,exact", [("random", False), ("clustered", False), ("random", True)])
def test_recall(spark, kind, exact):
    r = np.random.default_rng(6)
    v = r.standard_normal((6000, 48))
    if kind == "clustered":
        v = v[r.integers(0, 40, 6000)] + 0.4 * v
    d = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for x in ann.nearest(d, F.col("vec_id") % 50 == 0, block=4, sample=60, exact=exact).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit == 600 if exact else hit >= 0.9 * 600
