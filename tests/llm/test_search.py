import numpy as np

from pyspark.sql import functions as F

from amplispark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score long"


def brute_force(rows, k=10):
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, **kw).collect())


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=7).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(400)]  # one vector in 400 copies: ties
    rows += [(5001, None), (5002, [1.0, None] + [0.0] * 5), (5003, [float("nan")] * 7), (5004, [float("inf")] * 7), (None, [1.0] * 7), (5100, [2.0, 3.0]), (5101, [1.0, 1.0]), (5200, []), (9000, None)]
    want = brute_force(rows)
    for kw in ({}, {"slices": 3, "per_pass": 4}, {"slices": 1}):
        assert got(spark, rows, **kw) == want


def test_large_components(spark):
    rows = [(0, [3e38, -1.0]), (1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [1e-40, 5.5])]
    assert got(spark, rows) == brute_force(rows)


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, [1.0])]) == [] and got(spark, [(100, [1.0])]) == []
