import numpy as np
import pytest
from pyspark.sql import functions as F

from amplispark.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, anchor_id long, rank int"
LONGEST = 2**63 - 1


def brute_force(rows, positives=5, k=10, low=30, high=90):
    whole = [
        (i, c, [int(np.floor(256 * x)) for x in v]) for i, c, v in rows
        if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    score = lambda a, b: max(-LONGEST - 1, min(LONGEST, sum(x * y for x, y in zip(a, b))))
    out = []
    for a, c, v in whole:
        if a % 100:
            continue
        own = sorted((-score(v, w), i) for i, d, w in whole if d == c and i != a and len(w) == len(v))[:positives]
        for p, i in own:
            fits = sorted((-score(v, w), n) for n, d, w in whole if d != c and len(w) == len(v) and low * -p <= 100 * score(v, w) <= high * -p)[:k]
            out += [(a, i, r + 1, n, -p, -s) for r, (s, n) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, parts=5, **kw):
    df = spark.createDataFrame([(i, c, v, 1, 2) for i, c, v in rows], SCHEMA).repartition(parts)
    got = hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def some_rows(n, d=6, labels=4, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(i), int(c), v.tolist()) for i, c, v in zip(range(n), rng.integers(0, labels, n), rng.normal(0.2, 0.3, (n, d)))]


@pytest.mark.parametrize("kw", [{}, {"per_pass": 3}, {"positives": 2, "k": 3, "low": 0, "high": 100}])
def test_mined(spark, kw):
    rows = some_rows(700)
    rows += [(1000 + i, 1, rows[3][2]) for i in range(300)]  # one vector in 300 copies: ties
    rows += [rows[0], rows[100], rows[7]]  # repeated rows, anchors among them
    rows += [(2001, None, [0.1] * 6), (2002, 1, None), (2003, 1, [0.1, None] + [0.2] * 4), (2004, 2, [float("nan")] * 6), (2005, 2, [float("inf")] * 6), (None, 1, [0.1] * 6)]
    rows += [(3000, 9, [1.0, 2.0]), (3001, 9, [1.0, 1.0]), (3002, 8, [0.5, 0.5]), (3100, 9, []), (3101, 8, []), (3200, 77, [0.1] * 6)]
    want = brute_force(rows, **{x: y for x, y in kw.items() if x != "per_pass"})
    assert want and mined(spark, rows, **kw) == want


def test_one_frequent_label(spark):
    rows = [(i, 0 if i % 3 else 1 + i % 5, v) for i, _, v in some_rows(500, seed=1)]
    assert mined(spark, rows) == brute_force(rows)


def test_large_components(spark):
    rows = [(0, 0, [3e38, 1.0]), (1, 0, [2e38, 1.0]), (2, 1, [1.0, 5.0]), (3, 1, [1e-3, 1.0]), (4, 1, [2.5e38, 0.0]), (100, 0, [1e4, -3e4]), (5, 0, [3e7, 1.0]), (6, 1, [1.5e7, 1.0]), (200, 5, [1e308, 1e308]), (7, 5, [1e308, 1e308]), (8, 6, [1e308, 1e308])]
    most = np.finfo(np.float64).max / 256
    assert mined(spark, rows) == brute_force([(i, c, [min(x, most) for x in v]) for i, c, v in rows])


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, 1, [1.0])]) == [] and mined(spark, [(100, 1, [1.0]), (1, 1, [-1.0]), (2, 0, [1.0])]) == []


def test_intervals_hold_the_score_and_drop_what_cannot_qualify():
    rng = np.random.default_rng(2)
    x, a = rng.integers(-300, 300, (50, 9)).astype(float), rng.integers(-300, 300, (4, 9)).astype(float)
    block = hn.Sliced(x, a)
    truth = (x @ a.T).astype(int)
    for n in range(4):
        seen, widths = [], []

        def test(lo, hi, n=n):
            widths.append(int((hi - lo).max()))
            seen.append(len(lo))
            assert (lo <= hi).all()
            return hi >= np.sort(truth[:, n])[-3]

        rows, scores = block.scores(n, np.arange(50), test)
        assert sorted(scores.tolist()) == sorted(truth[:, n].tolist())[-3:] and (scores == truth[rows, n]).all()
        assert widths == sorted(widths, reverse=True) and widths[-1] == 0 and seen[-1] < 50


def test_windows():
    for p in range(-40, 200):
        first, last = hn.window(p, 30, 90)
        assert [n for n in range(-100, 300) if 30 * p <= 100 * n <= 90 * p] == [n for n in range(-100, 300) if first <= n <= last]
