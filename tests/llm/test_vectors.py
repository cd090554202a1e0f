"""Exact search and whitening against brute force over all rows, odd ones included."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import topk, whitening

VECTOR = "vec_id long, embedding array<double>, label int, rank string, x string"
NAN, INF = float("nan"), float("inf")


def units(v, offset=0):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(1024 * c) + offset for c in v]


def table(spark, data):
    return spark.createDataFrame([(i, v, 0, "r", "x") for i, v in data], VECTOR)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 5))
    some = [(i, [float(c) for c in centres[i % 6] + rng.normal(size=5) * 0.2]) for i in range(900)]
    hot = [(10_000 + i, [0.5, -0.5, 0.25, 0.0, 1.0]) for i in range(450)]  # one vector holds a third
    odd = [(None, [0.1] * 5), (1200, None), (1300, [None, 1.0, 1.0, 1.0, 1.0]), (1400, [NAN] * 5), (1500, [INF, 0.0, 0.0, 0.0, 0.0]), (1600, []), (1700, [0.3, 0.3]), (-100, [9.0] * 5), (200, [1.0] * 5)]
    return some + hot + odd + [odd[-1], odd[0]]


def best_of(data, k=10):
    rows = [(i, u + [0] * (5 - len(u))) for i, v in data if (u := units(v)) is not None]
    out = []
    for n, (i, q) in enumerate(rows):
        if i is not None and i % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, x)), j is None, j or 0, j) for m, (j, x) in enumerate(rows) if m != n))[:k]
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(scores)]
    return sorted(out, key=str)


def searched(df, **how):
    return sorted((tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, **how).collect()), key=str)


def test_search_finds_the_best_rows(spark, data):
    df, want = table(spark, data), best_of(data)
    assert searched(df) == want
    assert searched(df, sample=40, pivots=7, rings=3, probes=(1,)) == want  # whatever the index was learned from
    assert searched(df, probes=()) == want


def test_search_in_small_blocks_and_chunks(spark, data, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "CHUNK", 5)
    assert searched(table(spark, data)) == best_of(data)


def test_search_of_few_or_no_rows(spark, data):
    assert searched(table(spark, data).filter("false")) == []
    assert searched(table(spark, [(0, [1.0])])) == []
    assert searched(table(spark, [(1, [1.0]), (2, [2.0])])) == []
    assert searched(table(spark, [(0, [1.0]), (1, [2.0]), (2, None)])) == [(0, 1, 1, 2 * 1024 * 1024)]
    assert searched(table(spark, [(0, []), (5, [])])) == [(0, 1, 5, 0)]


def test_search_of_large_components(spark):
    data = [(0, [3e6, 1.0, 0.0, 0.0, 0.0]), (1, [2e6, 0.0, 0.0, 0.0, 0.0]), (2, [2e6, 1.0, 0.0, 0.0, 0.0]), (3, [-1e6] * 5)]
    assert searched(table(spark, data)) == best_of(data)
    most = 2**63 - 1
    assert searched(table(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])])) == [(0, 1, 1, most), (0, 2, 2, -most - 1)]


def test_annuli_bounds_hold(spark, data):
    """No row of an annulus exceeds the annulus' bound, and bounds exclude most annuli of clustered rows."""
    x = np.array([u for _, v in data if (u := units(v)) is not None and len(u) == 5])
    df = spark.createDataFrame([(i, r.tolist(), False, i) for i, r in enumerate(x)], "id long, x array<long>, asks boolean, row_no long")
    index = topk.fitted(df, 5, len(x), 20_000, 16, 8, 1)
    topk.indexed(df, index)
    bound, (annulus, *_) = index.bounds(x), index.keyed(x)
    assert (bound[:, annulus] >= x @ x.T).all()
    reach = np.sort(x @ x.T, axis=1)[:, -11]
    assert (bound[:, index.blocks > 0] < reach[:, None]).mean() > 0.5


def whitened_by_hand(data, width, k=8):
    x = np.array([u + [whitening.OFFSET] * (width - len(u)) for _, v in data if (u := units(v, whitening.OFFSET)) is not None], object)
    n, sums = len(x), x.sum(0)
    centred = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x - sums) ** 2).sum(1), centred @ vectors[:, order], values[order], values.sum()


def test_whitening(spark, data):
    fine = [(i, v) for i, v in data if units(v) is not None]
    n, deviation, scores, values, trace = whitened_by_hand(data, 5)
    out = whitening.whiten(table(spark, data).withColumn("component", F.lit("c")).repartition(7)).toPandas()
    assert out.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(out) == 5 * n and set(out.n) == {n} and out.identity_error.max() < 1e-9
    for c in range(5):
        part = out[out.component == c + 1]
        assert part.explained.iloc[0] == pytest.approx(values[c] / trace, rel=1e-9)
        want = sorted(zip([-1 if i is None else i for i, _ in fine], deviation.tolist(), (np.abs(scores[:, c]) / np.sqrt(values[c])).round(6).tolist()))
        have = sorted(zip(part.vec_id.fillna(-1).astype(int), part.deviation.astype(int), part.whitened.abs().round(6)))
        assert [h[:2] for h in have] == [w[:2] for w in want]
        assert np.allclose([h[2] for h in have], [w[2] for w in want], atol=2e-6)


def test_whitening_of_many_components_and_few_rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=12).tolist()) for i in range(300)]
    out = whitening.whiten(table(spark, data)).toPandas()
    assert sorted(set(out.component)) == list(range(1, 9)) and len(out) == 2400 and out.identity_error.max() < 1e-9
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(w.T @ w / 300, np.eye(8), atol=1e-9)
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [(0, None), (1, [])])).count() == 0
    one = whitening.whiten(table(spark, [(4, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(4, 1, 1, 0, None, None, None), (4, 2, 1, 0, None, None, None)]


def test_whitening_of_large_components(spark):
    """Sums and deviations stay exact where longs can't hold what leads to them."""
    data = [(0, [3e12, 1.0]), (1, [-3e12, 2.0]), (2, [1e12, 0.5])]
    n, deviation, *_ = whitened_by_hand(data, 2)
    model = whitening.fit(table(spark, data).select(whitening.scaled("embedding", whitening.OFFSET).alias("x")))
    assert model.n == 3 and model.sums == [1024 * 10**12 + 300_000, 3584 + 300_000]
    out = whitening.whiten(table(spark, data)).toPandas()
    assert out.deviation.isna().all() and all(d >= 2**63 for d in deviation)  # beyond a long
    assert whitening.whiten(table(spark, [(0, [1e300]), (1, [-1e300])])).count() == 2
