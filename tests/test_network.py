"""The network's gradients against finite differences, its fit, and its expressions against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colweave.operators import network as N


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)), rng.uniform(-1, 1, 40)
    net = N.Network.start(["a", "b", "c"], x.min(axis=0), x.max(axis=0), (5, 4), seed=3)
    assert [w.shape for w, _ in N.Network.start(["a"] * 10, np.zeros(10), np.ones(10)).layers] == [(10, 48), (48, 12), (12, 1)]
    gradient, error = net.gradient(x, y)
    flat = net.flat()
    assert error == pytest.approx(((net.forward(x)[-1][:, 0] - y) ** 2).sum()) and np.array_equal(net.moved(flat).flat(), flat)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        slope = (net.moved(flat + step).gradient(x, y)[1] - net.moved(flat - step).gradient(x, y)[1]) / 2e-6
        assert gradient[i] == pytest.approx(slope, abs=1e-4)
    parts = [net.gradient(x[a:b], y[a:b]) for a, b in ((0, 7), (7, 40))]
    assert np.allclose(sum(p[0] for p in parts), gradient)


def test_fit_and_predict(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-3, 3, (300, 2))
    y = np.tanh(x[:, 0]) * 0.8
    rows = [(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (300, None, 1.0, 0.5), (301, 1.0, 1.0, None)], "id long, a double, b double, y double").repartition(3)
    net, errors = N.fit(df, ["a", "b"], "y", rounds=15, rate=0.02, hidden=(8, 4))
    assert errors[-1] < 0.5 * errors[0]
    got = {r.id: r.p for r in net.predict(df, "p").collect()}
    assert got[300] is None and all(-1 <= v <= 1 for v in got.values() if v is not None)
    want = net.forward(x)[-1][:, 0]
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-9)
    assert net.predict(df, "p").columns == ["id", "a", "b", "y", "p"]
    again, _ = N.fit(df.coalesce(1), ["a", "b"], "y", rounds=15, rate=0.02, hidden=(8, 4))
    assert np.allclose(again.flat(), net.flat(), atol=1e-6)
    with pytest.raises(ValueError):
        N.fit(df.where(F.lit(False)), ["a"], "y", 1)
