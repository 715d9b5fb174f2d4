"""Models from moments against numpy on the rows themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colweave.operators import models as M
from colweave.operators import moments as N

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) * [1, 1e-3, 50] + [1e4, 0, -3]  # far from 0: sums of squares alone would lose what differs
    y = 1e-2 * x[:, 0] + 200 * x[:, 1] + np.sin(x[:, 2]) + rng.normal(size=400)
    w = rng.uniform(0.1, 3, 400)
    rows = [(int(i), *map(float, r), float(v), float(u)) for i, (r, v, u) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame([*rows, (400, None, 1.0, 1.0, 1.0, 1.0), (401, 1.0, math.nan, 1.0, 1.0, 1.0), (402, 1.0, 1.0, 1.0, None, 1.0)], "id long, a double, b double, c double, y double, w double").repartition(7)
    return df, x, y, w


def expanded(x):
    return np.column_stack([x, *(x[:, i] * x[:, j] for i in range(3) for j in range(i, 3))])


def ridge_on_rows(x, y, w, alpha):
    """Centred by weighted means, scaled by unweighted norms, rows times roots of their weights."""
    mean, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    scale = np.linalg.norm(x - mean, axis=0)
    z, root = (x - mean) / scale, np.sqrt(w)
    b = np.linalg.lstsq(np.vstack([z * root[:, None], math.sqrt(alpha) * np.eye(x.shape[1])]), np.append((y - my) * root, np.zeros(x.shape[1])), rcond=None)[0] / scale
    return my + (x - mean) @ b


def test_ridge(spark, data):
    df, x, y, w = data
    for weight in (None, "w"):
        own = w if weight else np.ones(len(y))
        found = N.moments(df, COLUMNS, "y", weight)[0]
        assert found.n == 400 and found.weight == pytest.approx(own.sum())
        for alpha, fitted in zip([1e-2, 1.0, 100.0], N.ridge(found, [1e-2, 1.0, 100.0])):
            want = ridge_on_rows(expanded(x), y, own, alpha)
            got = {r.id: r.p for r in df.where("id < 400").select("id", fitted.predict(COLUMNS).alias("p")).collect()}
            assert np.allclose([got[i] for i in range(400)], want, atol=1e-5)
            assert N.squared_error(found, fitted) == pytest.approx((own * (y - want) ** 2).sum(), rel=1e-5)


def test_moments_add_up():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(50, 4)) + 1e6, rng.uniform(0, 1, 50)
    whole, parts = N.Moments.of(x, w), [N.Moments.of(x[a:b], w[a:b]) for a, b in ((0, 1), (1, 20), (20, 50))]
    for total in (parts[0] + parts[1] + parts[2], parts[2] + (parts[0] + parts[1])):
        for name in ("n", "weight", "mean", "products", "centre", "squares", "least", "most"):
            assert np.allclose(getattr(total, name), getattr(whole, name), rtol=1e-7, atol=1e-7)
    nothing = N.Moments.of(x[:3], np.zeros(3))
    assert np.allclose((whole + nothing).products, whole.products) and (nothing + nothing).weight == 0


def test_folds_from_one_scan(spark, data):
    df, x, y, w = data
    parts = N.moments(df, COLUMNS, "y", "w", F.pmod("id", F.lit(5)))
    assert sorted(parts) == [0, 1, 2, 3, 4]
    z, fold = expanded(x), np.arange(400) % 5
    for k, alpha, weight, error in N.folds_left_out(parts, [0.1, 10.0]):
        inside = fold != k
        mean, my = np.average(z[inside], axis=0, weights=w[inside]), np.average(y[inside], weights=w[inside])
        scale = np.linalg.norm(z[inside] - mean, axis=0)
        u = (z[inside] - mean) / scale
        b = np.linalg.solve(u.T @ (u * w[inside, None]) + alpha * np.eye(9), u.T @ ((y[inside] - my) * w[inside])) / scale
        want = (w[~inside] * (y[~inside] - my - (z[~inside] - mean) @ b) ** 2).sum()
        assert error == pytest.approx(want, rel=1e-5) and weight == pytest.approx(w[~inside].sum())
    assert N.folds_left_out({0: parts[0]}, [1.0]) == []
    assert N.moments(df.limit(0), COLUMNS, "y") == {}
    assert M.alpha_grid(df.limit(0), df, COLUMNS, "y", ["id"], ["id"], [1.0]) == []


def test_lasso_and_axes(spark, data):
    df, x, y, w = data
    found = N.moments(df, COLUMNS, "y")[0]
    z = expanded(x)
    mean, scale = z.mean(axis=0), np.linalg.norm(z - z.mean(axis=0), axis=0)
    for penalty in (1e-4, 1e-2, 1e3):
        fitted = N.lasso(found, penalty)
        b = fitted.coefficients * scale
        slope = ((z - mean) / scale).T @ (y - y.mean() - (z - mean) @ fitted.coefficients) / len(y)
        assert np.all(np.abs(slope) <= penalty + 1e-6) and np.allclose(slope[b != 0], penalty * np.sign(b[b != 0]), atol=1e-6)  # what makes it the least
    assert not fitted.coefficients.any() and fitted.intercept == pytest.approx(y.mean())
    for by_range in (False, True):
        axes = N.principal_axes(N.moments(df, COLUMNS, "y", degree=1)[0], 2, by_range)
        u = (x - x.mean(axis=0)) / (np.ptp(x, axis=0) if by_range else 1)
        values, vectors = np.linalg.eigh(u.T @ u / 399)
        assert np.allclose(axes.variances, values[::-1][:2], rtol=1e-6) and axes.total == pytest.approx(values.sum())
        got = df.where("id < 400").orderBy("id").select(*(c.alias(f"p{i}") for i, c in enumerate(axes.project(COLUMNS)))).toPandas().to_numpy()
        assert np.allclose(np.abs(got), np.abs(u @ vectors[:, ::-1][:, :2]), atol=1e-5)


def test_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0, float(3 * i)) for i in range(20)], "a double, b double, y double")
    (fitted,) = N.ridge(N.moments(df, ["a", "b"], "y", degree=1)[0], [1e-9])
    assert fitted.coefficients == pytest.approx([3, 0], abs=1e-6)
    assert np.isfinite(N.lasso(N.moments(df, ["a", "b"], "y")[0], 0.01).coefficients).all()


def test_the_other_estimators(spark, data):
    """The regression forest and the logistic model with squared penalties, whose weights shrink as c falls."""
    df = data[0].where("id < 400")
    assembled = M.polynomial(COLUMNS)[0].setOutputCol("features").transform(df)
    forest = M.forests("y", 10)[1].fit(assembled)
    error = forest.transform(assembled).select(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0]
    assert error < assembled.select(F.var_pop("y")).first()[0]
    rng = np.random.default_rng(9)
    plain = spark.createDataFrame([(float(u), float(v), float(u + 0.5 * v + e > 0)) for u, v, e in rng.normal(size=(300, 3))], "u double, v double, z double")
    sizes = [np.abs(M.logistic(["u", "v"], "z", 300, c, l1=False).fit(plain).stages[-1].coefficients.toArray()).sum() for c in (1e-3, 10.0)]
    assert 0 < sizes[0] < sizes[1]
