"""Logistic models of many folds and penalties, fitted together, against numpy on the rows themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colweave.operators import logistic as L
from colweave.operators import models as M
from colweave.operators import moments as N
from colweave.plans import learn_queries

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [1, 0.02] + [5, 0.1]
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-(x[:, 0] - 5 + 40 * (x[:, 1] - 0.1))))).astype(float)
    rows = [(i, *map(float, r), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y))]
    odd = [(300, None, 0.1, 1.0, 0), (301, 5.0, math.nan, 1.0, 1), (302, 5.0, 0.1, None, 2)]
    return spark.createDataFrame(rows + odd, "id long, a double, b double, y double, fold int").repartition(5), x, y


@pytest.mark.parametrize("l1", [True, False])
def test_each_model_is_the_least_of_its_rows(data, l1):
    df, x, y = data
    wanted = [(k, c) for k in (0, 1, 2, None) for c in (0.02, 10.0)]
    own, folds, zeros = N.expanded(x), np.arange(300) % 3, 0
    for (k, c), m in zip(wanted, L.fit(df, COLUMNS, "y", wanted, "fold", l1), strict=True):
        rows = folds != k if k is not None else np.full(300, True)
        off = 1 / (1 + np.exp(-(m.intercept + own[rows] @ m.coefficients))) - y[rows]
        slope, limit = own[rows].T @ off / rows.sum(), 1 / (c * 300)
        assert abs(off.mean()) < 1e-6
        if l1:
            none = m.coefficients == 0
            zeros += none.sum()
            assert np.all(np.abs(slope[none]) <= limit * (1 + 1e-4)) and np.allclose(slope[~none], -limit * np.sign(m.coefficients[~none]), rtol=1e-3)
        else:
            assert np.allclose(slope, -limit * m.coefficients, rtol=1e-3, atol=1e-7)
    assert zeros > 0 or not l1


def test_areas_are_of_rows_that_a_model_did_not_see(spark, data):
    df, x, y = data
    df = df.coalesce(1).sortWithinPartitions("id")  # folds are drawn along the rows
    grid = [0.02, 10.0]
    found = M.cross_validated(df, COLUMNS, "y", grid, folds=3)
    dealt = {r.id: r.k for r in df.select("id", F.floor(F.rand(0) * 3).cast("int").alias("k")).collect()}
    folds, own = np.array([dealt[i] for i in range(300)]), N.expanded(x)
    again = df.drop("fold").join(spark.createDataFrame(list(dealt.items()), "id long, fold int"), "id")
    fitted = L.fit(again, COLUMNS, "y", [(k, c) for c in grid for k in range(3)] + [(None, found.c)], "fold")
    areas = []
    for i in range(6):
        rows = folds == i % 3
        z, v = fitted[i].intercept + own[rows] @ fitted[i].coefficients, y[rows]
        apart = z[v == 1][:, None] - z[v == 0]
        areas.append(((apart > 0) + (apart == 0) / 2).mean())
    want = [np.mean(areas[:3]), np.mean(areas[3:])]
    assert found.areas == pytest.approx(want, abs=1e-9) and found.c == grid[int(np.argmax(want))]
    assert np.allclose(found.model.coefficients, fitted[-1].coefficients, rtol=1e-4)


def test_odd_rows(spark):
    one = spark.createDataFrame([(float(i), 1.0, float(i == 3), i // 3) for i in range(6)], "a double, b double, y double, fold int")  # b is constant, fold 0 has one label only
    alone, seen = L.fit(one, COLUMNS, "y", [(1, 1.0), (0, 1.0)], "fold")
    assert np.all(alone.coefficients == 0) and alone.intercept < -20 and np.isfinite(alone.intercept)
    assert seen.coefficients[0] <= 0 and seen.coefficients[1] == 0
    (unseen,) = L.fit(one.where("fold = 0"), COLUMNS, "y", [(0, 1.0)], "fold")
    assert unseen.intercept == 0 and np.all(unseen.coefficients == 0)
    with pytest.raises(ValueError, match="no rows"):
        L.fit(one.where("a < 0"), COLUMNS, "y", [(None, 1.0)])
    with pytest.raises(ValueError, match="0 or 1"):
        L.fit(one.withColumn("y", F.col("a")), COLUMNS, "y", [(None, 1.0)])


def test_kfold_takes_few_jobs(spark):
    """A job for each step of each fold's model made hundreds."""
    spark.sparkContext.setJobGroup("kfold", "kfold")
    try:
        rows = learn_queries.kfold(spark, "/root/testdata/sf0.01").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.c for r in rows] == [0.1, 10.0] and all(0.5 < r.auc <= 1 for r in rows)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("kfold")) < 150


def test_logistic_nomatch_takes_few_jobs(spark):
    spark.sparkContext.setJobGroup("nomatch", "nomatch")
    try:
        rows = learn_queries.logistic_nomatch(spark, "/root/testdata/sf0.01").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == 399 and all(0 <= r.p <= 1 for r in rows)
    assert abs(sum(r.p - r.quality for r in rows)) < 0.05  # an intercept without a penalty
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("nomatch")) < 100
