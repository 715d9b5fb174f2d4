import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from colweave.llm import whitening as W

SF = "/root/testdata/sf0.001"


def brute(rows, components=16):
    """{dim: (n, {x: deviation}, covariance)} by integers and fractions, and the rows that stay."""
    kept = [(k, tuple(math.floor(Fraction(float(c)) * 64) + 1_000_000 for c in e)) for k, e in rows if e and all(c is not None and math.isfinite(c) and abs(c) * 64 < 2**62 for c in e)]
    spaces = {}
    for dim in {len(x) for _, x in kept}:
        fit = sorted({x for _, x in kept if len(x) == dim})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        y = {x: [n * a - b for a, b in zip(x, s)] for x in fit}
        cov = [[Fraction(sum(v[i] * v[j] for v in y.values()), n**3) for j in range(dim)] for i in range(dim)]
        spaces[dim] = (n, y, cov)
    return kept, spaces


def check(got, rows, components=16):
    kept, spaces = brute(rows)
    assert len(got) == sum(min(components, len(x)) for _, x in kept)
    by = {}
    for r in got:
        by.setdefault((r[0], r.deviation, r.n), {}).setdefault(r.component, []).append(r)
    left = list(kept)
    for k, x in left:
        n, y, cov = spaces[len(x)]
        own = by[k, sum(v * v for v in y[x]), n]
        assert set(own) >= set(range(1, min(components, len(x)) + 1))
    for dim, (n, y, cov) in spaces.items():
        v = np.array([[float(c) for c in r] for r in cov])
        values = np.sort(np.linalg.eigvalsh(v))[::-1][:components]
        centred = np.array([[a / n for a in c] for c in y.values()])
        names = {x: i for i, x in enumerate(y)}
        w = np.full((len(y), min(components, dim)), np.nan)
        for k, x in kept:
            if len(x) == dim:
                for c, rs in by[k, sum(a * a for a in y[x]), n].items():
                    if len(rs) == 1:
                        w[names[x], c - 1] = math.nan if rs[0].whitened is None else rs[0].whitened
                        assert abs(rs[0].explained - max(values[c - 1], 0) / (np.trace(v) or 1)) <= 1e-9
                        assert rs[0].identity_error is None or rs[0].identity_error <= 1e-4
        full = [c for c in range(w.shape[1]) if values[c] > values[0] * dim * 1e-12]
        if full and not np.isnan(w[:, full]).any():
            assert np.abs(w[:, full].T @ w[:, full] / n - np.eye(len(full))).max() < 1e-6
            for c in full:  # each component is an eigenvector: the loadings of w on x are V v / sqrt(e) = sqrt(e) v
                u = centred.T @ w[:, c] / n / math.sqrt(values[c])
                assert abs(np.linalg.norm(u) - 1) < 1e-6 and np.abs(v @ u - values[c] * u).max() < 1e-6 * max(1, values[0])


def test_moduli_and_reconstruction():
    rng = np.random.default_rng(1)
    for most in (0, 1, 10**6, 10**30, 10**60):
        primes = W.moduli(most)
        assert all(p < W.MODULUS and all(p % q for q in range(2, math.isqrt(p) + 1)) for p in primes) and len(set(primes)) == len(primes)
        values = np.array([0, most, -most, *(int(v * most) for v in rng.uniform(-1, 1, 20))], dtype=object)
        if primes:
            assert list(W.reconstructed({p: (values % p).astype(np.int64) for p in primes})) == list(values)
    assert W.BLOCK * (W.MODULUS // 2) ** 2 <= 2**53


def test_against_fractions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 20)) @ rng.normal(size=(20, 20)) * rng.uniform(0.1, 30, 20)
    rows = [(i, [float(np.float32(c)) for c in e]) for i, e in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(1, rows[1][1]), (None, rows[2][1])]  # copies, a repeated row, a null key
    rows += [(2000, None), (2001, []), (2002, [None] * 20), (2003, [math.nan] * 20), (2004, [math.inf] + [0.0] * 19), (2005, [1e300] * 20), (2006, [-0.0] * 20), (2007, [1e-300] * 20), (2008, [-1e-300] * 20)]
    rows += [(3000 + i, [float(i % 3), 0.0, 1.0]) for i in range(9)] + [(4000, [0.25])]  # further spaces: components without variance, one vector only
    df = spark.createDataFrame([(k, e, 1, 2) for k, e in rows], "vec_id long, embedding array<double>, n int, x int").repartition(5)
    got = W.whitened(df).collect()
    check(got, rows)
    lone = [r for r in got if r.vec_id == 4000]
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in lone] == [(1, 0, None, 0.0, None)]
    assert [r.whitened is None for r in sorted((r for r in got if r.vec_id == 3001), key=lambda r: r.component)] == [False, True, True]
    assert W.whitened(df.limit(0)).count() == 0
    assert W.whitened(df.where("vec_id = 2000")).count() == 0


def test_large_entries_stay_exact(spark):
    """Integers beyond 64 bits on the way, in the scatter and in the deviations."""
    rng = np.random.default_rng(4)
    rows = [(f"v{i}", [float(c) for c in e]) for i, e in enumerate(rng.integers(-(2**50), 2**50, size=(40, 4)))]
    got = W.whitened(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), components=3).collect()
    check(got, rows, 3)


def test_partitions_and_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in e]) for i, e in enumerate(rng.normal(size=(300, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one, many = (sorted(W.whitened(d).collect()) for d in (df.coalesce(1), df.repartition(7)))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in one] == [(r.vec_id, r.component, r.n, r.deviation) for r in many]
    assert all(abs(a.whitened - b.whitened) < 1e-9 for a, b in zip(one, many))
    check(one, [(k, [float(np.float32(c)) for c in e]) for k, e in rows])


def test_query(spark):
    df = W.query(spark, SF)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(df.collect(), duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall())


@pytest.mark.parametrize("n", [1, 2])
def test_few_vectors(spark, n):
    rows = [(i, [float(i), 1.0]) for i in range(n)]
    check(W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)
