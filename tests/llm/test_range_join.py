import math

import numpy as np

from colweave.llm import range_join as R
from tests.llm.test_simhash import brute_components


def brute(rows, cosine=0.95):
    ok = [e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e in rows]
    links = []
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                    links.append((i, j))
    label = brute_components(len(rows), links)
    out = []
    for i, (k, _) in enumerate(rows):
        ks = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        c = min(ks, default=None)
        out.append((k, sum(a == i for a, _ in links), c, k == c))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "PER_PIVOT", (12,))
    monkeypatch.setattr(R, "COPIES", 1000)
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    x = np.concatenate([c + 0.12 * rng.normal(size=(20, 8)) for c in centers] + [rng.normal(size=(60, 8))]).astype(np.float32)
    rows = [(900 - i, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)] + [(2000, rows[5][1]), (3000, [v * 2 for v in rows[7][1]]), (None, rows[9][1])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 8), (4003, [float("nan")] + [1.0] * 7), (4004, [float("inf")] + [1.0] * 7), (4005, [None] + [1.0] * 7), (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (4008, [-0.0, 1.0]), (4009, [0.0, 1.0])]
    df = spark.createDataFrame([(k, e, 1) for k, e in rows], "vec_id long, embedding array<double>, n_links int").repartition(4)
    got = sorted((tuple(r) for r in R.range_join(df).collect()), key=str)
    assert got == brute(rows)
    assert R.range_join(df.limit(0)).count() == 0
    assert [tuple(r) for r in R.range_join(df.where("vec_id = 4000")).collect()] == [(4000, 0, 4000, True)]


def test_dealing_of_clusters_and_even_vectors(spark, monkeypatch):
    """Rows dealt for each vector: few where vectors lie in clusters; and every pair is met once, wherever it lies."""
    monkeypatch.setattr(R, "PER_PIVOT", (200, 10))
    monkeypatch.setattr(R, "BLOCK", 200)
    dealt = []
    keep = R.saved
    monkeypatch.setattr(R, "saved", lambda df, path=None: dealt.append((df.columns, out := keep(df, path))) or out)
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(60, 64))
    for name, x in (("clusters", np.repeat(centers, 30, axis=0) + 0.1 * rng.normal(size=(1800, 64))), ("even", rng.normal(size=(1800, 64)))):
        dealt.clear()
        rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
        got = {r.vec_id: (r.n_links, r.component_id) for r in R.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u @ u.T >= 0.95
        label = brute_components(len(x), list(zip(*np.nonzero(np.tril(near, -1)))))
        assert got == {i: (int(near[i].sum()) - 1, label[i]) for i in range(len(x))}
        n = next(df.count() for columns, df in dealt if "home" in columns)
        assert n <= (3 if name == "clusters" else 9) * len(x), (name, n)


def test_a_pair_is_decided_alike_in_any_block():
    rng = np.random.default_rng(0)
    a = R.unit(rng.normal(size=(400, 64)))
    side = R.unit(rng.normal(size=(400, 64)))
    side = R.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = R.unit(0.95 * a + np.sqrt(1 - 0.95**2) * side)  # cosines of 0.95 up to rounding
    pairs = lambda x, y: {(int(i), int(j)) for p in R.linked(x, y, 0.95, False) for i, j in zip(*p)}
    one, two = pairs(a, b), {(j, i) for i, j in pairs(b, a)}
    some = {(i, i) for i in range(400) if pairs(a[i : i + 1], b[i : i + 1])}
    assert one == two and {p for p in one if p[0] == p[1]} == some
