import random

import numpy as np
import xxhash

from colweave.llm import simhash as S
from colweave.llm.common import components


def brute_components(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_fingerprint_by_definition():
    for text in ["", "One", "two WORDS", "a b\tc\x0bd e f a b c", "ä b c d"]:
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = [x for x in __import__("re").split("[ \t-\r]+", raw) if x]
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        want = sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))
        assert S.fingerprint(text.encode()) == want


def test_node_pairs_against_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    x = np.unique(np.r_[rng.integers(0, 1 << 63, 800, dtype=np.uint64), np.repeat(base, 60) ^ (np.uint64(1) << rng.integers(0, 64, 1200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1200).astype(np.uint64)), [np.uint64(0), S.ALL]])
    y = np.unique(np.r_[x[::3], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    for budget in (0, 1, 2, 3):
        got = {(int(a), int(b)) for i, j in S.node_pairs(x, y, budget) for a, b in zip(i, j)}
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= budget)
        assert got == set(zip(i.tolist(), j.tolist()))


def test_components_of_edges(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(500, 600)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    label = brute_components(600, links)
    assert got == {v: label[v] for v in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 8)
    rng = random.Random(6)
    say = lambda n: [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(n)]
    texts = [None, "", "  ", "one", "One", "one two", "x " * 30000]
    for _ in range(40):
        w = say(rng.randrange(5, 300))
        texts.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice("xyz")
            texts.append(" ".join(v))
    texts += [texts[10]] * 50
    df = spark.createDataFrame([(1000 - i, t, "c") for i, t in enumerate(texts)] + [(None, "one", "c"), (1000, None, "c")], "doc_id long, text string, fingerprint string").repartition(3)
    out = S.simhash_components(df).collect()
    rows = [(1000 - i, S.fingerprint((t or "").encode())) for i, t in enumerate(texts)]
    ids = {k: f for k, f in rows}
    order = sorted(ids)
    links = [(i, j) for i, a in enumerate(order) for j in range(i) if bin(ids[a] ^ ids[order[j]]).count("1") <= 2]
    label = brute_components(len(order), links)
    want = {k: order[label[i]] for i, k in enumerate(order)}
    assert len(out) == len(texts) + 2
    for r in out:
        if r.doc_id is None:
            assert r.component_id == want[997]
        else:
            assert r.component_id == want[r.doc_id] and int(r.fingerprint, 16) == ids[r.doc_id] and len(r.fingerprint) == 16
    assert S.simhash_components(df.limit(0)).count() == 0


def test_dense_cluster_and_two_tables(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 16)
    rng = np.random.default_rng(1)
    center = np.uint64(0xF0F0F0F0F0F0F0F0)
    flips = [center ^ np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)) for _ in range(700)]
    f = np.unique(np.array([*flips, *rng.integers(0, 1 << 63, 300, dtype=np.uint64)], dtype=np.uint64))
    rows = [(t, S.signed(int(x))) for t in (3, 4) for x in f]
    got = S.trie_self_join(spark.createDataFrame(rows, "t int, f long").repartition(4), 2).collect()
    at = {int(x): i for i, x in enumerate(f)}
    want = brute_components(len(f), [(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2)) if i < j])
    for t in (3, 4):
        links = [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in got if r.t == t]
        assert all(bin(int(f[i]) ^ int(f[j])).count("1") <= 64 for i, j in links)
        assert brute_components(len(f), links) == want


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    shared = say(30)
    rows, key = [], 0
    for n in (1, 3, 60, 200, 700):
        for _ in range(4):
            w = say(n) + (shared if n == 200 else [])
            for c in range(6):
                v = list(w)
                for _ in range(0 if c < 2 or n < 60 else max(1, n // 120)):
                    v[rng.randrange(len(v))] = rng.choice(words)
                rows.append((key, " ".join(v)))
                key += 1
    rows += [(5000, None), (5001, ""), (5002, " \t"), (7, rows[9][1]), (rows[0][0], rows[0][1])]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    g = [grams(t) for _, t in rows]
    near = lambda a, b: (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b))
    label = brute_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near(g[i], g[j])])
    want = [min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))]
    df = spark.createDataFrame([(k, t, k) for k, t in rows], "doc_id long, text string, k long").repartition(3)
    got = sorted((r.doc_id, r.component_key) for r in S.near_duplicates(df).collect())
    assert got == sorted(zip([k for k, _ in rows], want))
    kept = S.one_of_each_group(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))
    assert kept[0].__fields__ == ["doc_id", "text", "k"]
    assert S.one_of_each_group(df.limit(0)).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    """Thousands of texts at a similarity of 0.78 to 0.84 with each other: most links of a text fail, the few that hold must be found."""
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(200)], []
    for k in range(2000):
        v = list(base)
        for at in rng.sample(range(200), rng.choice((2, 2, 2, 3, 4, 5))):
            v[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(v)))
    ids = {}
    g = [np.array(sorted({ids.setdefault(tuple(w[i : i + 5]), len(ids)) for i in range(len(w) - 4)})) for w in (t.split() for _, t in rows)]
    at = np.zeros((len(rows), len(ids)), dtype=np.float32)
    for i, x in enumerate(g):
        at[i, x] = 1
    common, n = at @ at.T, at.sum(axis=1)
    similar = common / (n[:, None] + n[None, :] - common)
    off = similar[np.triu_indices(len(rows), 1)]
    assert ((off > 0.78) & (off < 0.84)).sum() > 100_000 and 0.3 < (off < 0.8).mean() < 0.9
    near = similar >= 0.8
    want = np.arange(len(rows))
    while True:
        best = np.where(near, want[None, :], len(rows)).min(axis=1)
        if np.array_equal(best, want):
            break
        want = best
    assert len(set(want.tolist())) > 10
    got = {r.doc_id: r.component_key for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [got[k] for k in range(len(rows))] == want.tolist()
