import random

import numpy as np

from colweave.llm import simhash as S


def test_prints_of_sets():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 32, 400, dtype=np.uint64).astype(np.uint32)).view(np.int32)
    near = np.bitwise_count(np.uint64(S.print_of(a) % (1 << 64)) ^ np.uint64(S.print_of(a[2:]) % (1 << 64)))
    far = np.bitwise_count(np.uint64(S.print_of(a) % (1 << 64)) ^ np.uint64(S.print_of(a + 1) % (1 << 64)))
    assert near < 12 < far and S.print_of(a[:0]) == 0


def test_near_copies_come_by_the_trie_and_lists_of_the_same_texts_are_one(spark, monkeypatch):
    """The trie is asked first, what it finds is verified, what it misses follows; a passage's shingles, whose lists hold the same texts, are one list."""
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, passage = [], say(60)
    for k in range(12):
        w = say(500)
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join([*w, "more"])), (10 * k + 2, " ".join([*say(9), *w[80:]]))]  # one word more; a similarity of about 0.82
    rows += [(1000 + k, " ".join([*passage, *say(12)])) for k in range(30)]  # about 0.64 with each other
    tried, kept, lists = [], S.trie_self_join, []
    monkeypatch.setattr(S, "trie_self_join", lambda f, budget, bits=64: (tried.append(f.count()), kept(f, budget, bits))[1])
    several = S.several_classes
    monkeypatch.setattr(S, "several_classes", lambda named: (lists.append(named.select("h").distinct().count()), several(named))[1])
    got = {r.doc_id: r.component_key for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert tried and tried[0] > 40
    assert got == {k: k if k >= 1000 else k // 10 * 10 for k, _ in rows}
    assert lists[0] < 100  # of over a thousand shared shingles


def test_only_verified_links_of_the_trie_count(spark):
    sets = spark.createDataFrame([(b"a", [1, 2, 3], 5), (b"b", [1, 2, 3, 4], 5), (b"c", [9], 5), (b"d", [9, 10], 4)], "d binary, s array<int>, f long")
    got = {(bytes(r.src), bytes(r.dst)) for r in S.near_by_trie(sets, 0.7, 2).collect()}
    assert got == {(b"b", b"a")}
