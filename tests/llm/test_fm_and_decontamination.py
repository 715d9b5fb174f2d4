import random

import numpy as np

from colweave.llm import decontamination as D
from colweave.llm.common import words
from colweave.llm.fm_index import FMIndex, suffix_array


def brute(text, items, window=10):
    w, hit, ids = words((text or "").encode()), set(), set()
    for item, t in items:
        b = words((t or "").encode())
        if item is None or not b:
            continue
        for i in range(max(1, len(b) - window + 1)):
            p = b[i : i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    ids.add(item)
    return len(w), len(hit), sorted(ids)


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(1)
    for _ in range(30):
        codes = []
        for _ in range(rng.randrange(1, 6)):
            codes += [rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))] + [0]
        codes = np.array(codes)
        zeros = np.flatnonzero(codes == 0)
        key = [(-len(zeros) + int(np.searchsorted(zeros, i)) if c == 0 else int(c)) for i, c in enumerate(codes)]
        assert suffix_array(codes).tolist() == sorted(range(len(codes)), key=lambda i: key[i:])


def test_index_counts_and_locates():
    rng = random.Random(2)
    docs = [[rng.randrange(1, 5) for _ in range(rng.randrange(0, 200))] for _ in range(10)]
    codes = np.array([c for d in docs for c in [*d, 0]])
    index = FMIndex(codes, sample=7)
    for n in (1, 2, 3):
        patterns = np.array([[rng.randrange(1, 5) for _ in range(n)] for _ in range(20)])
        for p, a, b in zip(patterns, *index.search(patterns)):
            want = [i for i in range(len(codes) - n + 1) if codes[i : i + n].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c9", "é", "日", "x-y"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(14)), (2, say(3)), (3, ""), (4, None), (5, say(10)), (1, say(11)), (None, "a b")]
    texts = [None, "", "!!!", say(400), say(2) + " " + items[0][1].upper() + " " + say(30), items[4][1], items[4][1], items[1][1]] + [say(rng.randrange(60)) for _ in range(40)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (50, 10**6):
        got = {r.doc_id: r for r in D.decontaminate(docs, bench, shard_words=limit).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows:
            n, hit, ids = brute(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i].items) == (n, hit, ids)
            assert sum(len(words(t[s.start : s.end].encode())) for s in got[i].spans) == hit
        clean = {r.doc_id: r for r in D.cleaned(docs, bench, shard_words=limit).collect()}
        for i, t, _ in rows:
            n, hit, _ = brute(t, items)
            if hit and hit == n:
                assert i not in clean
            else:
                assert clean[i].items == "clash" and (len(words((clean[i].text or "").encode())) == n - hit if hit else clean[i].text == t)


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "two three four five six seven eight nine ten eleven"), (8, "alpha"), (9, "one two")], "item_id long, text string")
    whole = sorted(map(tuple, D.decontaminate(docs, bench).select("doc_id", "n_hit", "items").collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 20)
    assert sorted(map(tuple, D.decontaminate(docs, bench).select("doc_id", "n_hit", "items").collect())) == whole == [(1, 11, [7, 9]), (2, 1, [8])]
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in D.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_many_blocks_through_tables(spark, monkeypatch):
    """Five and more blocks of a benchmark with ids that are texts: the same rows as in one block, and no table is left but the last."""
    from colweave import storage

    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = [(f"i{k}", say(rng.choice((4, 12, 30)))) for k in range(40)] + [(None, say(12)), ("i1", say(12))]
    docs = spark.createDataFrame([(f"d{i}", say(200) + (f" {items[i % 42][1]} " if i % 2 else "") + say(100), i) for i in range(80)] + [(None, None, 1)], "doc_id string, text string, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = lambda: sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], str(r.spans)) for r in D.decontaminate(docs, bench).collect())
    whole = rows()
    assert sum(r[2] > 0 for r in whole) >= 40
    size = sum(len(t) for _, t in items)
    monkeypatch.setattr(D, "BLOCK_BYTES", size // 4)
    made = []
    monkeypatch.setattr(D, "saved", lambda df, path: made.append(path) or storage.saved(df, path))
    assert rows() == whole and len(made) >= 5
    assert [storage.exists(spark, p) for p in made] == [False] * (len(made) - 1) + [True]
    phrases = D.Phrases([(k, t) for k, t in items])
    assert phrases.codes.nbytes + phrases.owners.nbytes < 20 * size
