import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from colweave.llm import licenses as L
from colweave.llm import sharding as S
from colweave.llm import token_counts as T

TEXTS = [(1, "Hello  world"), (2, ""), (3, None), (4, "a<|endoftext|>b"), (5, "ünï " * 3000), (6, "Hello  world"), (6, "Hello  world"), (None, "x\n\t y")]


def test_token_counts_and_cache(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(k, t, 1, b"") for k, t in TEXTS], "doc_id long, text string, n_tokens int, digest binary")
    tok = Tokenizer.from_file(path)
    want = sorted(((k is None, k, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in TEXTS), key=str)
    look = lambda d: sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in T.token_counts(d, path, cache).collect()), key=str)
    assert look(df) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in TEXTS})
    assert look(df) == want and spark.read.parquet(cache).count() == stored  # nothing is encoded twice
    more = df.limit(0).unionAll(spark.createDataFrame([(9, "new text", 0, b"")], df.schema))
    assert len(look(more)) == 1 and spark.read.parquet(cache).count() == stored + 1
    assert look(df.limit(0)) == []
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    assert T.token_counts(df, pieces, cache).count() == len(TEXTS)
    assert look(df) == want


def test_vector_pack(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 300))) for i in range(3000)] + [(5000 + i, "one text of a third") for i in range(1500)] + [(9000, None), (9001, ""), (9001, ""), (None, "z")]
    df = spark.createDataFrame([(k, t, 3) for k, t in rows], "doc_id long, text string, shard int").repartition(5)
    out = S.vector_pack(df, buckets=256).toPandas()
    assert len(out) == len(rows) and set(out["shard"]) <= set(range(8))
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    total = out.groupby("shard")["size"].sum()
    assert total.max() - total.min() < 0.03 * total.mean()
    assert out["size"].sum() == sum(len((t or "").encode()) + 1 for _, t in rows)
    again = S.vector_pack(df.repartition(2), buckets=256).toPandas()
    assert sorted(map(str, out.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    assert S.vector_pack(df.limit(0)).count() == 0


def test_place_by_dot_products():
    rng = np.random.default_rng(5)
    items = rng.integers(1, 50, size=(300, 3)).astype(float)
    sizes = items / items.sum(axis=0)
    left, want = [[1 / 4] * 3 for _ in range(4)], {}
    for i in sorted(range(300), key=lambda i: (-sizes[i].max(), -sizes[i].sum(), i)):
        at = max(range(4), key=lambda s: (sum(a * b for a, b in zip(left[s], sizes[i])), -s))
        want[i] = at
        left[at] = [a - b for a, b in zip(left[at], sizes[i])]
    assert S.place(items, 4).tolist() == [want[i] for i in range(300)]
    assert S.place(np.zeros((0, 3)), 4).tolist() == []


def test_groups_stay_whole_where_they_fit(spark):
    rng = np.random.default_rng(1)
    texts = [f"text {i} " + "w " * int(rng.integers(50, 60)) for i in range(2000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10000 + 100 * g + i, "copy of %d" % g + " x" * 60) for g in range(20) for i in range(60)]
    shard = {r.doc_id: r.shard for r in S.vector_pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=256).collect()}
    for g in range(20):  # 60 copies each, an eighth of a shard's capacity at most
        assert len({shard[10000 + 100 * g + i] for i in range(60)}) == 1
    out = S.vector_pack(spark.createDataFrame([(i, "all the same") for i in range(4000)], "doc_id long, text string"), buckets=256).toPandas()
    assert set(out["shard"]) == set(range(8)) and out.groupby("shard")["size"].sum().max() < 1.1 * len("all the same ") * 500


def brute_base(text):
    from colweave.llm.common import words

    w, at, labels = [x.decode() for x in words((text or "").encode())], [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels)


def test_license_scan(spark):
    texts = [None, "", "The MIT License. mit license mit-license", "x é GNU General Public License, Apache license!", "Permision is hereby granted, free of charge, to ani person obtaining a copy", "nothing to see", "admit license", "word " * 20000 + "apache license", "Redistribution and usage in sourse and binary forms", "Redistribution in forms"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in L.license_scan(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert got[4].labels == ["mit-notice"] and texts[4][got[4].spans[0].start : got[4].spans[0].end] == texts[4]
    assert got[4].spans[0].edits == 2 and got[8].labels == ["bsd-notice"] and got[9].labels == []
    assert L.license_scan(df.limit(0)).count() == 0


def test_fuzzy_finds_what_the_pattern_alone_finds():
    import random

    import regex

    rng, notice, k = random.Random(4), L.NOTICES[3][0], 4
    for _ in range(60):
        s = list(notice)
        for _ in range(rng.randrange(0, 7)):
            i = rng.randrange(len(s))
            s[i] = rng.choice(["", "q", s[i] + "z"])
        text = f" before {''.join(s)} after "
        whole = regex.search(f"(?:{regex.escape(notice)}){{e<={k}}}", text)
        assert bool(whole) == bool(L.fuzzy(text, (L.NOTICES[3],)))
