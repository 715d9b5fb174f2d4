"""Block-wise search and a stored index that grows, against scores worked out text by text."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colweave.operators import blocks as B
from colweave.operators import search as S

TOKEN = re.compile(r"[^\W_]+")


def brute(docs, queries):
    """{(query, id): score} of pairs with a token in common."""
    split = [(d, None if t is None else TOKEN.findall(t.lower())) for d, t in docs]
    known = [len(ts) for _, ts in split if ts is not None]
    avg, n = sum(known) / max(1, len(known)), len(split)
    df = Counter(t for _, ts in split for t in set(ts or ()))
    out = {}
    for q, text in queries:
        for token, qtf in Counter(TOKEN.findall((text or "").lower())).items():
            for d, ts in split:
                if tf := (ts or []).count(token):
                    out[q, d] = out.get((q, d), 0.0) + qtf * math.log(1 + (n - df[token] + 0.5) / (df[token] + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
    return out


def best(scores, k):
    out = {}
    for q in {q for q, _ in scores}:
        own = sorted(((-round(s, 9), d) for (p, d), s in scores.items() if p == q))[:k]
        out[q] = [(d, i + 1) for i, (_, d) in enumerate(own)]
    return out


def corpus(seed, n=120):
    draw = random.Random(seed)
    words = ["alpha", "beta", "gamma", "Éa", "x1", "zwei", "ω", "rare"] + [f"w{i}" for i in range(40)]
    text = lambda: " ".join(draw.choices(words, weights=[30, 20, 10, 5, 5, 5, 2, 0.1] + [1] * 40, k=draw.randint(0, 60)))
    docs = [(i, text()) for i in range(n)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, "rare " * 500), (2003, "...")]  # copies tie
    queries = [(i, text()) for i in range(15)] + [(100, "alpha"), (101, "alpha alpha rare"), (102, docs[5][1]), (103, "unheard of"), (104, None), (105, "")]
    return docs, queries


def found(df):
    return {(r[0], r[1]): r.score for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("limits", [{}, {"BLOCK_TEXTS": 7, "BLOCK_TOKENS": 90, "ASKED": 25}])
def test_against_single_texts(spark, monkeypatch, limits):
    for name, v in limits.items():
        monkeypatch.setattr(B, name, v)
    docs, queries = corpus(3)
    blocks = B.saved(B.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)))
    asked = spark.createDataFrame(queries, "query_id long, query_text string")
    assert blocks.count() >= (20 if limits else 4)
    want = brute(docs, queries)
    same(found(B.search(blocks, asked)), want)
    for k in (1, 3, 40):
        got = {}
        for r in B.search(blocks, asked, k=k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r["rank"]))
        assert got == best(want, k)


def test_ids_and_queries_of_other_types(spark):
    docs, queries = corpus(4, 20)
    named = spark.createDataFrame([({"a": f"d{d}", "b": d}, t) for d, t in docs], "doc struct<a: string, b: long>, text string")
    asked = spark.createDataFrame([((f"q{q}", q), t) for q, t in queries], "q struct<x: string, y: long>, t string")
    got = {(r.q.y, r.id.b): r.score for r in B.search(B.saved(B.build(named, "doc")), asked, "q", "t").collect()}
    same(got, brute(docs, queries))
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert B.search(B.saved(B.build(nothing)), asked, "q", "t", 3).count() == 0
    assert B.search(B.saved(B.build(named, "doc")), asked.limit(0), "q", "t").count() == 0


def test_blocks_are_passed_over(monkeypatch):
    """Bounds hold for every text of a block, and products are made in parts."""
    monkeypatch.setattr(B, "HELD", 5)
    rng = np.random.default_rng(1)
    words = pa.array([f"w{i:02d}" for i in range(12)])
    count = (rng.random((12, 9)) < 0.4) * rng.integers(1, 5, (12, 9))
    token, place = np.nonzero(count)
    lengths = pa.array(count.sum(axis=0).astype(float))
    block = next(B.each_block([B.block_of(pa.array(range(9)), lengths, place, token, count[token, place], words)]))
    asked = B.Asked(pa.table({"q": [i // 4 for i in range(40)], "token": [f"w{(i * 7) % 15:02d}" for i in range(40)], "qtf": [1] * 40, "df": [3 + i % 5 for i in range(40)]}), (50, 4.0))
    rows, all_scores = B.scores(asked, block)
    for theta in np.linspace(0, all_scores.max() * 1.5, 20):
        limits = np.full(len(asked.queries), theta)
        got = B.scores(asked, block, limits)
        alive = set() if got is None else set(got[0].tolist())
        assert {q for q, s in zip(rows.tolist(), all_scores) if s.max() >= theta} <= alive
        if got is not None:
            assert np.allclose(got[1], all_scores[[rows.tolist().index(q) for q in got[0]]])
    assert B.scores(asked, block, np.full(len(asked.queries), 1e9)) is None


def test_segments_and_deletions(spark, tmp_path):
    """A search over three segments and a deletion equals one over a fresh index; so it does after a merge, and after a deleted text has come again."""
    docs, queries = corpus(8)
    asked = spark.createDataFrame(queries, "query_id long, query_text string")
    index = B.Segments(spark, f"file://{tmp_path}/index")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert index.numbers() == []
    index.delete(frame(docs[:1]))  # of an empty index: nothing
    for part in (docs[:50], docs[50:110], docs[110:]):
        index.add(frame(part))
    same(found(index.search(asked)), brute(docs, queries))
    gone = [d for d in docs if d[0] % 4 == 1 or d[0] in (2002, 1003)]
    index.delete(frame(gone))
    left = [d for d in docs if d not in gone]
    same(found(index.search(asked)), brute(left, queries))
    index.add(frame([(1, "alpha rare again"), (1003, None)]))
    left += [(1, "alpha rare again"), (1003, None)]
    same(found(index.search(asked)), brute(left, queries))
    index.merge()
    assert index.numbers() == [5]
    same(found(index.search(asked)), brute(left, queries))
    (tmp_path / "index" / "segments" / "9").mkdir()  # one that was broken off
    assert index.numbers() == [5]
    index.delete(frame([(1, "")]))
    same(found(index.search(asked)), brute([d for d in left if d[0] != 1], queries))


def test_blocks_are_read_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """A reader holds a row group of blocks at once: none has more than a few, in searches, in stored indexes and after merges."""
    monkeypatch.setattr(B, "BLOCK_TEXTS", 1)
    docs = spark.createDataFrame(corpus(3)[0], "doc_id long, text string").coalesce(1)
    groups = []

    def read(blocks):
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
        groups.append([m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)])

    monkeypatch.setattr(B, "search", lambda blocks, queries, *rest: read(blocks) or queries.select(F.col("q").alias("id")))
    queries = spark.createDataFrame([(1, "alpha")], "q long, t string")
    S.bm25(docs, queries, query="q", query_text="t")
    S.bm25_top_k(docs, queries, 3, query="q", query_text="t")
    index = B.Segments(spark, str(tmp_path / "index"))
    index.add(docs)
    read(index.blocks())
    index.merge()
    read(index.blocks())
    assert [sum(g) for g in groups] == [154] * 4
    assert max(max(g) for g in groups) <= 8
