"""The queries on whole small tables against what their contracts define, worked out in plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from colweave.llm import queries as Q
from colweave.llm import token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def read(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs():
    return {k: t for k, t, *_ in read("documents")}


def run(spark, name, columns):
    df = Q.QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    for c, t in columns.items():
        assert types.get(c) == t, (name, c, types.get(c))
    return df.collect()


def components(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def test_op3(spark, docs):
    items = read("benchmark")
    windows = {}
    for item, t in items:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    rows = run(spark, "op3_benchmark_decontamination", {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"})
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        w, hit, found = WORD.findall(lower(docs[r.doc_id])), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), digest, bool(hit))


def test_op4(spark, docs):
    rows = run(spark, "op4_sharding", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"})
    assert sorted(r.doc_id for r in rows) == sorted(docs) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    filled, slots = Counter(), {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        filled[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(filled) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((t or "").encode()) + 1 for t in docs.values())
    assert max(filled.values()) - min(filled.values()) <= 2 * largest


def test_op6(spark):
    vectors = read("embeddings")
    x = np.array([v[1] for v in vectors], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = components(len(x), zip(*np.nonzero(near)))
    ids = [v[0] for v in vectors]
    rows = {r.vec_id: r for r in run(spark, "op6_embedding_near_dedup", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"})}
    least = {}
    for i, root in enumerate(label):
        least[root] = min(least.get(root, ids[i]), ids[i])
    assert len(rows) == len(ids)
    for i, k in enumerate(ids):
        assert (rows[k].n_links, rows[k].component_id, rows[k].kept) == (near[i].sum(), least[label[i]], k == least[label[i]])


def test_op7_and_its_cache(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in docs.items()}
    rows = run(spark, "op7_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    check = lambda rows: {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and all(r.over_limit == (r.n_tokens > 1024) for r in rows) and len(rows) == len(docs)
    assert check(rows)
    cache = f"file://{tmp_path}/cache"
    assert check(token_counts.query(spark, SF, cache).collect())
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in docs.values()})
    assert check(token_counts.query(spark, SF, cache).collect()) and spark.read.parquet(cache).count() == stored  # the second call only joins


def test_op8(spark, docs):
    rows = run(spark, "op8_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_op9(spark, docs):
    rows = run(spark, "op9_simhash_near_dedup", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    prints = {}
    for k, t in docs.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(docs)
    label = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 2])
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(k, f"{prints[k]:016x}", ids[label[i]]) for i, k in enumerate(ids)} and len(rows) == len(ids)


def test_op10(spark, docs):
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    rows = run(spark, "op10_license_scans", {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"})
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        w = WORD.findall(lower(docs[r.doc_id]))
        places = [(i, label) for phrase, label in base.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        own = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(own))
        assert set(own) <= set(filter(None, r.labels.split(","))) and r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1
