import hashlib
import random
from collections import Counter

import duckdb
import pytest

from colweave.llm import suffix_dedup as D

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """(bytes, spans, digest of the rest) of each text, byte by byte."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        covered = bytearray(len(t) + 1)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        turns = [i for i in range(len(t) + 1) if covered[i] != (covered[i - 1] if i else 0)]
        rest = bytes(c for c, v in zip(t, covered) if not v)
        out.append((len(t), list(zip(turns[::2], turns[1::2])), hashlib.sha256(rest).hexdigest()))
    return out


def result(df):
    return sorted(((r[0], r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) for r in df.collect()), key=str)


def wanted(rows, length):
    return sorted(((k, *b) for (k, *_), b in zip(rows, brute([r[1] for r in rows], length))), key=str)


@pytest.mark.parametrize("seed", range(200))
def test_suffix_arrays(monkeypatch, seed):
    """Few bytes, short strings: ties, runs of one byte, zero bytes, pieces that are ends of others."""
    monkeypatch.setattr(D, "GRAM", 4)
    monkeypatch.setattr(D, "CHUNK", 7)
    monkeypatch.setattr(D, "SEGMENT", 25)
    draw = random.Random(seed)
    length = draw.choice([8, 9, 12])
    pieces = [bytes(draw.choice(b"ab\0\xff"[: draw.randint(1, 4)]) for _ in range(draw.randint(length, 60))) for _ in range(draw.randint(1, 8))]
    pieces += [p[3:] for p in pieces if len(p) >= length + 3]
    windows = [p[i : i + length] for p in pieces for i in range(len(p) - length + 1)]
    text, begins, order = D.sorted_windows(pieces, length)
    flat = text.tobytes()
    assert sorted(order.tolist()) == [b + i for b, p in zip(begins.tolist(), pieces) for i in range(len(p) - length + 1)]
    assert [flat[o : o + length] for o in order] == sorted(windows)
    shared = D.common_prefixes(text, order, length, 3).tolist()
    for a, b, n in zip(order, order[1:], shared[1:]):
        assert n == next((i for i in range(length) if flat[a + i] != flat[b + i]), length)
    count = Counter(windows)
    for p, runs in zip(pieces, D.repeated_runs(pieces, [1] * len(pieces), length)):
        assert {i for a, b in zip(runs[::2], runs[1::2]) for i in range(a, b)} == {i for i in range(len(p) - length + 1) if count[p[i : i + length]] > 1}
    own, start, n, key, again = (x.tolist() for x in D.keyed_runs(pieces, length))
    assert sorted((i, s + j) for i, s, m in zip(own, start, n) for j in range(m)) == [(i, j) for i, p in enumerate(pieces) for j in range(len(p) - length + 1)]
    names = {}
    for i, s, m, k, a in zip(own, start, n, key, again):
        inner = [pieces[i][s + j : s + j + length] for j in range(m)]
        assert a or len(set(inner)) == len(inner)
        for w in inner:
            assert names.setdefault(w, k) == k
        parts = list(D.parts_of(pieces[i][s : s + m - 1 + length], k, length, 3))
        assert [j for lo, hi, _ in parts for j in range(lo, hi)] == list(range(m))
        for lo, hi, part in parts:
            for w in inner[lo:hi]:
                assert names.setdefault((w, "part"), part) == part


def corpus(seed=5):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh é") for _ in range(draw.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(9)
    texts = [prose(draw.randint(1, 120)) for _ in range(40)]
    texts += [prose(draw.randint(5, 40)) + passage + prose(draw.randint(5, 40)) for _ in range(60)]  # one passage in many texts
    texts += [prose(20) + line + prose(20) for _ in range(40)]  # a line shorter than the strings
    near = prose(150)
    texts += [near[: (at := draw.randint(0, len(near)))] + word() + near[at:] for _ in range(60)]  # near copies
    texts += [texts[3]] * 7 + [texts[45]] * 5 + [near]
    texts += ["x" * 900, "y" * 127, "z" * 128, "q" * 129, "ab" * 400, ("0123456789" * 13 + "\n") * 6, "", None, " ", "é" * 100, "😀" * 64, near * 3, prose(3000)]
    return [(i, t, "a", 1) for i, t in enumerate(texts)] + [(None, texts[60], "b", 2), (3, texts[3], "a", 1), (3, texts[3], "a", 1)]


SCHEMA = "doc_id long, text string, c string, key int"


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = D.repeated_spans(df, 128)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept_sha256"]
    assert result(got) == wanted(rows, 128)
    for r in D.repeated_spans(df, 200, kept=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert D.repeated_spans(df.limit(0), 128).count() == 0
    short = [r for r in rows if len((r[1] or "").encode()) < 128]
    assert result(D.repeated_spans(spark.createDataFrame(short, SCHEMA), 128)) == wanted(short, 128)
    with pytest.raises(ValueError):
        D.repeated_spans(df, 100)


def test_crowded_names_are_split(spark, monkeypatch):
    """One passage, near copies and one byte a thousand times fill many suffix arrays: parts, and parts of one window."""
    monkeypatch.setattr(D, "SHARD", 2000)
    asked = []
    keep = D.repeats
    monkeypatch.setattr(D, "repeats", lambda pieces, length, steps=D.STEPS: asked.append(steps) or keep(pieces, length, steps))
    rows = corpus(7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(D.repeated_spans(df, 128)) == wanted(rows, 128)
    assert asked == [(32, 1), (1,), ()]


def test_keys_of_any_type(spark):
    rows = [("b", "t" * 500), ("a", "u" * 130 + "v"), (None, "u" * 130)]
    df = spark.createDataFrame(rows, "runs string, t string")
    assert result(D.repeated_spans(df, 128, key="runs", text="t")) == wanted(rows, 128)


def test_texts_are_not_shuffled_again(spark):
    """The table of distinct texts lies in buckets by digest: a join by digest has one exchange, on its other side."""
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("unhex(sha2(cast(string(id) as binary), 256)) c", "cast(string(id) as binary) t")
        classes = D.bucketed(df, "c")
        joined = classes.join(classes.groupBy("c").count().where("count > 0"), "c").join(D.saved(df.select("c", "t")).groupBy("c").count().withColumnRenamed("count", "m"), "c")
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning(") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


def test_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    df = D.query(spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    want = [(k, n, sum(b - a for a, b in spans), len(spans), rest) for (k, _), (n, spans, rest) in zip(docs, brute([t for _, t in docs], 400))]
    assert sorted(map(tuple, df.collect())) == sorted(want)
