import collections
import math

import numpy as np
import public_tokenizers

from colweave.llm import sentencepiece_lattice as L

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "Hello world", "  Hello  world \n\tfoo ", "① ｆ 日本語 naïve", "a", "word▁under", "x" * 300, "the end.  ", "été\r\n\x00 z", "🙂🙂 ok"]


def test_encoding_and_decoding_as_the_library(spark):
    sp = L.load(PATH)
    rows = [(i, t, [1]) for i, t in enumerate(TEXTS)] + [(100, None, [1]), (None, "again", [1]), (2, "Hello world", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>").repartition(3)
    got = L.encode(df, PATH, samples=3).collect()
    assert len(got) == len(rows)
    texts = dict((k, t) for k, t, _ in rows)
    for r in got:
        t = texts[r.doc_id]
        assert list(r.ids) == sp.encode(t or "")
        if t is None:
            assert r.decoded is None
        else:
            assert r.decoded == t.replace("▁", " ") == sp.decode(list(r.ids))
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples) >= 1
        for s in r.samples:
            assert L.pieces_of(PATH).decode(list(s.ids)) == (t or "").replace("▁", " ")
            assert 0 < s.inclusion <= 1
        assert [s.perturbed for s in r.samples] == sorted((s.perturbed for s in r.samples), reverse=True)
    twice = [r for r in got if r.doc_id == 2]
    assert twice[0] == twice[1]
    again = {r.doc_id: r for r in L.encode(df.repartition(1), PATH, samples=3).collect()}
    assert all(again[r.doc_id] == r for r in got)
    back = {r.doc_id: r.text for r in L.decode(L.encode(df, PATH, samples=0), PATH).collect()}
    assert all((texts[k] or "").replace("▁", " ") == v for k, v in back.items())
    assert L.encode(df.limit(0), PATH).count() == 0


def ways(pieces, chunk):
    """All segmentations of a chunk with their weights, by recursion."""
    if not chunk:
        yield (), 0.0
        return
    for j in range(1, len(chunk) + 1):
        p = pieces.ids.get(chunk[:j], -1)
        options = [((p,), pieces.weight[p])] if p >= 0 else []
        if j == 1 and p < 0:
            b = chunk[0].encode()
            options = [(tuple(pieces.bytes[x] for x in b), pieces.byte_weight * len(b))]
        for ids, w in options:
            for rest, v in ways(pieces, chunk[j:]):
                yield ids + rest, w + v


def test_draws_follow_the_shares_without_replacement():
    pieces = L.pieces_of(PATH)
    lattices = L.Lattices(pieces)
    text = ["ab", "of"]
    numbers = lattices.numbers(text)
    whole = {a + b: x + y for a, x in ways(pieces, "▁ab") for b, y in ways(pieces, "▁of")}
    total = sum(math.exp(w) for w in whole.values())
    share = {s: math.exp(w) / total for s, w in whole.items()}
    n = 6000
    seeds = np.array([L.hash_key(i, 5) for i in range(n)], dtype=np.uint64)
    out = L.sample(lattices, [numbers] * n, seeds, 3)
    first, second = collections.Counter(), collections.Counter()
    estimate = collections.Counter()
    for rows in out:
        got = [tuple(lattices.ids_of(a).tolist()) for a, *_ in rows]
        assert len(set(got)) == 3
        for s, (_, lp, _, q) in zip(got, rows):
            assert abs(lp - math.log(share[s])) < 1e-9
            estimate[s] += share[s] / q / n
        first[got[0]] += 1
        second[got[1]] += 1
    # second draws: sum over the first of p(first) p / (1 - p(first))
    for s, p in share.items():
        want = sum(share[f] * p / (1 - share[f]) for f in share if f != s)
        for counted, expected in ((first[s] / n, p), (second[s] / n, want)):
            assert abs(counted - expected) < 5 * math.sqrt(expected * (1 - expected) / n) + 1e-3
    assert abs(sum(estimate.values()) - 1) < 0.05  # shares over inclusion scores add up to 1 on average


def test_all_segmentations_of_a_small_text():
    pieces = L.pieces_of(PATH)
    lattices = L.Lattices(pieces)
    every = {i for i, _ in ways(pieces, "▁of")}
    rows = L.sample(lattices, [lattices.numbers(["of"])], np.array([7], dtype=np.uint64), 50)[0]
    assert {tuple(lattices.ids_of(a).tolist()) for a, *_ in rows} == every and len(rows) == len(every)
    assert all(q == 1 for *_, q in rows)


def test_keys_of_any_type_and_small_steps(spark):
    texts = ["one two three", "", None, "drei  vier\n", "één \U0001f600", "one two three"] + ["word " * 500]
    as_text = spark.createDataFrame([(f"k{i}" if i else None, t, 1) for i, t in enumerate(texts)], "doc_id string, text string, ids int")
    rows = lambda df, **more: sorted(str(r) for r in L.encode(df, PATH, **more).collect())
    assert len(rows(as_text)) == len(texts) and rows(as_text) == rows(as_text.repartition(3), kept_chunks=1, at_a_time=2)
    assert dict(L.encode(as_text, PATH).dtypes)["doc_id"] == "string" and L.encode(as_text.limit(0), PATH).count() == 0
    short, long = (spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"doc_id {k}, text string") for k in ("smallint", "bigint"))
    assert rows(short) == rows(long)
    for r in L.encode(long, PATH).collect():
        assert r.decoded == texts[r.doc_id] and all(L.pieces_of(PATH).decode(list(s.ids)) == (texts[r.doc_id] or "") for s in r.samples)
