import pytest

from colweave.llm import decontamination as D
from colweave.llm import toxicity as T
from colweave.llm.common import words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def grams(t):
    w = (t or "").encode().translate(__import__("colweave.llm.common", fromlist=["LOWER"]).LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    model = T.learn(docs, labels)
    toxic = {r.doc_id for r in T.scores(docs, model).collect() if r["__score"] >= 0.3}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    left = {k: t for k, t in left.items() if t and any(c.isalpha() for c in t)}
    g, label = {k: grams(t) for k, t in left.items()}, {k: k for k in left}
    changed = True
    near = [(a, b) for a in left for b in left if a < b and len(g[a] & g[b]) >= 0.8 * len(g[a] | g[b])]
    while changed:
        changed = False
        for a, b in near:
            m = min(label[a], label[b])
            if (label[a], label[b]) != (m, m):
                label[a] = label[b] = m
                changed = True
    left = {k: t for k, t in left.items() if label[k] == k}
    phrases = D.Phrases([tuple(r) for r in bench.select("item_id", "text").collect()])
    windows = {tuple(w) for w in ([x.encode() for x in p] for p in ())}
    for r in bench.collect():
        w = words(r.text.encode())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    assert len(windows) == len(phrases.codes)
    want = {}
    for k, t in left.items():
        w, hit = words(t.encode()), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or len(hit) < len(w):
            want[k] = len(w) - len(hit)
    assert set(out) == set(want)
    from colweave.llm.sentencepiece_lattice import pieces_of
    import public_tokenizers

    pieces = pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    for k, r in out.items():
        assert len(words(pieces.decode(list(r.ids)).encode())) == want[k]
        assert all(pieces.decode(list(s.ids)) == pieces.decode(list(r.ids)) for s in r.samples)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some text here", "en", "s", 14), (None, "some text here", "en", "s", 14), (3, "some text here", "en", "s", 14)], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, SF)
            assert out.columns == d.columns, name
            out.collect()
    assert [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).where("text = 'some text here'").collect()] == [3]
