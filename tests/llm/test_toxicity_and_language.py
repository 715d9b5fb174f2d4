import random
import zlib

from pyspark.sql import functions as F

from colweave.llm import language as G
from colweave.llm import toxicity as T


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    good = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    bad = ["nasty", "vileone", "grossly", "hatefulx", "meanish", "rotten"] + [f"qrudex{c}" for c in "abcdefgh"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [rng.choice(good) for _ in range(rng.randrange(5, 200))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad)
        docs.append((i, " ".join(w), "en"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_cases(spark):
    docs, labels = corpus()
    docs += [(5000, None, None), (5001, "", "xx"), (5002, "nasty " * 20000, "en"), (None, "nasty rotten vileone meanish grossly", "en")]
    labels += [labels[0], (77777, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(k, t, x, 1.0) for k, t, x in docs], "doc_id long, text string, lang string, score double").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.learn(df, lab)
    got = {r.doc_id: r["__score"] for r in T.scores(df, model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    held = [i for i, *_ in docs[:600] if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = [i for i in held if (got[i] >= 0.3) != (i % 5 == 0)]
    assert len(wrong) <= 0.06 * len(held)
    assert got[5000] == got[5001] < 0.3 and got[None] >= 0.3
    assert model.correlations.shape[0] == T.LEXICONS + len(T.fixed_votes(b"", []))
    # scores come from texts alone, labels of held-out rows aren't looked at
    flipped = spark.createDataFrame([(k, q, 1 - t if k is not None and zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, q, t in labels], lab.schema)
    assert T.learn(df, flipped).weights == model.weights
    none = T.learn(df, lab.limit(0))
    assert {r["__score"] < 0.6 for r in T.scores(df, none).collect()} == {True}
    assert T.scores(df.limit(0), model).count() == 0


def test_label_model_without_labels():
    """Voters of 0.8 accuracy, one of them copied twice: the copies must not outvote the others, and posteriors must be those of the true model."""
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.3
    draw = lambda right: np.where(rng.random(len(y)) < right, y, ~y).astype(float)
    own = [draw(0.8) for _ in range(5)]
    votes = np.stack([own[0], own[0], own[0], *own[1:]], axis=1)
    m = T.LabelModel(votes, (votes.sum(axis=1) >= 4).astype(float))
    assert m.correlations[0, 1] > 20 * m.correlations[0, 4] and {int(m.parent[i]) for i in (0, 1, 2)} <= {-1, 0, 1, 2} and all(m.parent[3:] == -1)
    assert abs(m.prior - 0.3) < 0.03 and np.abs(m.rates - np.array([[0.2], [0.8]])).max() < 0.05
    logit = np.log(0.3 / 0.7) + sum((2 * v - 1) * np.log(4) for v in own)
    assert np.abs(m.posterior(votes) - 1 / (1 + np.exp(-logit))).max() < 0.12
    alone = T.LabelModel(votes, y.astype(float))  # started from the truth it ends in the same place
    assert np.abs(alone.posterior(votes) - m.posterior(votes)).max() < 0.05


def test_much_repeated_keys(spark, monkeypatch):
    """A key of a thousand rows is one labelled row, on the driver as well; a column that is called as the score is replaced."""
    seen = []
    keep = T.one_per_family
    monkeypatch.setattr(T, "one_per_family", lambda rows: seen.append(len(rows)) or keep(rows))
    docs, labels = corpus(200)
    rows = [(i, t) for i, t, _ in docs]
    df = spark.createDataFrame([*rows, *rows[5:6] * 1000, (5, "another text under that key"), (None, "x")], "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, plain = T.learn(df, lab), T.learn(spark.createDataFrame([r for r in rows if r[0] != 5], "doc_id long, text string"), lab)
    assert max(seen) <= len({k for k, *_ in labels})
    again = T.scores(df.withColumn("__score", F.lit("old")), model)
    assert again.dtypes == [("doc_id", "bigint"), ("text", "string"), ("__score", "double")]
    got = {r.doc_id: r["__score"] for r in again.collect()}
    want = {r.doc_id: r["__score"] for r in T.scores(df, plain).collect()}
    assert sum((got[i] >= 0.3) == (want[i] >= 0.3) for i, _ in rows) >= 195


WORDS = {"en": "the of and to in that with which there", "de": "der die und nicht eine zwischen schön über", "fr": "le la les avec être français où déjà", "es": "el los una con español niño más también"}


def test_language(spark):
    rng = random.Random(3)
    say = lambda x, n=30: " ".join(rng.choice(WORDS[x].split()) for _ in range(n))
    docs = [(i, say(x), x, "s1", 0) for i, x in enumerate(["en", "de", "fr", "es"] * 60)]
    docs += [(1000, say("de", 60), "en", "s2", 0), (1001, None, "fr", "s1", 0), (1002, "", None, None, 0), (1003, "123 ... !!", "en", "s1", 0), (1004, say("es", 20000), None, "s9", 0)]
    pages = [(i, f"https://h{i % 4}.example.{x}/a", f"<html lang='{x}'><script>the of and</script><p>{say(x)}</p>") for i, x in enumerate(["de", "fr", "es"] * 20)] + [(900, None, None), (901, "junk", "<b>"), (902, "http://h1.example.de", f"<p>{say('de', 3)}")]
    ev = G.from_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_letters int")).unionByName(G.from_pages(spark.createDataFrame(pages, "page_id long, url string, html string")))
    out = G.identify(ev).collect()
    assert len(out) == len(docs) + len(pages)
    by_doc = {r.doc_id: r for r in out if r.doc_id is not None}
    by_page = {r.page_id: r for r in out if r.page_id is not None}
    assert all(by_doc[i].language == x and by_doc[i].accepted for i, _, x, _, _ in docs[:240])
    assert by_doc[1000].language == "de" and by_doc[1004].language == "es"
    assert not any(by_doc[i].accepted for i in (1001, 1002, 1003)) and by_doc[1001].language == "fr"
    assert all(by_page[i].language == ["de", "fr", "es"][i % 3] for i in range(60))
    assert by_page[902].language == "de" and not by_page[900].accepted
    assert all(0 < r.posterior <= 1 for r in out)
    assert G.identify(ev.limit(0)).count() == 0
    few = G.BROADCAST_HOSTS
    try:
        G.BROADCAST_HOSTS = 0
        joined = G.identify(ev).collect()
    finally:
        G.BROADCAST_HOSTS = few
    assert sorted(map(str, joined)) == sorted(map(str, out))


def test_declared_language_wherever_the_tag_stands(spark):
    late, tag = "<!doctype html>" + " \n" * 5000, "<html class=a lang='de'>"
    pages = [late + tag, "<!-- <html lang='fr'> " + "x" * 9000 + " -->" + tag, "<!--><html lang=de>", "<!-- <html lang=fr>", "<script>'<html lang=fr>'</script>" + late + tag, tag + "<!-- -->", "<p>none", None]
    df = spark.createDataFrame([(i, "http://a.de", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.declared for r in G.from_pages(df).collect()}
    assert [got[i] for i in range(len(pages))] == ["de", "de", "de", None, "de", "de", None, None]


def test_more_languages_than_a_fixed_number(spark):
    """A hundred declared languages, one of them in a few texts only and a misspelt tag: each is found."""
    rng = random.Random(4)
    own = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(40)] for _ in range(100)]
    say = lambda i, n=40: " ".join(rng.choice(own[i]) for _ in range(n))
    docs = [(k, say(k % 100), f"l{k % 100:02}", "s") for k in range(1200) if k % 100 != 99 or k < 300] + [(5000, say(0), "l0o", "s"), (5001, say(99), None, "s"), (5002, say(57), None, "s")]
    out = {r.doc_id: r for r in G.identify(G.from_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))).collect()}
    assert len(out) == len(docs)
    assert all(out[k].language == lang and out[k].accepted for k, _, lang, _ in docs if k < 5000)
    assert (out[5001].language, out[5002].language) == ("l99", "l57")


def plain_identify(rows, accept=0.5):
    """identify() by loops over rows (text, declared, suffix, host, page)."""
    import math
    from collections import Counter, defaultdict

    languages = [*sorted({d for _, d, *_ in rows if d is not None}), "und"]
    place = {x: i for i, x in enumerate(languages)}
    grams = [[g for w in G.LETTERS.findall(G.visible(t, page)) for g in G.trigrams(w)] for t, _, _, _, page in rows]
    letters = [sum(map(len, G.LETTERS.findall(G.visible(t, page)))) for t, _, _, _, page in rows]
    counts = [Counter() for _ in languages]
    said = [Counter() for _ in languages]
    for t, d, _, _, page in rows:
        if d in place:
            said[place[d]].update(G.LETTERS.findall(G.visible(t, page)))
    for c, own in zip(counts, said):
        for w, m in own.items():
            for g in G.trigrams(w):
                c[g] += G.ONCE if m == 1 else m
    totals = [sum(c.values()) for c in counts]
    text = [[sum(math.log((c[g] + G.SMOOTHING) / (n + G.SMOOTHING * G.BUCKETS)) for g in own) * (min(1, G.TEXT_WEIGHT / len(own)) if own else 1) for c, n in zip(counts[:-1], totals)] + [-math.log(G.BUCKETS) * min(G.TEXT_WEIGHT, len(own))] for own in grams]
    best = [max(range(len(languages)), key=lambda i: (own[i], -i)) if n else None for own, n in zip(text, letters)]
    tally = {f: defaultdict(lambda: [0] * len(languages)) for f in (1, 2, 3)}
    overall = [1] * len(languages)
    for r, i in zip(rows, best):
        if i is not None:
            overall[i] += 1
            for f in (1, 2, 3):
                tally[f][r[f]][i] += 1
    prior, s, n = [x / sum(overall) for x in overall], G.STRENGTH, len(languages)
    rest = [sum(v[i] for d, v in tally[1].items() if d not in place) for i in range(n)]
    suffix_prior = {x: [(c[i] + s * prior[i]) / (sum(c) + s) for i in range(n)] for x, c in tally[2].items()}
    out = []
    for (t, d, suffix, host, _), own, m in zip(rows, text, letters):
        logs = list(own) if m else [0.0] * n
        above = suffix_prior.get(suffix, prior) if suffix is not None else prior
        for i in range(n):
            known = tally[3].get(host) if host is not None else None
            logs[i] += math.log((known[i] + s * above[i]) / (sum(known) + s)) if known else math.log(prior[i])
            if suffix is not None and suffix in tally[2] and known:
                c = tally[2][suffix]
                logs[i] += math.log((c[i] + s * (sum(c) + 1) / sum(overall)) / (overall[i] + s))
            if d in place:
                c = tally[1][d]
                logs[i] += math.log((c[i] + s * (sum(c) + 1) / (sum(overall) + n)) / (overall[i] - 1 - rest[i] + s))
        top = max(logs)
        posterior = 1 / sum(math.exp(x - top) for x in logs)
        out.append((languages[logs.index(top)], posterior, m, bool(m) and posterior >= accept and logs.index(top) < n - 1))
    return out


def test_fusion_against_plain_loops(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        lang = rng.choice(list(WORDS))
        t = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(1, 30)))
        page = i % 3 == 0
        host = f"h{rng.randrange(6)}.{rng.choice(['de', 'fr', 'com'])}" if page else f"source:{lang if rng.random() < 0.8 else 'mixed'}"
        said = rng.choice([lang, lang, rng.choice(list(WORDS)), None])
        rows.append((f"<p>{t}</p>" if page else t, said, host.rsplit(".", 1)[1] if page else None, host, page))
    rows += [("123", "en", None, "source:en", False), (None, None, None, None, False), ("the of", "xx", None, None, False), (rows[1][0], *rows[1][1:])]
    df = spark.createDataFrame([(None if r[4] else i, i if r[4] else None, *r[:4], i) for i, r in enumerate(rows)], "doc_id long, page_id long, x string, declared string, suffix string, host string, row long").repartition(3)
    got = {r.row: r for r in G.identify(df).collect()}
    want = plain_identify(rows)
    assert len(got) == len(rows)
    for i, (language, posterior, n, accepted) in enumerate(want):
        assert abs(got[i].posterior - posterior) < 1e-4 and got[i].n_letters == n, i  # scores of words are kept as single floats
        if posterior > 0.5001:
            assert (got[i].language, got[i].accepted) == (language, accepted), i


def test_texts_of_no_language(spark):
    """Random consonants are refused, whatever they are declared as; prose is kept, also a few words, also undeclared; keys are texts here."""
    rng = random.Random(11)
    junk = lambda n: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(n))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"), "source")
    more = spark.createDataFrame([(f"j{i}", junk(rng.randint(3, 60)), rng.choice(["en", "de", None, "und"]), f"s{i % 3}") for i in range(200)], "doc_id string, text string, lang string, source string")
    df, n = docs.unionByName(more), docs.count()
    left = {r.doc_id for r in G.accepted_documents(df).collect()}
    assert sum(k[0] == "d" for k in left) >= 0.99 * n and sum(k[0] == "j" for k in left) <= 10
    found = {r.doc_id: r.language for r in G.identify(G.from_documents(df)).collect()}
    assert sum(found[f"j{i}"] == "und" for i in range(200)) >= 190
    assert sum(found[r.doc_id] == r.lang for r in docs.where("lang IS NOT NULL").collect()) >= 0.75 * n
    unheard = df.withColumn("lang", F.lit(None).cast("string"))
    assert G.accepted_documents(unheard).count() == n + 200  # no language is known: nothing can be told


def test_many_declared_values(spark):
    """Misspelt tags by the hundred: pairs that occur are kept, and results are as those of plain loops."""
    rng = random.Random(12)
    rows = [(" ".join(rng.choice(WORDS["en"].split()) for _ in range(12)), f"en{i}", None, f"h{i % 7}", False) for i in range(150)]
    rows += [(" ".join(rng.choice(WORDS["de"].split()) for _ in range(12)), "de", None, None, False) for _ in range(100)]
    df = spark.createDataFrame([(i, None, *r[:4], i) for i, r in enumerate(rows)], "doc_id long, page_id long, x string, declared string, suffix string, host string, row long").repartition(3)
    few = G.BROADCAST_HOSTS
    try:
        for G.BROADCAST_HOSTS in (few, 2):
            got = {r.row: r for r in G.identify(df).collect()}
            for i, (language, posterior, n, accepted) in enumerate(plain_identify(rows)):
                assert abs(got[i].posterior - posterior) < 1e-4 and got[i].n_letters == n, i
    finally:
        G.BROADCAST_HOSTS = few


def test_clashing_names(spark):
    """Columns of the tables that have the names a stage might use itself stay as they are."""
    from colweave.llm import decontamination as D
    from colweave.llm import simhash as S

    names = ["__score", "score", "row", "__row", "digest", "__digest", "__key", "hits", "items", "__hits", "k", "y", "__k", "__y", "f", "g", "x", "t", "group_key"]
    docs, labels = corpus(120)
    df = spark.createDataFrame([(i, t, lang, "s", *range(len(names))) for i, t, lang in docs], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in names))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("a", docs[1][1]), ("b", None)], "item_id string, text string")
    for out in (T.clean_documents(df, lab), G.accepted_documents(df), S.one_of_each_group(df), D.cleaned(df, bench)):
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(tuple(r[4:]) == tuple(range(len(names))) for r in rows)
    found = {r.doc_id: r["items"] for r in D.decontaminate(df.withColumn("doc_id", df.doc_id.cast("string")), bench).collect()}
    assert found["1"] == ["a"] and set(found) == {str(i) for i, *_ in docs}
