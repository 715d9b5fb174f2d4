import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colweave.llm import fill_in_middle as M

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(key, text, seed="1:", plain=10, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain:
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", " ", "ab", "ab cd", "é", "aé😀b  c\n\nd", "日本語 text 日本", "<P>x", "x <M> y", "<P", "a<", "S>P>b", "x" * 50_000, "😀 " * 20_000, "a b" * 30_000, "\u0000a\u0000", "\r\n"]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z<>PSM0é😀\n"), max_size=30), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
def test_cuts_of_one_text(text, draws):
    n, form, prefix, middle, output = M.transformed(text.encode(), draws, 10, 20)
    units = UNIT.findall(text)
    assert n == len(units)
    assert M.restored(output, form) == text.encode()
    if form == "plain":
        assert not text or any(x in text for x in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= 90
        assert (prefix, middle, output) == (None, None, text.encode())
    else:
        a, b = sorted(d % (n + 1) for d in draws[:2])
        assert (prefix, middle) == (len("".join(units[:a])), len("".join(units[a:b])))


def test_rows_of_a_table(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS * 3)] + [(7, TEXTS[7], "x"), (None, "no key at all", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    for options in ({}, {"seed": "9:", "plain_percent": 0, "spm_percent": 100}, {"plain_percent": 100}):
        got = sorted((tuple(r) for r in M.fill_in_middle(df, **options).collect()), key=str)
        names = dict(zip(options, options.values()))
        want = [brute(k, t, names.get("seed", "1:"), names.get("plain_percent", 10), names.get("spm_percent", 20)) for k, t, _ in rows]
        assert got == sorted(want, key=str)
    assert M.fill_in_middle(df.limit(0)).count() == 0
    assert M.digests(M.fill_in_middle(df.limit(0))).count() == 0


def test_other_keys_and_names(spark):
    df = spark.createDataFrame([("a", "one two", 1, 2), ("b", "", 3, 4), (None, "x", 5, 6)], "`form` string, h string, t int, k int")
    got = {r["form"]: (r.n, r.output) for r in M.fill_in_middle(df.selectExpr("form as name", "h", "t", "k", "form"), key="name", text="h").withColumnRenamed("form", "f").withColumnRenamed("name", "form").collect()}
    assert got == {k: (brute(k, t)[1], brute(k, t)[5]) for k, t in (("a", "one two"), ("b", ""), (None, "x"))}


def test_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    df = M.query(spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(tuple, df.collect())) == sorted((*brute(k, t)[:5], sha(brute(k, t)[5]), sha(t or "")) for k, t in docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.sql(M.ORACLE).fetchall()) == sorted((r.doc_id, *(r[c] for c in con.sql(M.ORACLE).columns[1:])) for r in df.collect())


@pytest.mark.parametrize("text", ["", "abc", "a b"])
def test_every_cut(text):
    units = UNIT.findall(text)
    runs = M.Runs(text.encode())
    assert [runs.cut(i) for i in range(len(units) + 1)] == [len("".join(units[:i])) for i in range(len(units) + 1)]
