"""Operators on hand-made fixtures with expectations worked out by hand (FIXTURES.md, part C)."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colweave.functions import text as X
from colweave.functions import validators as V
from colweave.operators import classify as K
from colweave.operators import decide as D
from colweave.operators import decompose as P
from colweave.operators import evaluate as E
from colweave.operators import features as T
from colweave.operators import graph as G
from colweave.operators import models as M
from colweave.operators import search as S
from colweave.sources import files
from colweave.streaming.checks import conforming_share


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    split = {"patientAge": "patient Age", "a1b2C3": "a1 b2 C3", "HTMLParser": "HTMLParser", "x1,2": "x1 ,2"}
    for s, want in split.items():
        assert one(spark, X.split_case_and_digits(F.lit(s))) == want
    assert one(spark, X.clean_for_search(F.lit("Age (yrs)/BMI"))) == "age  yrs  bmi"
    assert one(spark, X.header_to_search_string(F.lit("patientGender"))) == "patient gender"
    assert one(spark, X.parse_answers(F.lit("Male\\ncit:C3|Female\\ncit:C4"))) == [["Male", "ncit:C3"], ["Female", "ncit:C4"]]
    assert [tuple(r) for r in one(spark, X.parse_concepts(F.lit("NCI:C1|NCI:C2")))] == [("NCI", "C1"), ("NCI", "C2")]
    assert one(spark, X.count_closeness(F.lit(3), F.lit(2))) == pytest.approx(0.8) and one(spark, X.count_closeness(F.lit(3), F.lit(0))) == 0
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert [one(spark, X.jaccard(*p)) for p in ((arr(), arr()), (arr("a"), arr()), (arr("a", "a", "b"), arr("b")))] == [1, 0, 0.5]
    assert one(spark, X.normalised_levenshtein(F.lit("Kitten"), F.lit("sitting"))) == pytest.approx(3 / 7) and one(spark, X.normalised_levenshtein(F.lit(""), F.lit(""))) == 0
    assert one(spark, X.clean_field(F.lit("NaN"))) is None and one(spark, X.clean_field(F.lit("Ab"), True)) == "ab"
    assert one(spark, X.exp_target(F.lit(1.0))) == 1 and one(spark, X.log_target(F.lit(1.0))) == pytest.approx(1)


GOOD = {"Integer": ["1", "1.0", "1e5", " 1 ", "-3"], "NUMBER": [".5", "5.", "nan", "inf"], "binary": ["0", "1", "0.9", "-0.5"], "CHARACTER": ["ab", "male"], "UMLBinaryv1.0": ["0110", ""], "DATE": ["x"]}
BAD = {"Integer": ["1.5", "abc", "", "nan", "1d"], "NUMBER": ["1,000", "0x10", "1f"], "binary": ["2", "-1", "x"], "CHARACTER": ["1", "1.5", "a", "1a2", ""], "UMLBinaryv1.0": ["012"]}
FITS = {"mm/dd/yyyy": ["2/29/2001", "12/31/1999"], "DD/MON/YYYY": ["01/Jan/2000"], "YYYY-MM-DD": ["2000-2-29"], "hh:mm": ["24:59"], "MMDDYYYY": ["123119"], "99.99": [".", "1.2", "12"], "9999.99": ["1.", "1234"], "%": ["5%", "5x5%", "12"], "YYYY": ["1999"], "unheard of": ["?"], "TIME (HR(24):MN)": ["?"]}
MISFITS = {"mm/dd/yyyy": ["13/01/1999", "4/31/1999", "1/1/99"], "DD/MON/YYYY": ["01/Foo/2000", "31/APR/2000"], "YYYY-MM-DD": ["2000-2-30"], "hh:mm": ["25:00", "1:60"], "MMDDYYYY": ["12311999"], "99.99": ["123"], "9999.99": [".5", "12345"], "%": ["5%%%"], "YYYY": ["1999\n"]}


def test_validators(spark):
    for good, bad, check in ((GOOD, BAD, V.check_datatype), (FITS, MISFITS, V.check_display_format)):
        rows = [(v, k, want) for cases, want in ((good, True), (bad, False)) for k, vs in cases.items() for v in vs]
        df = spark.createDataFrame(rows, "v string, k string, want boolean")
        assert df.where(check("v", "k") != F.col("want")).collect() == []
    assert one(spark, V.valid_hour(F.lit(13), 12)) is False
    df = spark.createDataFrame([("x", "Integer", None), ("x", "Integer", "YYYY"), ("1999", "DATE", "YYYY")], "v string, t string, f string")
    assert [r.x for r in df.select(V.conformity(V.conforms("v", "t", "f")).alias("x")).collect()] == ["NONCONFORMING", "NONCONFORMING", "CONFORMING"]


@pytest.fixture(scope="module")
def graph(spark):
    concepts = spark.createDataFrame([("C1", "Sex", None, "Sex|Gender", "T1", None), ("C2", "Person", None, "Person|Patient", "T1|T2", None), ("C3", "Male", None, "Male|M", None, "C1"), ("C4", "Female", None, "Female", None, "C1|C9"), ("C5", "Age", None, "Age", None, None)], "CODE string, CONCEPT_NAME string, DEFINITION string, SYNONYMS string, SEMANTIC_TYPE string, PARENTS string")
    cols = "CDE_ID long, CDE_LONG_NAME string, CDE_SHORT_NAME string, VALUE_DOMAIN_TYPE string, DATATYPE string, UNIT_OF_MEASURE string, DISPLAY_FORMAT string, QUESTION_TEXT string, DEC_ID long, DEC_LONG_NAME string, OBJECT_CLASS_CONCEPTS string, PROPERTY_CONCEPTS string, CLASSIFICATIONS string, PERMISSIBLE_VALUES string"
    rows = [(100, "Person Gender", "PERSON_GENDER", "Enumerated", None, None, None, "What is the gender?", 10, "Person Gender", "X:C2", "X:C1", "T - V\\C", "Male\\ncit:C3|Female\\ncit:C4"), (101, "Patient Age", "AGE", "NonEnumerated", "Integer", None, None, None, 11, "Patient Age", "X:C2", "X:C5", None, None), (102, "Birth", "BIRTH", "NonEnumerated", "DATE", None, "MM/DD/YYYY", None, 11, "Patient Age", "X:C2", "X:C5", None, None)]
    return G.build(concepts, spark.createDataFrame(rows, cols))


def test_graph(spark, graph, tmp_path):
    assert {k: n.count() for k, n in graph.nodes.items()} == {"Concept": 5, "Synonym": 8, "SemanticType": 2, "CDE": 3, "CDE_Name": 3, "QuestionText": 1, "DEC": 2, "Classification": 1, "Answer": 2, "AnswerText": 2}
    assert graph.edges["IS_CHILD"].count() == 2 and graph.edges["IS_OBJ"].count() == 3 and graph.edges["EQUALS"].count() == 2
    assert graph.nodes["Classification"].select("type", "value", "context").first()[:] == ("T", "V", "C")
    for n in graph.nodes.values():
        assert G.duplicates(n, "id").count() == 0
    syn = graph.nodes["Synonym"].where("name IN ('Gender', 'Patient')").select(F.lit("q").alias("query_id"), F.col("id").alias("node"), "label", F.when(F.col("name") == "Gender", 2.0).otherwise(3.0).alias("score"))
    out = G.propagate(syn, graph).join(graph.nodes["CDE"].withColumnRenamed("id", "target"), "target")
    got = {r.cde_id: (r.syn_propsum, r.syn_propmax, r.syn_objsum, r.syn_objmax, r.syn_classsum, r.ftsearch_cde) for r in out.collect()}
    assert got == {100: (2, 2, 3, 3, 0, 0), 101: (0, 0, 3, 3, 0, 0), 102: (0, 0, 3, 3, 0, 0)}
    graph.save(f"{tmp_path}/g")
    back = G.Graph.load(spark, f"{tmp_path}/g", graph.nodes, graph.edges)
    assert back.nodes["CDE"].count() == 3 and back.edges["PERMITS"].count() == 2
    counts = T.answer_counts(graph.nodes["CDE"].select(F.col("id").alias("target"), "cde_id", "datatype", F.lit(10).alias("rows")), graph.edges["PERMITS"])
    assert sorted(r.n_answers for r in counts.collect()) == [2, 10, 10]


def test_values(spark):
    values = spark.createDataFrame([("c", v) for v in ("Male", "Female", "Unknown")], "g string, value string")
    permitted = spark.createDataFrame([(100, "Male"), (100, "female")], "target long, value string")
    assert [tuple(r) for r in S.exact_share(values, permitted, "g", "value", "target").collect()] == [("c", 100, pytest.approx(2 / 3))]
    answers = spark.createDataFrame([(100, "m", "Male", "Male", "C3"), (100, "f", "Female", "Female", "C4")], "target long, answer string, synonym string, answer_text string, code string")
    hits = answers.withColumn("value", F.col("synonym")).withColumn("score", F.lit(1.0))
    got = {r.value: (r.permissible, r.code) for r in D.classify_values(values.withColumn("target", F.lit(100).cast("long")), answers, hits).collect()}
    assert got == {"Male": ("Male", "C3"), "Female": ("Female", "C4"), "Unknown": ("NOMATCH", None)}
    nodes = spark.createDataFrame([(1, 5, "NOMATCH"), (1, 5, "x"), (1, 6, "x"), (1, 6, "x"), (1, 7, "x")], "cde_id long, target long, permissible string")
    assert [tuple(r) for r in D.best_node_of(nodes).collect()] == [(1, 6)]


def test_decomposition(spark):
    words = ["survival", "time", "days", "day"]
    for seed in range(300):  # against all maximal segmentations, one after another
        rng = random.Random(seed)
        text = "".join(rng.choice("abc  ") for _ in range(rng.randrange(1, 13)))
        few = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 4))).strip() for _ in range(6)} - {""})
        spots, every = P.places(text, few), {}

        def walk(at, parts, gap, text=text, spots=spots, every=every):
            if at == len(text):
                full = " ".join(p.strip(" ") for p, _ in parts if p.strip(" "))
                covered = sum(len(p.replace(" ", "")) for p, known in parts if known)
                every[full] = max(every.get(full, 0), covered / len(text) * (1 - (full.count(" ") + 1) / len(text)))
                return
            for a, b in spots:
                if a == at:
                    walk(b, [*parts, (text[a:b], True)], False)
            if not gap:
                for to in range(at + 1, len(text) + 1):
                    if not any(at <= a and b <= to for a, b in spots):
                        walk(to, [*parts, (text[at:to], False)], True)

        walk(0, [], False)
        want = sorted(((-round(v, 9), k) for k, v in every.items() if v > 0))[:3]
        assert [(-round(v, 9), k) for k, _, v in P.best_segmentations(text, few)] == want, (text, few)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    many, began = sorted({(alphabet * 2)[i : i + k] for i in range(26) for k in range(3, 11)}), time.perf_counter()
    assert len(many) >= 200 and P.best_segmentations(alphabet * 2, many)[0][2] > 0.8 and time.perf_counter() - began < 0.5
    text = "".join(rng.choice("ab") for _ in range(400))
    assert len(P.best_segmentations(text, ["aba", "bab", "abab", "bb", "aab"])) == 3
    strings = spark.createDataFrame([("s", "survivaltimeindays"), ("e", ""), ("n", None)], "id string, text string")
    out = P.decompose(strings, spark.createDataFrame([(w,) for w in words], "word string")).orderBy("rank").collect()
    assert [(r.id, r.segments, round(r.score, 6)) for r in out] == [("s", "survival time in days", 0.691358), ("s", "survival time in day s", 0.601852)]


def test_words_in_texts(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis" * 2
    texts = spark.createDataFrame([(1, f"x{long}y ab"), (2, None), (3, ""), (4, "AB"), (4, "ab")], "id long, text string")
    words = spark.createDataFrame([(w,) for w in (long, "a", "AB", "ab", "abc", "", None, "conio")], "word string")
    got = sorted(tuple(r) for r in S.contained_words(texts, words, "id", "text", "word").collect())
    assert got == sorted([(1, long), (1, "a"), (1, "ab"), (1, "conio"), (4, "a"), (4, "ab"), (4, "a"), (4, "ab")])


def test_search(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "c"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "b")], "query_id long, query_text string")
    hits = S.bm25(docs, q).collect()
    avg, n = 4 / 2, 3
    assert len(hits) == 1 and hits[0].score == pytest.approx(math.log(1 + (n - 1 + 0.5) / 1.5) * 2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)))
    first = spark.createDataFrame([(1, "a")], "q long, t string")
    second = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "q long, t string")
    got = {tuple(r) for r in S.secondary_search(first, second, "q", "t", 2).collect()}
    assert got == {(1, "a", 0), (1, "b", 1), (2, "c", 1)}


def test_decisions_and_scores(spark):
    for p, want in ((0.39, "a,b,c"), (0.4, "a,NOMATCH,b"), (0.49, "a,NOMATCH,b"), (0.5, "NOMATCH,a,b")):
        assert one(spark, F.array_join(D.ranked_results(F.array(*map(F.lit, "abc")), F.lit(p)), ",")) == want
    assert one(spark, D.ranked_results(F.array().cast("array<string>"), F.lit(0.1))) == ["NOMATCH"]
    for rank, want in ((1, 4.0), (2, 3.0), (3, 2.0)):
        assert one(spark, E.score(F.lit(rank), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == want
    assert one(spark, E.score(F.lit(1), F.lit(0.0), F.lit(1 / 3), F.lit(0.0))) == pytest.approx(0.444444, abs=1e-6)
    t, f = F.lit(True), F.lit(False)
    assert one(spark, E.score(F.lit(1), *E.metrics(t, t, f, F.lit(0.0), F.lit(0.0)))) == 4
    assert one(spark, E.score(F.lit(1), *E.metrics(t, f, f, F.lit(0.7), F.lit(0.7)))) == 0


def test_stored_index(spark, graph, tmp_path):
    fresh = S.Index.build(G.name_entries(graph))
    fresh.save(f"file://{tmp_path}/names")
    stored = S.Index.load(spark, f"file://{tmp_path}/names")
    q = spark.createDataFrame([("a", "person gender"), ("b", "nothing here"), ("c", None)], "query_id string, query_text string")
    rows = lambda i: sorted((r.query_id, r.label, r.node, round(r.score, 9)) for r in i.search(q).collect())
    assert rows(fresh) == rows(stored) and {r[1] for r in rows(fresh)} == {"Synonym", "CDE", "CDE_Name", "DEC", "QuestionText"}
    cde = [r[3] for r in rows(fresh) if r[1] == "CDE"]
    assert len(cde) == 1  # names of elements and their long names are two fields, whose scores add up
    own = S.bm25(G.name_entries(graph).where("field = 'CDE_LONG_NAME'").select("node", "text"), q, "node").collect()
    named = S.bm25(G.name_entries(graph).where("field = 'name'").select("node", "text"), q, "node").join(graph.nodes["CDE"].select(F.col("id").alias("node")), "node").collect()
    assert cde[0] == pytest.approx(sum(r.score for r in own) + sum(r.score for r in named))


def test_sheet_end_to_end(spark, graph, tmp_path):
    """FIXTURES.md C1: the column patientGender, and a column and a sheet without anything."""
    sheet = spark.createDataFrame([(v, None) for v in ["Male"] * 6 + ["Female"] * 3 + ["Unknown"]] + [(None, None)] * 2, "patientGender string, `zz.q` string")
    columns, cells = K.columns_and_cells({"one.tsv": sheet, "two.csv": spark.createDataFrame([], "a string")})
    names, answers = K.indexes(spark, graph, f"file://{tmp_path}/index")
    words = graph.nodes["Synonym"].select(F.col("name_lower").alias("word"))
    features = K.candidate_features(columns, cells, graph, names, answers, words)
    got = {(r.sheet, r.col_no, r.cde_id): r for r in features.collect()}
    assert set(got) == {("one.tsv", 1, 100), ("one.tsv", 1, 101), ("one.tsv", 1, 102)}
    assert [round(got["one.tsv", 1, i].answer_count_score, 6) for i in (100, 101, 102)] == [0.8, 0.461538, 0.461538]
    assert [round(got["one.tsv", 1, i].value_score, 6) for i in (100, 101, 102)] == [0.666667, 0, 0]
    assert got["one.tsv", 1, 100].syn_propmax > 0 and got["one.tsv", 1, 101].syn_propmax == 0 and got["one.tsv", 1, 101].syn_objmax > 0
    expanded = K.expanded_features(features)
    golden = spark.createDataFrame([("one.tsv", 1, 101), ("one.tsv", 2, None)], "sheet string, col_no int, cde_id long")
    training = {r.cde_id: r for r in K.training_rows(expanded, golden, graph).collect()}
    assert [round(training[i].metric2, 6) for i in (100, 101, 102)] == [0.333333, 1, 1] and [training[i].metric1 for i in (100, 101, 102)] == [0, 1.5, 0]
    fixed = lambda name, c: lambda df: df.withColumn(name, c)
    out = K.classify_sheets(columns, cells, graph, names, answers, fixed("p_nomatch", F.lit(0.45)), fixed("estimate", F.col("value_score") + F.col("cde_id") / 1e6))
    files.write_submissions(out, f"file://{tmp_path}/out")
    first = json.loads((tmp_path / "out" / "one-Submission.json").read_text())["columns"]
    assert [c["headerValue"] for c in first] == ["patientGender", "zz.q"]
    names_ = [r["result"]["dataElement"]["name"] for r in first[0]["results"]]
    assert names_ == ["Person Gender", "NOMATCH", "Birth"] and [r["result"]["dataElement"]["name"] for r in first[1]["results"]] == ["NOMATCH"]
    best = first[0]["results"][0]["result"]
    assert best["dataElementConcept"] == {"id": 10, "name": "Person Gender", "conceptCodes": ["ncit:C1", "ncit:C2"]}
    assert [(v["observedValue"], v["permissibleValue"]["value"], v["permissibleValue"]["conceptCode"]) for v in best["valueDomain"]] == [("Female", "Female", "ncit:C4"), ("Male", "Male", "ncit:C3"), ("Unknown", "NOMATCH", None)]
    assert {v["permissibleValue"]["value"] for v in first[0]["results"][2]["result"]["valueDomain"]} == {"NONCONFORMING"} and first[1]["results"][0]["result"]["valueDomain"] == []
    assert json.loads((tmp_path / "out" / "two-Submission.json").read_text())["columns"][0]["results"][0]["result"]["dataElement"]["name"] == "NOMATCH"


def test_fitted_models_decide(spark):
    rng = random.Random(1)
    rows = [("s", i // 4, i, i, *(rng.random() for _ in range(16))) for i in range(160)]
    names = [*(f for f in K.FEATURES if f != "secondary_search"), "p", "q", "r"]
    df = spark.createDataFrame(rows, "sheet string, col_no int, target long, cde_id long, " + ", ".join(f"{n} double" for n in names[:16])).withColumn("secondary_search", F.lit(0))
    ex = K.expanded_features(df).withColumns({"y": (F.col("max_syn_propmax") > 0.8).cast("double"), "m": F.col("ftsearch_cde") + F.col("enum_concept_search")})
    none = M.logistic(M.NOMATCH_COLUMNS, "y", 40).fit(M.first_of_each(ex, K.COLUMN, ["target"]))
    value = M.ridge(ex, M.VALUE_COLUMNS, "m").fit(ex)
    columns = ex.select(*K.COLUMN).distinct().withColumn("header", F.lit("h"))
    out = K.decide_columns(columns, ex, *K.model_functions(none, value)).collect()
    assert len(out) == 40 and all(len(r.results) == 3 for r in out) and any("NOMATCH" in r.results for r in out) and any("NOMATCH" not in r.results for r in out)
    best = {r.col_no: r.cde_id for r in ex.withColumn("k", F.row_number().over(Window.partitionBy("col_no").orderBy(F.desc("m")))).where("k = 1").collect()}
    assert sum(str(best[r.col_no]) in r.results for r in out) >= 38
    grid = M.alpha_grid(ex.withColumn("metric1", F.lit(0.0)).withColumn("metric2", F.col("m")), ex.withColumn("metric1", F.lit(0.0)).withColumn("metric2", F.col("m")), M.VALUE_COLUMNS, "m", K.COLUMN, ["target"], [1e-3, 100.0])
    assert len(grid) == 2 and grid[0][1] >= grid[1][1]
    assert M.without(ex, spark.createDataFrame([("s", 0)], "sheet string, col_no int"), K.COLUMN).count() == 156
    assert M.forests("y", 5)[0].setFeaturesCol("features").fit(none.transform(M.first_of_each(ex, K.COLUMN, ["target"])).select("features", "y")).getNumTrees == 5
    for stage in M.reduced(M.VALUE_COLUMNS, 3):
        ex = stage.fit(ex).transform(ex) if hasattr(stage, "fit") else stage.transform(ex)
    assert len(ex.first().features) == 3
    assert M.lasso("m", 0.01).setFeaturesCol("features").fit(ex).coefficients is not None


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x y,Z\n1,NA\n,b\n")
    (tmp_path / "b.TSV").write_text("k\tv\n1\t2\n")
    assert files.list_tables(spark, f"file://{tmp_path}") == ["a.csv", "b.TSV"]
    df = files.read_table(spark, "a", f"file://{tmp_path}")
    assert [tuple(r) for r in df.collect()] == [("1", None), (None, "b")]
    assert files.read_table(spark, "b.TSV", f"file://{tmp_path}").first()[:] == ("1", "2")
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, "none", f"file://{tmp_path}")
    assert files.without_mount("/input/table-1.tsv") == "table-1.tsv"
    long = T.unpivoted(df, "s")
    assert {tuple(r) for r in T.profile(long).collect()} == {("s", 1, "x y", 1, 1, 0), ("s", 2, "Z", 1, 1, 0)}
    values = long.where("value IS NOT NULL").withColumn("permissible", F.lit("CONFORMING")).withColumn("code", F.lit(None).cast("string"))
    cols = D.value_domain(values, ["sheet", "col_no", "header"]).withColumn("results", F.array(D.nomatch_result(F.col("value_domain"))))
    files.write_submissions(D.submission(cols), f"file://{tmp_path}/out")
    text = (tmp_path / "out" / "s-Submission.json").read_text()
    assert [r.sheet for r in files.read_submissions(spark, f"file://{tmp_path}/out").collect()] == ["s"] and not (tmp_path / "out" / "_parts").exists()
    result = json.loads(text)["columns"][1]["results"][0]
    assert result["resultNumber"] == 1 and result["result"]["dataElement"] == {"id": None, "name": "NOMATCH"}
    assert result["result"]["valueDomain"] == [{"observedValue": "b", "permissibleValue": {"value": "CONFORMING", "conceptCode": None}}]
    (tmp_path / "Annotated.json").write_text(text)
    back = files.read_annotation(spark, f"file://{tmp_path}/Annotated.json").collect()
    assert [(r.col_no, r.result.dataElement.name) for r in back] == [(1, "NOMATCH"), (2, "NOMATCH")]


def test_expand_and_models(spark, tmp_path):
    df = spark.createDataFrame([("g", 1.0, 0), ("g", 3.0, 1), ("h", 0.0, 0)], "g string, a double, secondary_search int")
    got = {(r.g, r.a): r for r in T.expand(df, ["g"], ["secondary_search", "a"]).collect()}
    assert got["g", 3.0].a_frac == 1 and got["g", 3.0].a_norm == 1 and got["g", 1.0].max_secondary_search == 0.5 and got["h", 0.0].a_norm == 0
    train = spark.createDataFrame([(float(i % 7), float(i % 5), float(i % 7 > 3)) for i in range(200)], "a double, b double, y double")
    model = M.logistic(["a", "b"], "y", 200).fit(train)
    assert model.transform(train).where("prediction = y").count() > 180
    files.save_model(model, f"file://{tmp_path}/m")
    assert files.load_model(f"file://{tmp_path}/m").transform(train).count() == 200
    assert M.ridge(train, ["a", "b"], "y").fit(train).transform(train).count() == 200


def test_equal_scores_have_no_spread(spark):
    """Scores that differ in their last bit only, as sums in differing orders do, are no deviation to divide by; small true ones are."""
    same = spark.range(200).select(F.lit("g").alias("g"), F.lit(0).alias("secondary_search"), F.when(F.col("id") < 3, F.lit(0.1) + F.lit(0.2)).otherwise(F.lit(0.3)).alias("a"))
    assert same.select("a").distinct().count() == 2
    assert {r.a_norm for r in T.expand(same, ["g"], ["secondary_search", "a"]).collect()} == {0.0}
    small = spark.createDataFrame([("g", 1e-9, 0), ("g", 3e-9, 1)], "g string, a double, secondary_search int")
    assert [round(r.a_norm, 6) for r in T.expand(small, ["g"], ["secondary_search", "a"]).orderBy("a").collect()] == [-1.0, 1.0]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "1999", "DATE", "YYYY"), ("2024-01-01 00:02:00", "x", "DATE", "YYYY")], "ts string, v string, t string, f string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = conforming_share(stream, "ts", "v", "t", "f").writeStream.format("memory").queryName("shares").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.share, r.n) for r in spark.table("shares").collect()] == [(0.5, 2)]
