"""Graphs that grow by batches, keys that contradict each other, and stored walks."""

import pytest
from pyspark.sql import functions as F

from colweave.operators import graph as G

CONCEPTS = [(f"C{i}", f"concept {i}", None, f"name {i}|other {i % 7}", f"type {i % 3}", f"C{i // 2}") for i in range(30)]
CONCEPT_COLUMNS = "CODE string, CONCEPT_NAME string, DEFINITION string, SYNONYMS string, SEMANTIC_TYPE string, PARENTS string"
ELEMENT_COLUMNS = "CDE_ID long, CDE_LONG_NAME string, CDE_SHORT_NAME string, VALUE_DOMAIN_TYPE string, DATATYPE string, UNIT_OF_MEASURE string, DISPLAY_FORMAT string, QUESTION_TEXT string, DEC_ID long, DEC_LONG_NAME string, OBJECT_CLASS_CONCEPTS string, PROPERTY_CONCEPTS string, CLASSIFICATIONS string, PERMISSIBLE_VALUES string"


def element(i):
    return (i, f"Element {i}", f"SHORT_{i}|S{i % 4}", "Enumerated", None, None, None, f"Which {i}?", i % 5, f"Dec {i % 5}", f"X:C{i % 5}", f"X:C{20 + i % 5}|X:D{i % 5}", "T - V\\C", f"Yes {i % 6}\\ncit:C{i % 6}|No\\ncit:E{i % 6}")


@pytest.fixture(scope="module")
def tables(spark):
    concepts = spark.createDataFrame(CONCEPTS, CONCEPT_COLUMNS)
    some = lambda *ids: spark.createDataFrame([element(i) for i in ids], ELEMENT_COLUMNS)
    return concepts, some


def rows(df, *left_out):
    return sorted((tuple(r) for r in df.drop(*left_out).select(sorted(set(df.columns) - set(left_out))).collect()), key=str)


def same(a, b):
    assert set(a.nodes) == set(b.nodes) and set(a.edges) == set(b.edges)
    for kind in ("nodes", "edges"):
        for name, df in getattr(a, kind).items():
            assert rows(df, G.CONFLICT) == rows(getattr(b, kind)[name], G.CONFLICT), name


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("part-*.parquet")}


def test_batches_give_the_graph_of_one(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "PARTS", 8)
    concepts, some = tables
    store = G.GraphStore(spark, f"file://{tmp_path}/g")
    store.upsert(G.build(concepts, some(*range(6))), "first")
    added = store.upsert(G.build(concepts.limit(0), some(*range(6, 12))), "second")
    whole = G.build(concepts, some(*range(12)))
    same(store.graph(), whole)
    assert added["nodes/CDE"] == 6 and added["nodes/SemanticType"] == 0
    store.upsert(G.build(concepts.limit(0), some(*range(6, 12))), "second")
    same(store.graph(), whole)  # a batch that is given again changes nothing
    untouched = files(tmp_path)
    store.upsert(G.build(concepts.limit(0), some(12)), "third")
    after = files(tmp_path)
    kept = [p for p in untouched if p in after and after[p] == untouched[p]]
    assert len(kept) > len(untouched) / 2 and all(p in kept for p in untouched if "IS_CALLED" in str(p) or "SemanticType" in str(p))
    assert sum("nodes/CDE/" in str(p) for p in untouched) - sum("nodes/CDE/" in str(p) for p in kept) <= 1  # the folder of its key
    same(store.graph(), G.build(concepts, some(*range(13))))


def test_the_first_writer_wins(spark, tables, tmp_path):
    """A code that an element refers to is there as such; a later table of concepts doesn't change it, nor does one with other names."""
    concepts, some = tables
    store = G.GraphStore(spark, f"file://{tmp_path}/g")
    store.upsert(G.build(concepts.where("CODE = 'C7'"), some(1)), "a")
    store.upsert(G.build(concepts.withColumn("CONCEPT_NAME", F.lit("new")), some(1).limit(0)), "b")
    got = {r.name: (r.concept_name, r.nonstandard) for r in store.graph().nodes["Concept"].collect()}
    assert got["C7"] == ("concept 7", False) and got["C1"] == (None, True) and got["C9"] == ("new", False)
    assert store.graph().edges["EQUALS"].count() == 2 and store.graph().nodes["Concept"].count() == 32


def test_contradicting_keys_are_refused(spark, tables, tmp_path):
    concepts, some = tables
    twice = concepts.union(concepts.where("CODE IN ('C3', 'C4')"))
    G.build(twice, some(1)).save(f"file://{tmp_path}/fine")  # equal rows contradict nothing
    other = concepts.union(concepts.where("CODE IN ('C3', 'C4')").withColumn("DEFINITION", F.lit("another")))
    with pytest.raises(G.DuplicateKeys, match="2 of Concept"):
        G.build(other, some(1)).save(f"file://{tmp_path}/g")
    assert not files(tmp_path / "g")
    loaded = G.Graph.load(spark, f"file://{tmp_path}/fine", ["Concept"], [])
    assert G.CONFLICT not in loaded.nodes["Concept"].columns and loaded.nodes["Concept"].count() > 30


def test_walks_are_stored_once(spark, tables, tmp_path):
    """Scores by stored walks equal those by following edges, also in a graph that is loaded again; the walks aren't shuffled."""
    concepts, some = tables
    plain = G.build(concepts, some(*range(12)))
    stored = plain.stored(spark, f"file://{tmp_path}/g")
    loaded = G.Graph.load(spark, f"file://{tmp_path}/g", plain.nodes, plain.edges)
    hits = None
    for label, n in plain.nodes.items():
        own = n.select(F.lit("q").alias("query_id"), F.col("id").alias("node"), F.lit(label).alias("label"), (F.pmod("id", F.lit(100)) / 10).alias("score"))
        hits = own if hits is None else hits.unionAll(own)
    hits = hits.unionAll(hits.where("score > 5").withColumn("query_id", F.lit("r")))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    for paths in (G.PATHS, G.VALUE_PATHS):
        want = rows(G.propagate(hits, plain, paths))
        assert len(want) > 12 and want == rows(G.propagate(hits, stored, paths)) == rows(G.propagate(hits, loaded, paths))
        try:
            for n, v in zip(names, ("-1", "false")):
                spark.conf.set(n, v)
            plan = G.propagate(hits, loaded, paths)._jdf.queryExecution().executedPlan().toString()
        finally:
            for n, v in zip(names, before):
                spark.conf.set(n, v)
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(node") == 1, plan
