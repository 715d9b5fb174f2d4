"""A labelled property graph as tables, and scores carried along its paths."""

from __future__ import annotations

import dataclasses
import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.functions import text as X
from colweave.storage import bucketed, bucketed_at, delete, exists, saved

#: Columns of a node table: id long, label string, name string, and properties.
#: What a name search looks into: (label, field, the node table's column).
SEARCHED = (("Synonym", "name", "name"), ("CDE_Name", "name", "name"), ("QuestionText", "name", "name"), ("DEC", "name", "dec_name"), ("CDE", "name", "cde_short_name"), ("CDE", "CDE_LONG_NAME", "cde_long_name"))
#: Marks nodes whose key came with differing properties.
CONFLICT = "__conflict"
#: Folders that a growing graph's tables are dealt into; edges that stand once however often they come.
PARTS, MERGED = 16, ("EQUALS", "CAN_BE")
#: Labels whose hits name elements directly.
ELEMENT_LABELS = ("CDE", "CDE_Name", "DEC", "QuestionText")


def node_id(label: str, key) -> Column:
    return F.xxhash64(F.lit(label), X.col(key).cast("string"))


def nodes(df: DataFrame, label: str, key: str, unique: bool = False, **properties: Column) -> DataFrame:
    """Distinct nodes by their natural key, as an upsert leaves them; of differing properties those of the smallest stay. unique: a column CONFLICT marks keys that have such."""
    made = df.where(F.col(key).isNotNull()).select(node_id(label, key).alias("id"), F.lit(label).alias("label"), F.col(key).cast("string").alias("name"), *(c.alias(n) for n, c in properties.items()))
    if not properties:
        return made.distinct()
    given = F.struct(*properties)
    grouped = made.groupBy("id", "label", "name").agg(F.min(given).alias("p"), *([F.max(given).alias("q")] if unique else []))
    return grouped.select("id", "label", "name", "p.*", *([(~F.col("p").eqNullSafe(F.col("q"))).alias(CONFLICT)] if unique else []))


def edges(df: DataFrame, name: str, src: tuple[str, str], dst: tuple[str, str], distinct: bool = False) -> DataFrame:
    """Edges between (label, key column) pairs: one for each source row, or distinct ones."""
    made = df.where(F.col(src[1]).isNotNull() & F.col(dst[1]).isNotNull()).select(F.lit(name).alias("edge"), node_id(*src).alias("src"), node_id(*dst).alias("dst"))
    return made.distinct() if distinct else made


class DuplicateKeys(ValueError):
    """Rows that give one key different properties."""


@dataclasses.dataclass
class Graph:
    """Tables of nodes by label and of edges by kind; `walks`, if stored, holds for each walk (see walk_name()) which targets its nodes reach, and `members` what categories() gives."""

    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    walks: DataFrame | None = None
    members: DataFrame | None = None

    def save(self, path: str) -> None:
        """Replaces what is there. Tables are written side by side: most are too small to keep a cluster busy alone.

        Nodes whose key came with differing properties are marked while they are written; if there are any, nothing stays and DuplicateKeys tells their numbers. Marks are a column of
        their own, false almost everywhere, so that counting them reads next to nothing.
        """
        jobs = [(f"{path}/{kind}/{name}", df) for kind, tables in (("nodes", self.nodes), ("edges", self.edges)) for name, df in tables.items()]
        with ThreadPoolExecutor(8) as pool:
            for done in [pool.submit(df.write.mode("overwrite").parquet, at) for at, df in jobs]:
                done.result()
        marked = {name: df.sparkSession.read.schema(df.schema).parquet(f"{path}/nodes/{name}").where(CONFLICT).count() for name, df in self.nodes.items() if CONFLICT in df.columns}
        if bad := {name: n for name, n in marked.items() if n}:
            for at, df in jobs:
                delete(df.sparkSession, at)
            raise DuplicateKeys(f"keys with differing properties: {', '.join(f'{n} of {name}' for name, n in bad.items())}")

    def stored(self, spark: SparkSession, path: str) -> Graph:
        """Saved and read back, with its walks: searches then read tables, not the plans that made them, and follow no edges."""
        self.save(path)
        plain = Graph.load(spark, path, self.nodes, self.edges)
        plain.categories().write.mode("overwrite").parquet(f"{path}/members")
        plain = dataclasses.replace(plain, members=spark.read.parquet(f"{path}/members"))
        return dataclasses.replace(plain, walks=bucketed(plain.all_walks(), "node", f"{path}/walks"))

    def categories(self) -> DataFrame:
        """(target, first): of each element with categories the least element that has the very same. What comes by a category reaches all of them alike."""
        if self.members is not None:
            return self.members
        own = self.edges["IS_CAT"].join(self.nodes["CDE"].select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("target")).agg(F.sort_array(F.collect_set("dst")).alias("decs"))
        firsts = own.groupBy("decs").agg(F.min("target").alias("first"))
        return own.join(firsts, "decs").select("target", "first")

    def all_walks(self) -> DataFrame:
        """(node, walk, target) along all declared paths to elements; see walked()."""
        return self.walked({(p.label, p.steps) for p in (*PATHS, *VALUE_PATHS)}, "CDE")

    def walked(self, walks: set[tuple[str, tuple[str, ...]]], target_label: str, start: DataFrame | None = None) -> DataFrame:
        """(node, walk, target) of distinct pairs, from all nodes of a walk's label or from those of start (node, label) only. Walks that by_category() reach one element only of those with the same categories."""
        targets, out = self.nodes[target_label].select(F.col("id").alias("target")), None
        for label, steps in sorted(walks):
            shared = by_category(steps, target_label)
            own = self.nodes[label].select(F.col("id").alias("node")) if start is None else start.where(F.col("label") == label).select("node")
            tables = [self.edges[s[1:]].select(F.col("dst").alias("src"), F.col("src").alias("dst")) if s[0] == "~" else self.edges[s].select("src", "dst") for s in steps]
            if shared:
                tables[-1] = tables[-1].join(self.categories().select(F.col("first").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            reached = follow(own, tables).join(targets, "target", "left_semi").select("node", F.lit(walk_name(label, steps)).alias("walk"), "target")
            out = reached if out is None else out.unionAll(reached)
        return out

    @staticmethod
    def load(spark, path: str, node_names, edge_names) -> Graph:
        members = spark.read.parquet(f"{path}/members") if exists(spark, f"{path}/members") else None
        walks = bucketed_at(spark, "node", f"{path}/walks") if members is not None and exists(spark, f"{path}/walks") else None
        return Graph({n: spark.read.parquet(f"{path}/nodes/{n}").drop(CONFLICT) for n in node_names}, {e: spark.read.parquet(f"{path}/edges/{e}") for e in edge_names}, walks, members)


def by_category(steps: tuple[str, ...], target_label: str = "CDE") -> bool:
    """Whether a walk comes to elements by their categories."""
    return target_label == "CDE" and steps[-1:] == ("~IS_CAT",)


def walk_name(label: str, steps: tuple[str, ...]) -> str:
    return " ".join((label, *steps))


class GraphStore:
    """A graph in a folder that grows by batches, as a graph database does by upserts.

    Node tables lie in PARTS folders by their id, edge tables by their source. A batch touches the folders of its keys only: what is there is read, what is new is added, and those
    folders are written anew in one go; other folders keep their files. A node that is there stays as it is, whatever a later batch says of it: the first writer wins. Edges of MERGED kinds
    stand once, others as often as they come. A batch has a name; if it broke off, it is given again by that name, and what it had left is replaced.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, kind: str, name: str) -> DataFrame | None:
        at = f"{self.path}/{kind}/{name}"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            return None
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schemas/{kind}/{name}").schema).parquet(at)  # it may have no rows

    def graph(self) -> Graph:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        of = lambda kind: {n: self.table(kind, n).drop("part", "batch") for n in sorted(f.getPath().getName() for f in fs.listStatus(p.suffix(f"/{kind}")))}
        return Graph(of("nodes"), of("edges"))

    def upsert(self, changes: Graph, batch: str) -> dict[str, int]:
        """Rows added by table."""
        jobs = [("nodes", name, df.drop(CONFLICT), ["id"], "id") for name, df in changes.nodes.items()]
        jobs += [("edges", name, df, ["src", "dst"] if name in MERGED else None, "src") for name, df in changes.edges.items()]
        with ThreadPoolExecutor(8) as pool:
            done = [(f"{kind}/{name}", pool.submit(self._merge, kind, name, df, key, by, batch)) for kind, name, df, key, by in jobs]
            return {name: job.result() for name, job in done}

    def _merge(self, kind: str, name: str, new: DataFrame, key: list[str] | None, by: str, batch: str) -> int:
        new = new.withColumns({"batch": F.lit(batch), "part": F.pmod(F.col(by), F.lit(PARTS)).cast("int")})
        old, at = self.table(kind, name), f"{self.path}/{kind}/{name}"
        if old is None:
            new = saved(new)
            new.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schemas/{kind}/{name}")
            new.write.mode("overwrite").partitionBy("part").parquet(at)
            return new.count()
        before = old.where(F.col("batch") != batch)
        if key:
            new = new.join(before, [*key, "part"], "left_anti")
        new = saved(new)
        touched = [r.part for r in new.select("part").union(old.where(F.col("batch") == batch).select("part")).distinct().collect()]  # PARTS at most
        if touched:
            merged = saved(before.where(F.col("part").isin(touched)).unionByName(new, allowMissingColumns=True))  # what is read can't be written over
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(at)
        return new.count()


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Violations of a uniqueness constraint; empty if it holds."""
    return df.groupBy(*key).count().where("count > 1")


def parents(df: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """(child, parent) pairs of a table's rows by a column of parents' keys separated by |, and those whose parent is missing."""
    wanted = df.select(F.col(key).alias("child"), F.explode(X.parse_pipes(parent)).alias("parent"))
    known = df.select(F.col(key).alias("parent")).distinct()
    return wanted.join(known, "parent").select("child", "parent"), wanted.join(known, "parent", "left_anti").select("child", "parent")


def build(concepts: DataFrame, elements: DataFrame) -> Graph:
    """The graph of a table of concepts and one of data elements (columns as in FIXTURES.md, A1 and A2)."""
    ex = lambda df, key, column, parsed, name: df.select(key, F.explode(parsed(column)).alias(name))
    synonyms, types = ex(concepts, "CODE", "SYNONYMS", X.parse_pipes, "synonym"), ex(concepts, "CODE", "SEMANTIC_TYPE", X.parse_pipes, "type")
    children, _ = parents(concepts, "CODE", "PARENTS")
    e = elements.withColumn("row", F.sha2(F.to_json(F.struct(*elements.columns), {"ignoreNullFields": "false"}), 256))  # several elements may share an id
    short, questions = ex(e, "row", "CDE_SHORT_NAME", X.parse_pipes, "short"), ex(e, "row", "QUESTION_TEXT", X.parse_pipes, "question")
    objects = e.where("DEC_ID IS NOT NULL").select("DEC_ID", F.explode(X.parse_concepts("OBJECT_CLASS_CONCEPTS")).alias("c")).select("DEC_ID", "c.code")
    properties = e.where("DEC_ID IS NOT NULL").select("DEC_ID", F.explode(X.parse_concepts("PROPERTY_CONCEPTS")).alias("c")).select("DEC_ID", "c.code")
    classes = e.select("row", F.explode(X.parse_classifications("CLASSIFICATIONS")).alias("c")).select("row", "c.*", F.to_json("c").alias("class"))
    answers = e.select("row", F.explode(X.parse_answers("PERMISSIBLE_VALUES")).alias("parts")).where(F.size("parts") > 0).withColumn("answer", F.array_join("parts", "|"))
    texts = answers.select("answer", F.explode("parts").alias("answer_text")).where(~F.col("answer_text").contains("ncit:"))
    meant = answers.select("answer", F.explode(X.concept_codes("answer")).alias("code")).withColumn("code", F.regexp_replace("code", r"\|.*", ""))
    referred = objects.select("code").unionByName(properties.select("code")).unionByName(meant.select("code")).distinct().join(concepts.select(F.col("CODE").alias("code")), "code", "left_anti")
    lower = lambda c: {"name_lower": F.lower(c)}
    concept_nodes = nodes(concepts, "Concept", "CODE", unique=True, concept_name=F.col("CONCEPT_NAME"), definition=F.col("DEFINITION")).withColumn("nonstandard", F.lit(False))
    concept_nodes = concept_nodes.unionByName(nodes(referred, "Concept", "code").withColumns({"nonstandard": F.lit(True), CONFLICT: F.lit(False)}), allowMissingColumns=True)
    keep = ("CDE_ID", "CDE_LONG_NAME", "CDE_SHORT_NAME", "VALUE_DOMAIN_TYPE", "DATATYPE", "DISPLAY_FORMAT", "UNIT_OF_MEASURE")
    return Graph(
        {
            "Concept": concept_nodes,
            "Synonym": nodes(synonyms, "Synonym", "synonym", **lower("synonym")),
            "SemanticType": nodes(types, "SemanticType", "type"),
            "CDE": nodes(e, "CDE", "row", **{c.lower(): F.col(c) for c in keep}),
            "CDE_Name": nodes(short, "CDE_Name", "short", **lower("short")),
            "QuestionText": nodes(questions, "QuestionText", "question"),
            "DEC": nodes(e, "DEC", "DEC_ID", dec_name=F.col("DEC_LONG_NAME")),
            "Classification": nodes(classes, "Classification", "class", type=F.col("type"), value=F.col("value"), context=F.col("context")),
            "Answer": nodes(answers, "Answer", "answer"),
            "AnswerText": nodes(texts, "AnswerText", "answer_text", **lower("answer_text")),
        },
        {
            "IS_CALLED": edges(synonyms, "IS_CALLED", ("Concept", "CODE"), ("Synonym", "synonym")),
            "IS_TYPE": edges(types, "IS_TYPE", ("Concept", "CODE"), ("SemanticType", "type")),
            "IS_CHILD": edges(children, "IS_CHILD", ("Concept", "child"), ("Concept", "parent")),
            "IS_SHORT": edges(short, "IS_SHORT", ("CDE", "row"), ("CDE_Name", "short")),
            "QUESTION": edges(questions, "QUESTION", ("CDE", "row"), ("QuestionText", "question")),
            "IS_CAT": edges(e, "IS_CAT", ("CDE", "row"), ("DEC", "DEC_ID")),
            "IS_OBJ": edges(objects, "IS_OBJ", ("DEC", "DEC_ID"), ("Concept", "code")),
            "IS_PROP": edges(properties, "IS_PROP", ("DEC", "DEC_ID"), ("Concept", "code")),
            "IS_CLASS": edges(classes, "IS_CLASS", ("CDE", "row"), ("Classification", "class")),
            "PERMITS": edges(answers, "PERMITS", ("CDE", "row"), ("Answer", "answer")),
            "EQUALS": edges(meant, "EQUALS", ("Answer", "answer"), ("Concept", "code"), distinct=True),
            "CAN_BE": edges(texts, "CAN_BE", ("Answer", "answer"), ("AnswerText", "answer_text"), distinct=True),
        },
    )


@dataclasses.dataclass(frozen=True)
class Path:
    """A feature: hits of a label, the edges to follow (against their direction with ~ in front), how scores are put together."""

    feature: str
    label: str
    steps: tuple[str, ...]
    how: str


#: How search scores reach data elements; concepts have no IS_CLASS edges, so the class features are always 0.
PATHS = (
    *(Path(f"syn_{n}{how}", "Synonym", ("~IS_CALLED", *steps), how) for how in ("sum", "max") for n, steps in (("class", ("~IS_CLASS",)), ("prop", ("~IS_PROP", "~IS_CAT")), ("obj", ("~IS_OBJ", "~IS_CAT")))),
    Path("ftsearch_cde", "CDE_Name", ("~IS_SHORT",), "max"),
    Path("ftsearch_cde", "CDE", (), "max"),
    Path("ftsearch_dec", "DEC", ("~IS_CAT",), "max"),
    Path("ftsearch_question", "QuestionText", ("~QUESTION",), "max"),
)


#: How scores of a value reach data elements that permit it: by the text of an answer, or by a concept that an answer means.
VALUE_PATHS = (Path("enum_answer_search", "AnswerText", ("~CAN_BE", "~PERMITS"), "max"), Path("enum_concept_search", "Synonym", ("~IS_CALLED", "~EQUALS", "~PERMITS"), "max"))


def name_entries(graph: Graph) -> DataFrame:
    """(field, node, label, text) of everything that a name search looks into."""
    return functools.reduce(DataFrame.unionAll, (graph.nodes[label].select(F.lit(field).alias("field"), F.col("id").alias("node"), "label", F.col(c).alias("text")) for label, field, c in SEARCHED))


def answer_entries(graph: Graph) -> DataFrame:
    return graph.nodes["AnswerText"].select(F.lit("name").alias("field"), F.col("id").alias("node"), "label", F.col("name").alias("text"))


def concepts_of(graph: Graph, targets: DataFrame | None = None) -> DataFrame:
    """(target, dec, code): concepts of each element, or of these (target), by its category, objects and properties alike, distinct."""
    either = graph.edges["IS_OBJ"].unionAll(graph.edges["IS_PROP"]).select(F.col("src").alias("dec"), F.col("dst").alias("concept")).distinct()
    codes = graph.nodes["Concept"].select(F.col("id").alias("concept"), F.col("name").alias("code"))
    own = graph.edges["IS_CAT"].select(F.col("src").alias("target"), F.col("dst").alias("dec")).distinct()
    if targets is not None:
        own = own.join(targets, "target", "left_semi")
    return own.join(either, "dec").join(codes, "concept").select("target", "dec", "code").distinct()


def codes_of_decs(graph: Graph) -> DataFrame:
    """(dec_id, codes): the distinct concepts of each category, by objects and properties alike. Elements play no part: each of them has all concepts of its category, so pairs of both grow with the square."""
    either = graph.edges["IS_OBJ"].unionAll(graph.edges["IS_PROP"]).select(F.col("src").alias("dec"), F.col("dst").alias("concept")).distinct()
    codes = graph.nodes["Concept"].select(F.col("id").alias("concept"), F.col("name").alias("code"))
    decs = graph.nodes["DEC"].select(F.col("id").alias("dec"), F.col("name").cast("long").alias("dec_id"))
    return either.join(codes, "concept").join(decs, "dec").groupBy("dec_id").agg(F.collect_set("code").alias("codes"))


def category_codes(graph: Graph) -> DataFrame:
    """(first, codes): the concepts, distinct and in order, of all elements with the same categories, at the one that stands for them in Graph.categories()."""
    return concepts_of(graph, graph.categories().select(F.col("first").alias("target")).distinct()).groupBy(F.col("target").alias("first")).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def element_headers(graph: Graph) -> DataFrame:
    """(target, cde_id, cde_long_name, dec_id, dec_name) of every element with a category."""
    own = graph.nodes["CDE"].select(F.col("id").alias("target"), "cde_id", "cde_long_name")
    dec = graph.nodes["DEC"].select(F.col("id").alias("dec"), F.col("name").cast("long").alias("dec_id"), "dec_name")
    return own.join(graph.edges["IS_CAT"].select(F.col("src").alias("target"), F.col("dst").alias("dec")).distinct(), "target").join(dec, "dec").drop("dec")


def permitted_values(graph: Graph, targets: DataFrame | None = None) -> DataFrame:
    """(target, answer, synonym or null, answer_text or null, code or null) of every element's answers, or of these elements' (target): a row for each synonym of a concept that the answer means."""
    answers = graph.edges["PERMITS"].select(F.col("src").alias("target"), F.col("dst").alias("answer"))
    answers = (answers if targets is None else answers.join(targets, "target", "left_semi")).distinct()
    texts = graph.edges["CAN_BE"].select(F.col("src").alias("answer"), F.col("dst").alias("id")).join(graph.nodes["AnswerText"].select("id", "name"), "id").groupBy("answer").agg(F.min("name").alias("answer_text"))
    called = graph.edges["IS_CALLED"].select(F.col("src").alias("concept"), F.col("dst").alias("id")).distinct().join(graph.nodes["Synonym"].select("id", F.col("name").alias("synonym")), "id").drop("id")
    meant = graph.edges["EQUALS"].select(F.col("src").alias("answer"), F.col("dst").alias("concept")).join(graph.nodes["Concept"].select(F.col("id").alias("concept"), F.col("name").alias("code")), "concept").join(called, "concept").select("answer", "synonym", "code").distinct()
    return answers.join(texts, "answer", "left").join(meant, "answer", "left").select("target", "answer", "synonym", "answer_text", "code")


def follow(start: DataFrame, steps: list[DataFrame], many: bool = False) -> DataFrame:
    """Distinct (node, target) pairs along tables of (src, dst). many: on the way and at the end there are many nodes, so pairs are dealt by these alone: the next step, or what is grouped by target, needs no other shuffle."""
    out = start.select("node", F.col("node").alias("at")).distinct()
    for step in steps:
        out = out.join(step.select(F.col("src").alias("at"), "dst"), "at").select("node", F.col("dst").alias("at"))
        out = (out.repartition("at") if many else out).distinct()
    return out.select("node", F.col("at").alias("target"))


def propagate(hits: DataFrame, graph: Graph, paths: tuple[Path, ...] = PATHS, key: str = "query_id", target_label: str = "CDE") -> DataFrame:
    """(key, target, a column for each feature) from hits (key, node, label, score); 0 where a path finds nothing.

    Hits meet the pairs of nodes and targets of all walks, and each feature sums or tops the scores of its walks. What comes by categories is put together for one element of those with the same
    categories, and only then given to each of them. Stored walks lie in buckets by node, so hits come to them; without them edges are followed from the nodes that were hit.
    """
    uses = {walk_name(p.label, p.steps): (p.label, p.steps) for p in paths}
    hits = saved(hits)  # each walk starts from them
    if graph.walks is not None and target_label == "CDE" and set(uses.values()) <= {(p.label, p.steps) for p in (*PATHS, *VALUE_PATHS)}:
        walks = graph.walks.where(F.col("walk").isin(list(uses)))
    else:
        walks = graph.walked(set(uses.values()), target_label, hits.select("node", "label").distinct())
    by_feature: dict[str, list[Path]] = {}
    for p in paths:
        by_feature.setdefault(p.feature, []).append(p)
    put = {"sum": F.sum, "max": F.max}
    shared = [name for name, (_, steps) in uses.items() if by_category(steps, target_label)]

    def carried(wanted: list[str]) -> DataFrame:
        features = [put[own[0].how](F.when(F.col("walk").isin([walk_name(p.label, p.steps) for p in own]), F.col("score"))).alias(f) for f, own in by_feature.items()]
        return hits.select(key, "node", "score").join(walks.where(F.col("walk").isin(wanted)), "node").groupBy(key, "target").agg(*features)

    if not shared:
        return carried(list(uses)).na.fill(0.0, list(by_feature))
    given = saved(carried(shared)).withColumnRenamed("target", "first").join(graph.categories(), "first").select(key, "target", *by_feature)
    own = [name for name in uses if name not in shared]
    if not own:
        return given.na.fill(0.0, list(by_feature))
    return carried(own).unionByName(given).groupBy(key, "target").agg(*(put[own[0].how](f).alias(f) for f, own in by_feature.items())).na.fill(0.0, list(by_feature))
