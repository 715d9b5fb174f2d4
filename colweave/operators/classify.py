"""Columns of data sheets matched with data elements: from headers and values to ranked results, all columns in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.functions import text as X
from colweave.functions import validators as V
from colweave.operators import decide as D
from colweave.operators import evaluate as E
from colweave.operators import features as T
from colweave.operators import graph as G
from colweave.operators import models as M
from colweave.operators.decompose import decompose
from colweave.operators.search import Index, best_of_strings
from colweave.sources.files import write_submissions
from colweave.sources.sheets import read_sheets
from colweave.storage import saved, sizes_in_memory

COLUMN = ["sheet", "col_no"]
#: A column whose header finds fewer nodes, or fewer nodes that name elements, is searched for again.
ENOUGH, ENOUGH_ELEMENTS = 25, 5
NAME_FEATURES = list(dict.fromkeys(p.feature for p in G.PATHS))
FEATURES = ["secondary_search", *NAME_FEATURES, "enum_concept_search", "enum_answer_search", "answer_count_score", "value_score"]


def columns_and_cells(tables: dict[str, DataFrame] | str, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """(sheet, col_no, header) of all columns, also of tables without rows, and (sheet, col_no, value) of their cells.

    tables: a folder of files, which are read in one scan however many they are; or a few DataFrames by name, each a branch of the plan.
    """
    if isinstance(tables, str):
        return read_sheets(spark or SparkSession.active(), tables)
    spark = next(iter(tables.values())).sparkSession
    columns = spark.createDataFrame([(s, i + 1, c) for s, df in sorted(tables.items()) for i, c in enumerate(df.columns)], "sheet string, col_no int, header string")
    cells = None
    for sheet, df in sorted(tables.items()):
        own = T.unpivoted(df, sheet).select(*COLUMN, "value")
        cells = own if cells is None else cells.unionAll(own)
    return columns, cells


def key() -> Column:
    return F.struct(*COLUMN)


def adaptive_search(columns: DataFrame, names: Index, dictionary: DataFrame | None = None, strings: DataFrame | None = None, enough: int = ENOUGH, enough_elements: int = ENOUGH_ELEMENTS) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, node, label, score) of columns' search strings (sheet, col_no, search), and those of a second search for columns that found too little.

    Two thresholds decide: all hits, and hits that name elements. The second search takes the string itself and its segmentations by words of
    `dictionary` (word), weighed by their scores, or else the given strings (sheet, col_no, string_no, coefficient, query_text). Columns are chosen by a join: no branch on the driver.
    """
    first = saved(names.search(columns.select(key().alias("query_id"), F.col("search").alias("query_text"))))
    found = first.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("label").isin(*G.ELEMENT_LABELS)).alias("n_elements"))
    few = columns.select(key().alias("query_id"), "search").join(found, "query_id", "left").where((F.coalesce("n", F.lit(0)) < enough) | (F.coalesce("n_elements", F.lit(0)) < enough_elements)).select("query_id", "search")
    own = few.select("query_id", F.lit(0).alias("string_no"), F.lit(1.0).alias("coefficient"), F.col("search").alias("query_text"))
    if strings is None:
        cut = decompose(few, dictionary, "query_id", "search")
        more = cut.select("query_id", F.col("rank").alias("string_no"), F.col("score").alias("coefficient"), X.clean_for_search("segments").alias("query_text"))
    else:
        more = strings.select(key().alias("query_id"), "string_no", "coefficient", "query_text").join(few, "query_id", "left_semi")
    strings = saved(own.unionByName(more))
    hits = names.search(strings.select(F.struct("query_id", "string_no").alias("s"), "query_text"), "s")
    return first, best_of_strings(hits, strings, 0.0, "node", "label")


def value_hits(values: DataFrame, graph: G.Graph, names: Index, answers: Index) -> DataFrame:
    """(value, target, enum_answer_search, enum_concept_search): the best scores of values (value, query_text) at elements that permit what they hit."""
    asked = values.select(F.col("value").alias("query_id"), "query_text")
    hits = names.search(asked).where("label = 'Synonym'").unionByName(answers.search(asked)).withColumnRenamed("query_id", "value")
    return G.propagate(hits, graph, G.VALUE_PATHS, "value")


def candidate_features(columns: DataFrame, cells: DataFrame, graph: G.Graph, names: Index, answers: Index, dictionary: DataFrame | None = None, strings: DataFrame | None = None) -> DataFrame:
    """(sheet, col_no, target, cde_id, FEATURES) of every candidate of every column.

    columns: (sheet, col_no, header); cells: (sheet, col_no, value). Hits of headers and of values, a row each, are laid out by one
    aggregation; a column's candidates are what either of them found. What is missing is 0.
    """
    sizes_in_memory(graph.nodes["CDE"].sparkSession)
    searched = columns.select(*COLUMN, X.header_to_search_string("header").alias("search"))
    first, second = adaptive_search(searched, names, dictionary, strings)
    spread = lambda df: df.select("query_id.*", *[c for c in df.columns if c != "query_id"])
    one = spread(G.propagate(first, graph)).withColumn("secondary_search", F.lit(0))
    two = spread(G.propagate(second, graph)).withColumn("secondary_search", F.lit(1))
    by_name = one.unionByName(two.join(one.select(*COLUMN, "target"), [*COLUMN, "target"], "left_anti"))
    raw = saved(cells.where("value IS NOT NULL").groupBy(*COLUMN, "value").agg(F.count("*").alias("n")).withColumn("query_text", X.clean_for_search("value")))
    # all values' scores of an element lie together, so that they are summed where they lie
    per_value = saved(value_hits(raw.select(F.col("query_text").alias("value"), "query_text").distinct(), graph, names, answers).withColumnRenamed("value", "query_text").repartition("target"))
    clean = raw.groupBy(*COLUMN, "query_text").agg(F.count("*").alias("n_raw"))
    clean = saved(clean.join(clean.groupBy(*COLUMN).agg(F.count("*").alias("n_clean")), COLUMN))
    found = F.when((F.col("enum_answer_search") > 0) | (F.col("enum_concept_search") > 0), F.col("n_raw"))
    means = clean.join(per_value, "query_text").groupBy(*COLUMN, "target").agg(*(F.sum(f).alias(f) for f in ("enum_concept_search", "enum_answer_search")), F.sum(found).alias("hits"), F.max("n_clean").alias("n_clean"))
    by_value = means.select(*COLUMN, "target", *((F.col(f) / F.col("n_clean")).alias(f) for f in ("enum_concept_search", "enum_answer_search")), "hits").where("enum_concept_search > 0 OR enum_answer_search > 0")
    both = T.assemble([by_name, by_value], [*COLUMN, "target"])

    # what is a row for each column is saved: its size is known then, and all candidates need not be dealt by columns to meet it
    sizes = saved(raw.groupBy(*COLUMN).agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows")))
    elements = graph.nodes["CDE"].select(F.col("id").alias("target"), "cde_id", "value_domain_type", "datatype", "display_format")
    typed = both.join(elements, "target").join(sizes, COLUMN, "left").na.fill(0, ["n_values", "n_rows"])
    typed = saved(T.answer_counts(typed, graph.edges["PERMITS"], "n_rows"))
    counted = typed.withColumn("answer_count_score", X.count_closeness("n_values", "n_answers"))
    # each kind of domain is checked once for a column's values, however many candidates have it
    kinds = typed.where("value_domain_type = 'NonEnumerated'").where(V.listed("datatype", "display_format")).select(*COLUMN, "datatype", "display_format").distinct()
    kinds = kinds.withColumn("kind", F.when(F.col("display_format").isNotNull(), F.concat(F.lit("f "), "display_format")).otherwise(F.concat(F.lit("t "), "datatype")))
    ok = saved(raw.join(kinds, COLUMN).groupBy(*COLUMN, "kind").agg(F.avg(V.conforms("value", "datatype", "display_format").cast("int")).alias("conforming")))
    kind = F.when(F.col("value_domain_type") == "NonEnumerated", F.when(F.col("display_format").isNotNull(), F.concat(F.lit("f "), "display_format")).otherwise(F.concat(F.lit("t "), "datatype")))
    scored = counted.withColumn("kind", kind).join(ok, [*COLUMN, "kind"], "left")
    share = F.when(F.col("value_domain_type") == "Enumerated", F.coalesce("hits", F.lit(0)) / F.col("n_values")).otherwise(F.col("conforming"))
    scored = scored.withColumn("value_score", F.when(F.col("n_values") > 0, F.coalesce(share, F.lit(0.0))).otherwise(0.0))
    return scored.select(*COLUMN, "target", "cde_id", *(F.col(f).cast("double").alias(f) if f != "secondary_search" else F.col(f).cast("int").alias(f) for f in FEATURES))


def expanded_features(candidates: DataFrame) -> DataFrame:
    return M.interactions(T.expand(candidates, COLUMN, FEATURES, few=True))


def training_rows(expanded: DataFrame, annotations: DataFrame, graph: G.Graph) -> DataFrame:
    """Expanded features with target metrics, from annotations (sheet, col_no, cde_id): a candidate's concepts against those of all elements with the annotated id."""
    codes, members = saved(G.category_codes(graph)), graph.categories()
    golden = annotations.select(F.col("cde_id").alias("golden_id")).distinct().join(graph.nodes["CDE"].select(F.col("id").alias("target"), F.col("cde_id").alias("golden_id")), "golden_id")
    golden = golden.join(members, "target").select("golden_id", "first").distinct().join(codes, "first").groupBy("golden_id").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("golden_codes"))
    rows = expanded.join(annotations.select(*COLUMN, F.col("cde_id").alias("golden_id")), COLUMN, "left").join(members, "target", "left")
    # concepts are compared once for all elements with the same categories
    pairs = rows.select("first", "golden_id").distinct().join(codes, "first").join(golden, "golden_id").select("first", "golden_id", E.shared_codes("codes", "golden_codes").alias("overlap"))
    rows = rows.join(saved(pairs), ["first", "golden_id"], "left")
    return E.metrics_of(rows, COLUMN, F.col("cde_id") == F.col("golden_id"), F.col("overlap")).drop("first", "overlap")


def decide_columns(columns: DataFrame, expanded: DataFrame, nomatch: Callable[[DataFrame], DataFrame], estimate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(sheet, col_no, header, results: element ids as text or NOMATCH, at most three) of every column.

    nomatch adds `p_nomatch` to one row of each column, as its statistics are constant in it; estimate adds `estimate` to every candidate. A column without candidates is NOMATCH.
    """
    p = nomatch(M.first_of_each(expanded, COLUMN, ["cde_id", "target"])).select(*COLUMN, "p_nomatch")
    ranked = estimate(expanded).select(*COLUMN, "estimate", F.struct("cde_id", "target").alias("candidate"))
    top = D.top_candidates(ranked, COLUMN, "estimate", "candidate", of="cde_id")
    joined = columns.join(top, COLUMN, "left").join(p, COLUMN, "left")
    return joined.select(*COLUMN, "header", D.ranked_results(F.coalesce("candidates", F.array().cast("array<string>")), F.coalesce("p_nomatch", F.lit(1.0))).alias("results"))


def enumerated_hits(pairs: DataFrame, permitted: DataFrame, graph: G.Graph, names: Index, answers: Index) -> DataFrame:
    """(value, target, answer, synonym or null, code, score) of values, as they are, at answers of their candidate elements: through an answer's text, and through synonyms of its concepts."""
    asked = pairs.select(F.col("value").alias("query_id"), F.col("value").alias("query_text")).distinct()
    at = permitted.select("target", "answer").distinct()
    can_be = graph.edges["CAN_BE"].select(F.col("dst").alias("node"), F.col("src").alias("answer")).join(at, "answer")  # an answer meets its elements before values meet it
    texts = answers.search(asked).join(can_be, "node").select(F.col("query_id").alias("value"), "target", "answer", F.lit(None).cast("string").alias("synonym"), F.lit(None).cast("string").alias("code"), "score")
    named = names.search(asked).where("label = 'Synonym'").join(graph.nodes["Synonym"].select(F.col("id").alias("node"), F.col("name").alias("synonym")), "node")
    meant = named.select(F.col("query_id").alias("value"), "synonym", "score").join(permitted.where("synonym IS NOT NULL").select("target", "answer", "synonym", "code").distinct(), "synonym").select("value", "target", "answer", "synonym", "code", "score")
    return texts.unionByName(meant).join(pairs.select("value", "target").distinct(), ["value", "target"], "left_semi").select("value", "target", "answer", "synonym", "code", "score")


def results_of(decided: DataFrame, cells: DataFrame, graph: G.Graph, names: Index, answers: Index) -> DataFrame:
    """(sheet, col_no, header, results) with results as nested structures: the matched element, its category and concepts, and what each distinct value is permitted as.

    Of several nodes with the chosen element id the one with the fewest unmatched values lends its value domain.
    """
    ranked = saved(decided.select(*COLUMN, "header", F.posexplode("results").alias("place", "chosen")))
    raw = cells.where("value IS NOT NULL").select(*COLUMN, "value").distinct()
    elements = graph.nodes["CDE"].select(F.col("id").alias("target"), "cde_id", "value_domain_type", "datatype", "display_format")
    chosen = ranked.where(F.col("chosen") != D.NOMATCH).select(*COLUMN, F.col("chosen").try_cast("long").alias("cde_id")).distinct().join(elements.select("target", "cde_id"), "cde_id")
    pairs = saved(chosen.join(raw, COLUMN).select(*COLUMN, "cde_id", "target", "value"))
    permitted = saved(G.permitted_values(graph, chosen.select("target").distinct()))
    classes = D.value_classes(pairs, elements, permitted, enumerated_hits(pairs, permitted, graph, names, answers))
    classes = saved(pairs.join(classes, ["target", "value"]))
    best = D.best_node_of(classes, "cde_id", "target", tuple(COLUMN))
    domain = D.value_domain(classes.join(best, [*COLUMN, "cde_id", "target"]), [*COLUMN, "cde_id"])
    unmatched = D.value_domain(raw.withColumn("permissible", F.lit(D.NOMATCH)).withColumn("code", F.lit(None).cast("string")), COLUMN).withColumnRenamed("value_domain", "no_domain")
    headers = G.element_headers(graph).groupBy("cde_id").agg(F.min(F.struct("target", "cde_long_name", "dec_id", "dec_name")).alias("h")).select("cde_id", "h.*")
    joined = ranked.withColumn("cde_id", F.when(F.col("chosen") != D.NOMATCH, F.col("chosen").try_cast("long"))).join(headers, "cde_id", "left").join(G.codes_of_decs(graph), "dec_id", "left").join(domain, [*COLUMN, "cde_id"], "left").join(unmatched, COLUMN, "left")
    empty = F.filter(F.coalesce("no_domain", "value_domain", F.array(F.struct(F.lit("").alias("observedValue"), F.struct(F.lit("").alias("value"), F.lit("").alias("conceptCode")).alias("permissibleValue")))), lambda x: F.lit(False))
    matched = D.result(F.col("cde_id"), F.col("cde_long_name"), F.col("dec_id"), F.col("dec_name"), F.coalesce("codes", F.array().cast("array<string>")), F.coalesce("value_domain", empty))
    result = F.when(F.col("chosen") == D.NOMATCH, D.nomatch_result(F.coalesce("no_domain", empty))).otherwise(matched)
    return joined.groupBy(*COLUMN, "header").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", result.alias("r")))), lambda x: x["r"]).alias("results"))


def classify_sheets(columns: DataFrame, cells: DataFrame, graph: G.Graph, names: Index, answers: Index, nomatch: Callable[[DataFrame], DataFrame], estimate: Callable[[DataFrame], DataFrame], strings: DataFrame | None = None) -> DataFrame:
    """(sheet, columns): the submission of every sheet, all of them in one run. nomatch and estimate as in decide_columns(); see model_functions()."""
    dictionary = graph.nodes["Synonym"].select(F.col("name_lower").alias("word"))
    candidates = saved(candidate_features(columns, cells, graph, names, answers, dictionary, strings))
    decided = decide_columns(columns, expanded_features(candidates), nomatch, estimate)
    return D.submission(results_of(decided, cells, graph, names, answers))


def classify_folder(spark: SparkSession, folder: str, to: str, graph: G.Graph, names: Index, answers: Index, nomatch: Callable[[DataFrame], DataFrame], estimate: Callable[[DataFrame], DataFrame]) -> None:
    """A submission file for each sheet of a folder, all of them read, classified and written in one run."""
    columns, cells = map(saved, columns_and_cells(folder, spark))
    write_submissions(classify_sheets(columns, cells, graph, names, answers, nomatch, estimate), to)


def model_functions(nomatch_model, value_model) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """Two fitted pipelines (models.logistic on NOMATCH_COLUMNS, models.ridge on VALUE_COLUMNS) as what decide_columns() takes."""
    from pyspark.ml.functions import vector_to_array

    p = lambda df: nomatch_model.transform(df).withColumn("p_nomatch", vector_to_array("probability")[1])
    return p, lambda df: value_model.transform(df).withColumn("estimate", F.col("prediction"))


def indexes(spark: SparkSession, graph: G.Graph, folder: str) -> tuple[Index, Index]:
    """The name index and the answer index of a graph, stored in a folder."""
    for name, entries in (("names", G.name_entries(graph)), ("answers", G.answer_entries(graph))):
        Index.build(entries).save(f"{folder}/{name}")
    return Index.load(spark, f"{folder}/names"), Index.load(spark, f"{folder}/answers")
