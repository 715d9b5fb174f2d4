"""Decisions for columns, and results as nested structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colweave.functions.text import normalised_levenshtein
from colweave.functions.validators import conformity, conforms

NOMATCH = "NOMATCH"
FIRST_CUTOFF, SECOND_CUTOFF = 0.4, 0.5


def ranked_results(candidates: Column, p: Column, first: float = FIRST_CUTOFF, second: float = SECOND_CUTOFF, none: Column | None = None) -> Column:
    """Up to three results from candidates in order of their estimates and the probability of no match.

    Below the first cutoff the three best; below the second NOMATCH in second place, else in first. Without candidates only NOMATCH.
    """
    none = F.lit(NOMATCH) if none is None else none
    at = lambda a, b: F.slice(candidates, a, b)
    return F.when(F.size(candidates) == 0, F.array(none)).when(p < first, at(1, 3)).when(p < second, F.concat(at(1, 1), F.array(none), at(2, 1))).otherwise(F.concat(F.array(none), at(1, 2)))


def first_candidates(scored: DataFrame, group: list[str], estimate: str, candidate: str, k: int = 3) -> DataFrame:
    """The rows of the k best of each group, numbered by `r` from 1; ties go to the smaller candidate."""
    w = Window.partitionBy(*group).orderBy(F.desc(estimate), candidate)
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def top_candidates(scored: DataFrame, group: list[str], estimate: str, candidate: str, k: int = 3, of: str | None = None) -> DataFrame:
    """(group, candidates): the k best of each group as an array of texts in order; ties go to the smaller candidate, which with `of` is a structure that is shown by this field."""
    shown = F.col(candidate if of is None else f"{candidate}.{of}").cast("string")
    top = first_candidates(scored, group, estimate, candidate, k)
    return top.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", shown.alias("c")))), lambda x: x["c"]).alias("candidates"))


def classify_values(pairs: DataFrame, permitted: DataFrame, hits: DataFrame, value: str = "value", target: str = "target") -> DataFrame:
    """(target, value, permissible, code) of each distinct pair of a value with an enumerated target that is a candidate for it.

    hits: (value, target, answer, synonym or null, code, score). The best answer by score; among its synonyms that were hit the best by score, then by
    distance; else its nearest synonym, else its own text; else NOMATCH. permitted: (target, answer, synonym or null, answer_text or null, code).
    """
    pairs = pairs.select(target, value).distinct()
    scored = hits.where("score > 0").join(pairs, [target, value], "left_semi").withColumn("lev", F.when(F.col("synonym").isNotNull(), normalised_levenshtein(value, "synonym")))
    w = Window.partitionBy(target, value).orderBy(F.desc("score"), "answer")
    best = scored.groupBy(target, value, "answer").agg(F.max("score").alias("score"), F.min(F.when(F.col("synonym").isNotNull(), F.struct((-F.col("score")).alias("s"), "lev", "synonym", "code"))).alias("hit")).withColumn("r", F.row_number().over(w)).where("r = 1")
    near = best.join(permitted, [target, "answer"]).withColumn("lev", F.when(F.col("synonym").isNotNull(), normalised_levenshtein(value, "synonym")))
    nearest = near.groupBy(target, value).agg(F.min("hit").alias("hit"), F.min(F.when(F.col("synonym").isNotNull(), F.struct("lev", "synonym", "code"))).alias("near"), F.min("answer_text").alias("text"))
    return pairs.join(nearest, [target, value], "left").select(target, value, F.coalesce("hit.synonym", "near.synonym", "text", F.lit(NOMATCH)).alias("permissible"), F.when(F.col("hit").isNotNull(), F.col("hit.code")).otherwise(F.col("near.code")).alias("code"))


def value_classes(pairs: DataFrame, elements: DataFrame, permitted: DataFrame, hits: DataFrame) -> DataFrame:
    """(target, value, permissible, code) of pairs by the kind of the target's domain: its answers if they are listed, else its display format, else its data type."""
    typed = pairs.select("target", "value").distinct().join(elements.select("target", "value_domain_type", "datatype", "display_format"), "target")
    listed = F.coalesce(F.col("value_domain_type") == "Enumerated", F.lit(False))
    by_rule = typed.where(~listed).select("target", "value", conformity(conforms("value", "datatype", "display_format")).alias("permissible"), F.lit(None).cast("string").alias("code"))
    return classify_values(typed.where(listed), permitted, hits).unionByName(by_rule)


def matched_share(classes: DataFrame, by: list[str]) -> DataFrame:
    """(by, share): the share of values with a permissible one."""
    return classes.groupBy(*by).agg(F.avg((~F.col("permissible").isin(NOMATCH, "NONCONFORMING")).cast("int")).alias("share"))


def best_node_of(values: DataFrame, element: str = "cde_id", node: str = "target", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, element, node): of several nodes with one element id that with the fewest values not matched; ties go to the smaller node."""
    bad = F.count_if(F.col("permissible").isin(NOMATCH, "NONCONFORMING"))
    w = Window.partitionBy(*by, element).orderBy("bad", node)
    return values.groupBy(*by, element, node).agg(bad.alias("bad")).withColumn("r", F.row_number().over(w)).where("r = 1").select(*by, element, node)


def value_domain(values: DataFrame, group: list[str]) -> DataFrame:
    """(group, value_domain): observed values with what they are permitted as, in order."""
    entry = F.struct(F.col("value").alias("observedValue"), F.struct(F.col("permissible").alias("value"), F.when(F.col("code").isNotNull(), F.concat(F.lit("ncit:"), "code")).alias("conceptCode")).alias("permissibleValue"))
    return values.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("value_domain"))


def result(element_id: Column, element: Column, concept_id: Column, concept: Column, codes: Column, domain: Column) -> Column:
    """One result as a struct; codes: an array of distinct concept codes."""
    return F.struct(
        F.struct(element_id.cast("long").alias("id"), element.alias("name")).alias("dataElement"),
        F.struct(concept_id.cast("long").alias("id"), concept.alias("name"), F.transform(F.array_sort(F.array_distinct(codes)), lambda c: F.concat(F.lit("ncit:"), c)).alias("conceptCodes")).alias("dataElementConcept"),
        domain.alias("valueDomain"),
    )


def nomatch_result(domain: Column) -> Column:
    none = F.lit(None)
    return result(none, F.lit(NOMATCH), none, F.lit(NOMATCH), F.array().cast("array<string>"), domain)


def submission(columns: DataFrame) -> DataFrame:
    """(sheet, columns) from (sheet, col_no, header, results: array of results in order)."""
    numbered = F.transform("results", lambda r, i: F.struct((i + 1).alias("resultNumber"), r.alias("result")))
    column = F.struct(F.col("col_no").alias("columnNumber"), F.col("header").alias("headerValue"), numbered.alias("results"))
    return columns.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("col_no", column.alias("c")))).alias("cs")).select("sheet", F.transform("cs", lambda x: x["c"]).alias("columns"))
