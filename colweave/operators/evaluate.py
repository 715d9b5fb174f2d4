"""Scores of results against annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.text import jaccard

WEIGHTS = (1.5, 1.0, 0.5)


def metrics(golden_none: Column, given_none: Column, same: Column, overlap: Column, domain: Column) -> tuple[Column, Column, Column]:
    """Element, concept and value-domain metrics: all 1 if both say no match, 0 if only one does; an equal element makes the concept 1."""
    def pick(other: Column) -> Column:
        return F.when(golden_none & given_none, 1.0).when(golden_none | given_none, 0.0).otherwise(other)

    m1 = pick(F.coalesce(same.cast("double"), F.lit(0.0)))
    return m1, pick(F.when(same, 1.0).otherwise(F.coalesce(overlap, F.lit(0.0)))), pick(F.coalesce(domain, F.lit(0.0)))


def bonus(rank: Column, m1: Column, m2: Column, m3: Column) -> Column:
    return (2 - rank) * (m1 + m2 + m3) / 3


def score(rank: Column, m1: Column, m2: Column, m3: Column) -> Column:
    """At most 4."""
    return WEIGHTS[0] * m1 + WEIGHTS[1] * m2 + WEIGHTS[2] * m3 + bonus(rank, m1, m2, m3)


def value_domain_score(golden: DataFrame, given: DataFrame, group: list[str], by_code: str = "enumerated") -> DataFrame:
    """(group, score): 1 minus the share of annotated values whose first given value differs, by concept code if enumerated, else by value; a missing one differs."""
    first = given.groupBy(*group, "observed").agg(F.min(F.struct("place", "value", "code")).alias("__given"))
    same = F.when(F.col(by_code), F.col("code").eqNullSafe(F.col("__given.code"))).otherwise(F.col("value").eqNullSafe(F.col("__given.value")))
    joined = golden.join(first, [*group, "observed"], "left")
    return joined.groupBy(*group).agg((1 - F.count_if(F.col("__given").isNull() | ~same) / F.count("*")).alias("score"))


def submission_score(results: DataFrame, sheet: str = "sheet", column: str = "col_no") -> DataFrame:
    """(sheet, score): the best result of each column, averaged over columns."""
    return results.groupBy(sheet, column).agg(F.max("score").alias("best")).groupBy(sheet).agg(F.avg("best").alias("score"))


def quick_score(rank: Column, metric1: Column, metric2: Column, none: Column, truth_none: Column) -> Column:
    """The offline scorer: from weighted metrics, without value domains."""
    return F.when(truth_none & none, 3 + 2 - rank).when(truth_none | none, 0.0).otherwise(metric1 + metric2 + (2 - rank) * (metric1 / WEIGHTS[0] + metric2) / 2)


def target_metrics(df: DataFrame, group: list[str], same: Column, codes: str, golden_codes: str) -> DataFrame:
    """df with metric1 to metric5 and statistics of metric2 in each group; a candidate without concepts has metric2 = 0."""
    return metrics_of(df, group, same, shared_codes(codes, golden_codes))


def shared_codes(codes: str, golden_codes: str) -> Column:
    return F.when((F.size(codes) == 0) | (F.size(golden_codes) == 0), 0.0).otherwise(jaccard(codes, golden_codes))


def metrics_of(df: DataFrame, group: list[str], same: Column, overlap: Column) -> DataFrame:
    """As target_metrics(), from the overlap of concepts."""
    base = df.withColumn("metric1", WEIGHTS[0] * F.coalesce(same.cast("double"), F.lit(0.0))).withColumn("metric2", F.coalesce(overlap, F.lit(0.0)))
    stats = base.groupBy(*group).agg(F.max("metric2").alias("metric2_max"), F.avg((F.col("metric2") > 0).cast("int")).alias("pct_metric2_pos"))
    out = base.join(stats, group).withColumn("metric2_frac", F.when(F.col("metric2_max") == 0, 0.0).otherwise(F.col("metric2") / F.col("metric2_max")))
    return out.withColumns({"metric3": (F.col("metric1") > 1).cast("int"), "metric4": (F.col("metric2") > 0).cast("int"), "metric5": (F.col("metric2_frac") > 0.5).cast("int")})


def missing_annotations(golden: DataFrame, elements: DataFrame, element: str) -> DataFrame:
    """Annotated ids that the graph lacks."""
    return golden.select(element).where(F.col(element).isNotNull()).distinct().join(elements.select(element), element, "left_anti")
