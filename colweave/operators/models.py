"""Learning: features, estimators with the reference's penalties, curves."""

from __future__ import annotations

import dataclasses
import functools
import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, MinMaxScaler, PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colweave.operators import logistic as L
from colweave.operators import moments as N
from colweave.storage import saved, scope

#: What the two models see of a column and of a candidate.
NOMATCH_COLUMNS = ["max_syn_propmax", "max_enum_concept_search", "pct_syn_propsum", "pct_secondary_search", "logn", "c6", "c7"]
VALUE_COLUMNS = ["secondary_search", "ftsearch_cde", "enum_concept_search", "pct_ftsearch_question", "ftsearch_cde_norm", "syn_objmax_norm", "ftsearch_question_norm", "enum_answer_search_norm", "value_score_norm", "logn"]


def interactions(df: DataFrame) -> DataFrame:
    """Expanded features with products c1 to c5 of the share found by the second search, the sum c6 and the mean c7 of what names and questions tell."""
    second, c = F.col("pct_secondary_search"), F.col
    return df.withColumns(
        {
            "c1": second * c("max_enum_answer_search"),
            "c2": second * c("max_value_score"),
            "c3": second * c("pct_enum_concept_search"),
            "c4": second * c("pct_ftsearch_question"),
            "c5": second * (c("pct_syn_propsum") + c("pct_syn_objsum")),
            "c6": c("pct_ftsearch_cde") + c("pct_ftsearch_question"),
            "c7": F.sqrt((c("max_ftsearch_cde") + 1) * (c("max_ftsearch_question") + 1)) - 1,
        }
    )


def first_of_each(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """One row of each group, the first in order: what is constant in a group stands once."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__r = 1").drop("__r")


def without(df: DataFrame, known_bad: DataFrame, keys: list[str]) -> DataFrame:
    """df without the groups that are listed as bad; keys may be null."""
    return df.join(known_bad.select(*keys).distinct(), keys, "left_anti")


def ranking_metric(df: DataFrame, group: list[str], estimate: str, order: list[str], by: str | None = None) -> DataFrame:
    """(score), or (by, score) of each value of a column: the mean over groups of the best of the three rows with the highest estimates, later ones counting less."""
    own = [by] if by else []
    i = F.row_number().over(Window.partitionBy(*own, *group).orderBy(F.desc(estimate), *order)) - 1
    ranked = df.withColumn("__i", i).where("__i < 3")
    each = ranked.groupBy(*own, *group).agg(F.max((1 + (2 - F.col("__i")) / 1.5) * F.col("metric1") + (3 - F.col("__i")) * F.col("metric2")).alias("m"))
    return each.groupBy(*own).agg(F.avg("m").alias("score"))


def alpha_grid(train: DataFrame, test: DataFrame, columns: list[str], label: str, group: list[str], order: list[str], alphas: list[float], weight: str | None = None) -> list[tuple[float, float]]:
    """(alpha, ranking metric on the test rows) of ridge models, best first; equal ones by the larger alpha. One scan of the training rows and one of the test rows, for all penalties; estimates that are equal to nine digits are ties."""
    found = N.moments(train, columns, label, weight).get(0)
    if found is None:
        return []
    estimates = F.array(*(F.struct(F.lit(i).alias("i"), F.round(m.predict(columns), 9).alias("e")) for i, m in enumerate(N.ridge(found, alphas))))
    scored = test.withColumn("__m", F.explode(estimates)).withColumns({"__alpha": F.col("__m.i"), "__estimate": F.col("__m.e")})
    scores = {r["__alpha"]: r.score for r in ranking_metric(scored, group, "__estimate", order, "__alpha").collect()}
    return sorted(((a, scores.get(i) or 0.0) for i, a in enumerate(alphas)), key=lambda x: (-x[1], -x[0]))


def polynomial(columns: list[str], output: str = "features", degree: int = 2) -> list:
    """Stages for all products up to the degree; the constant is the intercept."""
    return [VectorAssembler(inputCols=columns, outputCol="__base"), PolynomialExpansion(degree=degree, inputCol="__base", outputCol=output)]


def logistic(columns: list[str], label: str, n: int, c: float = 10.0, l1: bool = True) -> Pipeline:
    """The sum of losses weighed by c against the penalty is their mean with a penalty of 1 / (c n)."""
    model = LogisticRegression(featuresCol="features", labelCol=label, elasticNetParam=float(l1), regParam=1 / (c * max(1, n)), standardization=False, maxIter=200)
    return Pipeline(stages=[*polynomial(columns), model])


def ridge(df: DataFrame, columns: list[str], label: str, alpha: float = 10**-0.5, weight: str | None = None) -> Pipeline:
    """Ridge on columns scaled by their norms. Unweighted: regParam is alpha times the label's deviation, with standardisation; weighted: scaled columns go in."""
    if weight is None:
        spread = df.agg(F.stddev_pop(label)).first()[0] or 1.0
        model = LinearRegression(labelCol=label, elasticNetParam=0.0, regParam=alpha * spread, standardization=True, solver="normal")
    else:
        total, spread = df.agg(F.sum(weight), F.sqrt(F.sum(F.col(weight) * F.pow(F.col(label), 2)) / F.sum(weight) - F.pow(F.sum(F.col(weight) * F.col(label)) / F.sum(weight), 2))).first()
        model = LinearRegression(labelCol=label, weightCol=weight, elasticNetParam=0.0, regParam=alpha * (spread or 1.0) / (total or 1.0), standardization=False, solver="normal")
    return Pipeline(stages=[*polynomial(columns), model])


def lasso(label: str, penalty: float) -> LinearRegression:
    return LinearRegression(labelCol=label, elasticNetParam=1.0, regParam=penalty)


def forests(label: str, trees: int = 50) -> tuple[RandomForestClassifier, RandomForestRegressor]:
    return RandomForestClassifier(labelCol=label, numTrees=trees, impurity="gini", seed=0), RandomForestRegressor(labelCol=label, numTrees=trees, seed=0)


def reduced(columns: list[str], k: int) -> list:
    return [VectorAssembler(inputCols=columns, outputCol="__raw"), MinMaxScaler(inputCol="__raw", outputCol="__scaled"), PCA(k=k, inputCol="__scaled", outputCol="features")]


@dataclasses.dataclass
class Validated:
    """A choice of c: the mean area under the curve of each in the grid, over folds that its models didn't see, and the best one's model of all rows, whose predict() gives the log of the odds."""

    areas: list[float]
    c: float
    model: N.Linear


def cross_validated(df: DataFrame, columns: list[str], label: str, grid: list[float], folds: int = 10, l1: bool = True, seed: int = 0) -> Validated:
    """k-fold choice of c for the logistic model. df is read once; the models of all folds and of the whole are then fitted together on the stored columns, a pass for each step."""
    with scope():
        dealt = df.select(*columns, label, F.least(F.floor(F.rand(seed) * folds), F.lit(folds - 1)).cast("int").alias("__fold"))
        given = saved(dealt.dropna())
        parts = [*range(folds), None]
        fitted = dict(zip([(c, k) for c in grid for k in parts], L.fit(given, columns, label, [(k, c) for c in grid for k in parts], "__fold", l1), strict=True))
        area = BinaryClassificationEvaluator(labelCol=label)
        areas = [sum(area.evaluate(given.where(F.col("__fold") == k).select(fitted[c, k].predict(columns).alias("rawPrediction"), label)) for k in range(folds)) / folds for c in grid]
    best = grid[max(range(len(grid)), key=areas.__getitem__)]
    return Validated(areas, best, fitted[best, None])


def group_split(df: DataFrame, key: Column, parts: int, test: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows of a key stay together: those whose key falls into part `test` of `parts`, last."""
    p = F.pmod(key, F.lit(parts))
    return df.where(p != test), df.where(p == test)


def sample_weight(database_weight: Column, total: float, logn: Column) -> Column:
    """A column of one candidate has log n = 0: its weight is that of two."""
    return database_weight / total / F.greatest(logn, F.lit(math.log(2)))


def blended_target(metric1: Column, metric2: Column) -> Column:
    return (metric2 + metric1 * 0.01 / 1.5) / (1 + 0.01 / 1.5)


def running(counts: DataFrame, by: str, sums: list[str], descending: bool = False, parts: int = 64) -> DataFrame:
    """counts, one row for each distinct `by`, with cumulated sums (cum_*) in its order, without gathering rows in one task: ranges of `by` are summed apart, and offsets of the former ranges, a row each, are added."""
    spark, key = counts.sparkSession, -F.col(by) if descending else F.col(by)
    bounds = counts.select(key.cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.01)
    part = functools.reduce(lambda a, b: a + (key.cast("double") > b).cast("int"), sorted(set(bounds)), F.lit(0))
    dealt = counts.withColumn("__p", part)
    w = Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    totals = sorted(tuple(r) for r in dealt.groupBy("__p").agg(*(F.sum(s) for s in sums)).collect())  # `parts` rows at most
    offsets, before = [], [0] * len(sums)
    for p, *own in totals:
        offsets.append((p, *before))
        before = [a + b for a, b in zip(before, own, strict=True)]
    frame = spark.createDataFrame(offsets, ", ".join(["__p int", *(f"__o{i} long" for i in range(len(sums)))]))
    return dealt.join(F.broadcast(frame), "__p").select(*counts.columns, *((F.sum(s).over(w) + F.col(f"__o{i}")).alias(f"cum_{s}") for i, s in enumerate(sums)))


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score, descending. Scores are counted first, so the running sums see distinct ones only."""
    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    total = counts.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))  # one row
    return running(counts, "threshold", ["p", "q"], descending=True).crossJoin(F.broadcast(total)).select("threshold", (F.col("cum_p") / F.col("tp")).alias("tpr"), (F.col("cum_q") / F.col("tq")).alias("fpr"))


def ecdf(df: DataFrame, value: str, key: str) -> DataFrame:
    """(key, value, ecdf): the share of rows with at most this value, by counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))  # one row
    share = running(counts, value, ["c"]).crossJoin(F.broadcast(total)).select(value, (F.col("cum_c") / F.col("n")).alias("ecdf"))
    return df.select(key, value).join(share, value)
