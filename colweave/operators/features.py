"""Assembly and normalisation of candidates' features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.validators import looks_enumerated
from colweave.storage import saved

#: What is counted for a data element without listed answers.
BOOLEAN_ANSWERS = 2
#: A deviation below this is that of equal scores, which differ by rounding only: their parts are added up in differing orders.
NO_SPREAD = 1e-12


def assemble(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer equi-joins of feature tables; what is missing is 0."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, "full_outer")
    return out.na.fill(0, [c for c in out.columns if c not in keys])


def wide(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows (keys, feature, value) as columns by one aggregation, instead of a join for each feature."""
    return long.groupBy(*keys).agg(*(F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names)).na.fill(0, names)


def expand(df: DataFrame, group: list[str], features: list[str], positive_only: tuple[str, ...] = ("secondary_search",), few: bool = False) -> DataFrame:
    """df with statistics of each group: max_*, pct_* (share above 0), n, logn; and *_frac (of the maximum) and *_norm (by mean and population deviation), 0 where these are 0 (a deviation: below NO_SPREAD).

    For the marks in positive_only, max_* is their mean, and they have neither *_frac nor *_norm. One aggregation, joined back. few: there are far fewer groups than rows, so that
    statistics are saved and the planner knows their size: rows need not be dealt by groups to meet them.
    """
    stats = df.groupBy(*group).agg(
        *(F.avg(f).alias(f"max_{f}") if f in positive_only else F.max(f).alias(f"max_{f}") for f in features),
        *(F.avg((F.col(f) > 0).cast("int")).alias(f"pct_{f}") for f in features),
        *(F.avg(f).alias(f"__avg_{f}") for f in features if f not in positive_only),
        *(F.stddev_pop(f).alias(f"__std_{f}") for f in features if f not in positive_only),
        F.count("*").alias("n"),
    )
    stats = saved(stats) if few else stats
    own = [f for f in features if f not in positive_only]
    frac = [F.when(F.col(f"max_{f}") == 0, 0.0).otherwise(F.col(f) / F.col(f"max_{f}")).alias(f"{f}_frac") for f in own]
    norm = [F.when(F.col(f"__std_{f}") < NO_SPREAD, 0.0).otherwise((F.col(f) - F.col(f"__avg_{f}")) / F.col(f"__std_{f}")).alias(f"{f}_norm") for f in own]
    joined = df.join(stats, group)
    return joined.select(*df.columns, *(c for c in stats.columns if c not in group and not c.startswith("__")), *frac, *norm, F.log("n").alias("logn"))


def answer_counts(elements: DataFrame, permits: DataFrame, rows: str = "rows", element: str = "target") -> DataFrame:
    """elements with n_answers: edges count as often as they occur; elements without any count 2 if boolean, else the column's `rows`, which stand in each row."""
    counted = permits.groupBy(F.col("src").alias(element)).agg(F.count("*").alias("edges"))
    return elements.join(counted, element, "left").withColumn("n_answers", F.coalesce("edges", F.when(F.col("datatype") == "BOOLEAN", BOOLEAN_ANSWERS), rows)).drop("edges")


def unpivoted(df: DataFrame, sheet: str) -> DataFrame:
    """Columns as rows: (sheet, col_no from 1, header, value as text); nulls stay."""
    cells = F.array(*(F.struct(F.lit(i + 1).alias("col_no"), F.lit(c).alias("header"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(df.columns)))
    return df.select(F.explode(cells).alias("c")).select(F.lit(sheet).alias("sheet"), "c.*")


def profile(long: DataFrame) -> DataFrame:
    """For each column: rows with a value, distinct values, whether it looks enumerated."""
    out = long.where("value IS NOT NULL").groupBy("sheet", "col_no", "header").agg(F.count("*").alias("n_rows"), F.count_distinct("value").alias("n_distinct"))
    return out.withColumn("enumerated", looks_enumerated("n_distinct", "n_rows").cast("int"))
