"""Learning: models of document quality and curves."""

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from colweave.operators import logistic as L
from colweave.operators import models as M
from colweave.operators import moments as N
from colweave.operators import network as W
from colweave.plans.base import Catalogue, rounded, table
from colweave.storage import saved, scope

C = Catalogue()
COLUMNS = ["logn", "spaces", "capitals"]


def examples(spark, d):
    t = F.col("text")
    docs = table(spark, d, "documents").select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("logn"), ((F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))) / F.greatest(F.length(t), F.lit(1))).alias("spaces"), (F.length(F.regexp_replace(t, "[^A-Z]", "")) / F.greatest(F.length(t), F.lit(1))).alias("capitals"))
    return docs.join(table(spark, d, "labels"), "doc_id").withColumn("quality", F.col("quality").cast("double"))


_EXAMPLES = """base AS (SELECT doc_id, source, CAST(quality AS DOUBLE) AS y, ln(1 + n_chars) AS a, (length(text) - length(replace(text, ' ', ''))) / greatest(length(text), 1) AS b, length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1) AS c FROM documents JOIN labels USING (doc_id))"""
_PRODUCTS = "[a, b, c, a * a, a * b, a * c, b * b, b * c, c * c]"


def moments_sql(rows: str, terms: int) -> str:
    """Named parts of a WITH clause down to gram(part, i, j, v) of scaled terms, towards(part, i, v), and means(part, i, mean, scale, my, weight), from rows (part, x, y, w)."""
    return f"""rows_ AS ({rows}), place AS (SELECT unnest(range(1, {terms + 1})) AS i), cell AS (SELECT part, x, y, w, i, x[i] AS v FROM rows_, place),
mean_ AS (SELECT part, i, sum(w * v) / sum(w) AS mean, sum(w * y) / sum(w) AS my, sum(w) AS weight FROM cell GROUP BY part, i),
means AS (SELECT part, i, any_value(mean) AS mean, sqrt(sum((v - mean) ** 2)) AS scale, any_value(my) AS my, any_value(weight) AS weight FROM cell JOIN mean_ USING (part, i) GROUP BY part, i),
gram AS (SELECT a.part, a.i, b.i AS j, sum(w * (x[a.i] - a.mean) * (x[b.i] - b.mean)) / (any_value(a.scale) * any_value(b.scale)) AS v FROM rows_ r JOIN means a ON a.part = r.part JOIN means b ON b.part = r.part GROUP BY ALL),
towards AS (SELECT r.part, i, sum(w * (x[i] - mean) * (y - my)) / any_value(scale) AS v FROM rows_ r JOIN means USING (part) GROUP BY ALL)"""


def ridge_sql(rows: str, alphas: list[float], terms: int = 9) -> str:
    """As moments_sql(), down to ridge_(part, alpha, coefficients, means, my): the normal equations, solved by elimination, a place after another. Needs WITH RECURSIVE."""
    return f"""{moments_sql(rows, terms)}, alphas AS (SELECT unnest({alphas}::DOUBLE[]) AS alpha),
line AS (SELECT part, alpha, i, list(v + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j) AS l FROM gram, alphas GROUP BY ALL), lines AS (SELECT part, alpha, list(list_append(l, t.v) ORDER BY i) AS m FROM line JOIN towards t USING (part, i) GROUP BY ALL),
gauss AS (SELECT part, alpha, 1 AS k, m FROM lines UNION ALL SELECT part, alpha, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda e: e / m[k][k]) ELSE list_transform(row, lambda e, j: e - row[k] * m[k][j] / m[k][k]) END) FROM gauss WHERE k <= {terms}),
ridge_ AS (SELECT g.part, alpha, (SELECT list(m[i][{terms + 1}] / scale ORDER BY i) FROM means WHERE means.part = g.part) AS coefficients, (SELECT list(mean ORDER BY i) FROM means WHERE means.part = g.part) AS means, (SELECT any_value(my) FROM means WHERE means.part = g.part) AS my FROM gauss g WHERE k = {terms + 1})"""


def estimate_sql(x: str) -> str:
    return f"my + list_sum(list_transform({x}, lambda e, i: (e - means[i]) * coefficients[i]))"


@C.add("SELECT p_partkey, a, b, round(a * a, 6) AS aa, round(a * b, 6) AS ab, round(b * b, 6) AS bb FROM (SELECT p_partkey, p_size / 10.0 AS a, round(p_retailprice / 1000, 6) AS b FROM part)")
def poly_features(spark, d):
    df = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 10).alias("a"), F.round(F.col("p_retailprice") / 1000, 6).alias("b"))
    for stage in M.polynomial(["a", "b"]):
        df = stage.transform(df)
    v = vector_to_array("features")
    return df.select("p_partkey", "a", "b", rounded(v[1]).alias("aa"), rounded(v[3]).alias("ab"), rounded(v[4]).alias("bb"))


@C.add()
def logistic_nomatch(spark, d):
    df = examples(spark, d).dropna(subset=[*COLUMNS, "quality"])
    with scope():
        (fitted,) = L.fit(saved(df.select(*COLUMNS, "quality")), COLUMNS, "quality", [(None, 10.0)])
    return df.select("doc_id", "quality", rounded(1 / (1 + F.exp(-fitted.predict(COLUMNS))), 4).alias("p"))


@C.add(f"""WITH RECURSIVE {_EXAMPLES}, {ridge_sql(f"SELECT 0 AS part, {_PRODUCTS} AS x, y, 25 / 142.0 / greatest(a, {math.log(2)}) AS w FROM base", [10**-0.5])}
SELECT doc_id, y AS quality, round({estimate_sql(_PRODUCTS)}, 6) AS estimate FROM base, ridge_""")
def ridge_value(spark, d):
    """Weighted ridge on all products of two columns, from one pass of moments."""
    df = examples(spark, d).withColumn("w", M.sample_weight(F.lit(25.0), 142, F.col("logn")))
    (fitted,) = N.ridge(N.moments(df, COLUMNS, "quality", "w")[0], [10**-0.5])
    return df.select("doc_id", "quality", rounded(fitted.predict(COLUMNS)).alias("estimate"))


@C.add(f"""WITH RECURSIVE {_EXAMPLES}, fold AS (SELECT unnest(range(10)) AS f), {ridge_sql(f"SELECT f AS part, {_PRODUCTS} AS x, y, 1.0 AS w FROM base, fold WHERE doc_id % 10 <> f", [0.001, 0.1, 10.0])}
SELECT CAST(part AS INTEGER) AS fold, alpha, count(*) AS n, round(sum((y - ({estimate_sql(_PRODUCTS)})) ** 2), 6) AS squared_error FROM base JOIN ridge_ ON doc_id % 10 = part GROUP BY ALL""")
def ridge_folds(spark, d):
    """Ten folds and three penalties from one scan: each model is fitted to the moments of nine folds and judged by those of the tenth."""
    parts = N.moments(examples(spark, d), COLUMNS, "quality", fold=F.pmod("doc_id", F.lit(10)))
    rows = [(k, a, round(n), round(e, 6)) for k, a, n, e in N.folds_left_out(parts, [0.001, 0.1, 10.0])]
    return spark.createDataFrame(rows, "fold int, alpha double, n long, squared_error double")


_LASSO = 0.0005


@C.add(f"""WITH RECURSIVE {_EXAMPLES}, {moments_sql("SELECT 0 AS part, [a, b, c] AS x, y, 1.0 AS w FROM base", 3)},
g AS (SELECT list(l ORDER BY i) AS g FROM (SELECT i, list(v ORDER BY j) AS l FROM gram GROUP BY i)), t AS (SELECT list(v ORDER BY i) AS t, any_value(weight) * {_LASSO} AS limit_ FROM towards JOIN means USING (part, i)),
descent AS (SELECT 0 AS n, [0.0, 0.0, 0.0]::DOUBLE[] AS b UNION ALL SELECT n + 1, list_transform(b, lambda e, i: CASE WHEN i = n % 3 + 1 THEN sign(t[i] - list_sum(list_transform(b, lambda f, j: f * g[i][j])) + e * g[i][i]) * greatest(abs(t[i] - list_sum(list_transform(b, lambda f, j: f * g[i][j])) + e * g[i][i]) - limit_, 0) / g[i][i] ELSE e END) FROM descent, g, t WHERE n < 1500),
found AS (SELECT (SELECT list(b[i] / scale ORDER BY i) FROM means) AS coefficients, (SELECT list(mean ORDER BY i) FROM means) AS means, (SELECT any_value(my) FROM means) AS my FROM descent WHERE n = 1500)
SELECT doc_id, round({estimate_sql("[a, b, c]")}, 6) AS estimate, CAST(len(list_filter(coefficients, lambda e: e <> 0)) AS INTEGER) AS n_used FROM base, found""")
def lasso_value(spark, d):
    """Lasso by coordinate descent on the same moments."""
    df = examples(spark, d)
    fitted = N.lasso(N.moments(df, COLUMNS, "quality", degree=1)[0], _LASSO)
    return df.select("doc_id", rounded(fitted.predict(COLUMNS, 1)).alias("estimate"), F.lit(int((fitted.coefficients != 0).sum())).alias("n_used"))


@C.add(f"""WITH {_EXAMPLES}, s AS (SELECT (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS c FROM base),
v AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, var_samp(c) AS cc, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, c) AS bc FROM s),
p AS (SELECT *, (aa + bb + cc) / 3 AS q, sqrt(((aa - q) ** 2 + (bb - q) ** 2 + (cc - q) ** 2 + 2 * (ab ** 2 + ac ** 2 + bc ** 2)) / 6) AS p FROM v),
r AS (SELECT q, p, acos(greatest(-1, least(1, ((aa - q) * ((bb - q) * (cc - q) - bc ** 2) - ab * (ab * (cc - q) - bc * ac) + ac * (ab * bc - (bb - q) * ac)) / p ** 3 / 2))) / 3 AS phi FROM p)
SELECT CAST(k AS INTEGER) AS axis, round(q + 2 * p * cos(phi + [0, 4, 2][k] * pi() / 3), 9) AS variance, round((q + 2 * p * cos(phi + [0, 4, 2][k] * pi() / 3)) / (3 * q), 6) AS share FROM r, (SELECT unnest([1, 2, 3]) AS k)""")
def principal_axes(spark, d):
    """Variances along the principal axes of columns stretched to 0 to 1, from the same moments; in SQL by the roots of the characteristic polynomial."""
    axes = N.principal_axes(N.moments(examples(spark, d), COLUMNS, "quality", degree=1)[0], by_range=True)
    return spark.createDataFrame([(i + 1, round(float(v), 9), round(float(v) / axes.total, 6)) for i, v in enumerate(axes.variances)], "axis int, variance double, share double")


@C.add()
def kfold(spark, d):
    found = M.cross_validated(examples(spark, d), COLUMNS, "quality", [0.1, 10.0], folds=3)
    return spark.createDataFrame([(c, round(float(a), 6)) for c, a in zip([0.1, 10.0], found.areas)], "c double, auc double")


@C.add("""SELECT doc_id, CAST(doc_id % 10 = 0 AS INT) AS test FROM labels""")
def group_split(spark, d):
    train, test = M.group_split(table(spark, d, "labels").select("doc_id"), F.col("doc_id"), 10)
    return train.withColumn("test", F.lit(0)).unionAll(test.withColumn("test", F.lit(1)))


@C.add("""WITH x AS (SELECT n_chars AS threshold, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT threshold, round(sum(p) OVER w / (SELECT sum(p) FROM x), 6) AS tpr, round(sum(q) OVER w / (SELECT sum(q) FROM x), 6) AS fpr FROM x WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curve(spark, d):
    df = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return M.roc(df, "n_chars", "quality").select("threshold", rounded("tpr").alias("tpr"), rounded("fpr").alias("fpr"))


@C.add("SELECT p_partkey, p_size, round(cume_dist() OVER (ORDER BY p_size), 6) AS ecdf FROM part")
def ecdf(spark, d):
    return M.ecdf(table(spark, d, "part"), "p_size", "p_partkey").select("p_partkey", "p_size", rounded("ecdf").alias("ecdf"))


@C.add(f"SELECT doc_id, round((quality + 1.5 * toxic * 0.01 / 1.5) / (1 + 0.01 / 1.5), 6) AS target, round(25 / 142.0 / greatest(ln(1 + quality), {math.log(2)}), 6) AS weight FROM labels")
def blended_target(spark, d):
    return table(spark, d, "labels").select("doc_id", rounded(M.blended_target(1.5 * F.col("toxic"), F.col("quality"))).alias("target"), rounded(M.sample_weight(F.lit(25.0), 142.0, F.log1p("quality"))).alias("weight"))


@C.add("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_of_group(spark, d):
    return M.first_of_each(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@C.add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def known_bad_left_out(spark, d):
    """Lines of parts that never came back to their supplier."""
    line = table(spark, d, "lineitem")
    return M.without(line, line.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@C.add("SELECT o_custkey, array_to_string(list_sort(list_filter((SELECT list(DISTINCT o_orderpriority) FROM orders), lambda t: NOT list_contains(own, t))), ',') AS lacking FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS own FROM orders GROUP BY o_custkey)")
def set_difference(spark, d):
    """Priorities that none of a customer's orders has."""
    orders = table(spark, d, "orders")
    every = orders.agg(F.collect_set("o_orderpriority").alias("every"))  # five priorities
    own = orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("own"))
    return own.crossJoin(F.broadcast(every)).select("o_custkey", F.array_join(F.array_sort(F.array_except("every", "own")), ",").alias("lacking"))


@C.add("""WITH r AS (SELECT o_custkey, 1.5 * CAST(o_orderstatus = 'F' AS INT) AS m1, o_orderkey % 10 / 10.0 AS m2, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM orders)
SELECT round(avg(m), 6) AS score FROM (SELECT max((1 + (2 - i) / 1.5) * m1 + (3 - i) * m2) AS m FROM r WHERE i < 3 GROUP BY o_custkey)""")
def ranking_metric(spark, d):
    """The best of each customer's three dearest orders."""
    rows = table(spark, d, "orders").withColumns({"metric1": F.when(F.col("o_orderstatus") == "F", 1.5).otherwise(0.0), "metric2": F.col("o_orderkey") % 10 / 10})
    return M.ranking_metric(rows, ["o_custkey"], "o_totalprice", ["o_orderkey"]).select(rounded("score").alias("score"))


_GRID = [0.01, 1.0, 100.0]


@C.add(f"""WITH RECURSIVE {_EXAMPLES}, dealt AS (SELECT *, substr(md5(source), 1, 1) IN ('0', '1', '2', '3') AS test FROM base),
{ridge_sql(f"SELECT 0 AS part, {_PRODUCTS} AS x, y, 1.0 AS w FROM dealt WHERE NOT test", _GRID)},
e AS (SELECT alpha, source, y, row_number() OVER (PARTITION BY alpha, source ORDER BY round({estimate_sql(_PRODUCTS)}, 9) DESC, doc_id) - 1 AS i FROM dealt, ridge_ WHERE test),
m AS (SELECT alpha, avg(m) AS score FROM (SELECT alpha, source, max((3 - i) * y) AS m FROM e WHERE i < 3 GROUP BY ALL) GROUP BY alpha)
SELECT CAST(row_number() OVER (ORDER BY score DESC, alpha DESC) - 1 AS INTEGER) AS place, alpha, round(score, 6) AS score FROM (SELECT alphas.alpha, coalesce(score, 0) AS score FROM alphas LEFT JOIN m USING (alpha))""")
def alpha_grid(spark, d):
    """Ridge models of a grid of penalties by the ranking metric on held-out sources, best first: one scan to fit them all, one to rank by them all."""
    df = examples(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumns({"metric1": F.lit(0.0), "metric2": F.col("quality")})
    train, test = M.group_split(df, F.when(F.substring(F.md5(F.col("source").cast("binary")), 1, 1).isin("0", "1", "2", "3"), 0).otherwise(1), 2)
    return spark.createDataFrame([(i, a, round(float(s), 6)) for i, (a, s) in enumerate(M.alpha_grid(train, test, COLUMNS, "quality", ["source"], ["doc_id"], _GRID))], "place int, alpha double, score double")


@C.add()
def other_models(spark, d):
    """Documents by a forest and by a lasso on reduced columns."""
    df = examples(spark, d)
    for stage in M.reduced(COLUMNS, 2):
        df = stage.fit(df).transform(df) if hasattr(stage, "fit") else stage.transform(df)
    forest, _ = M.forests("quality", 10)
    out = forest.fit(df).transform(df).select("doc_id", "features", "quality", F.col("prediction").alias("forest"))
    return M.lasso("quality", 0.001).setFeaturesCol("features").fit(df).transform(out).select("doc_id", "quality", "forest", rounded("prediction", 4).alias("lasso"))


@C.add()
def network_value(spark, d):
    """A network of 48, 12 and one unit on a tangent of quality; tests hold its gradients against finite differences."""
    bend = 5 / 12 * math.pi  # the target's tangent, from -1 to 1
    df = examples(spark, d).withColumn("target", F.tan((2 * F.col("quality") - 1) * bend) / math.tan(bend))
    fitted, _ = W.fit(df, COLUMNS, "target", rounds=10)
    return fitted.predict(df, "estimate").select("doc_id", "quality", rounded("estimate", 4).alias("estimate"))


QUERIES, ORACLES = C.queries, C.oracles
