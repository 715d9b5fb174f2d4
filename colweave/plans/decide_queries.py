"""Decisions, results and their scores: customers are columns, nations' suppliers their candidates."""

from pyspark.sql import functions as F

from colweave.operators import decide as D
from colweave.operators import evaluate as E
from colweave.plans.base import Catalogue, rounded, table

C = Catalogue()


def decided(spark, d):
    """Each customer's nation's suppliers by their balance; the probability of no match from the customer's own."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    best = D.first_candidates(s, ["s_nationkey"], "s_acctbal", "s_suppkey")  # what is below a nation's best is below each customer's
    scored = c.where("c_custkey % 7 <> 0").join(best, F.col("c_nationkey") == F.col("s_nationkey"))
    top = D.top_candidates(scored, ["c_custkey"], "s_acctbal", "s_suppkey")
    p = F.pmod("c_custkey", F.lit(100)) / 100
    return c.join(top, "c_custkey", "left").select("c_custkey", D.ranked_results(F.coalesce("candidates", F.array().cast("array<string>")), p).alias("results"))


_DECIDED = """top AS (SELECT c_custkey, list(CAST(s_suppkey AS VARCHAR) ORDER BY r) AS c FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey % 7 <> 0) WHERE r <= 3 GROUP BY 1),
dec AS (SELECT c_custkey, CASE WHEN c IS NULL THEN ['NOMATCH'] WHEN c_custkey % 100 / 100.0 < 0.4 THEN c WHEN c_custkey % 100 / 100.0 < 0.5 THEN list_concat(list_concat(c[1:1], ['NOMATCH']), c[2:2]) ELSE list_concat(['NOMATCH'], c[1:2]) END AS results FROM customer LEFT JOIN top USING (c_custkey))"""


@C.add(f"WITH {_DECIDED} SELECT c_custkey, array_to_string(results, ',') AS results FROM dec")
def nomatch_rule(spark, d):
    return decided(spark, d).select("c_custkey", F.array_join("results", ",").alias("results"))


@C.add("""SELECT c_nationkey AS sheet, '{"columns":[' || string_agg('{"columnNumber":' || c_custkey || ',"headerValue":"' || c_name || '","results":[{"resultNumber":1,"result":{"dataElement":{"id":null,"name":"NOMATCH"},"dataElementConcept":{"id":null,"name":"NOMATCH","conceptCodes":[]},"valueDomain":[{"observedValue":"' || c_mktsegment || '","permissibleValue":{"value":"NOMATCH","conceptCode":null}}]}},{"resultNumber":2,"result":{"dataElement":{"id":' || c_custkey || ',"name":"' || c_name || '"},"dataElementConcept":{"id":' || c_nationkey || ',"name":"N","conceptCodes":["ncit:A","ncit:B"]},"valueDomain":[]}}]}', ',' ORDER BY c_custkey) || ']}' AS json FROM customer GROUP BY c_nationkey""")
def result_json(spark, d):
    """Two results for each customer: NOMATCH with its segment as observed value, and one with codes, repeated and unordered on the way in."""
    c = table(spark, d, "customer")
    values = c.select("c_custkey", F.col("c_mktsegment").alias("value"), F.lit(D.NOMATCH).alias("permissible"), F.lit(None).cast("string").alias("code"))
    c = c.join(D.value_domain(values, ["c_custkey"]), "c_custkey")
    empty = F.slice("value_domain", 1, 0)
    second = D.result(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), F.lit("N"), F.array(F.lit("B"), F.lit("A"), F.lit("B")), empty)
    cols = c.select(F.col("c_nationkey").alias("sheet"), F.col("c_custkey").alias("col_no"), F.col("c_name").alias("header"), F.array(D.nomatch_result(F.col("value_domain")), second).alias("results"))
    return D.submission(cols).select("sheet", F.to_json(F.struct("columns"), {"ignoreNullFields": "false"}).alias("json"))


def given_and_golden(spark, d):
    """The decided results and an annotation: the nation's supplier of the smallest key, no match for each fifth customer."""
    golden = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").cast("string").alias("g"))
    c = table(spark, d, "customer").join(golden, "c_nationkey", "left").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 == 0, D.NOMATCH).otherwise(F.coalesce("g", F.lit(D.NOMATCH))).alias("g"))
    return decided(spark, d).select("c_custkey", F.posexplode("results").alias("pos", "given")).join(c, "c_custkey")


def scored(spark, d):
    r = given_and_golden(spark, d)
    overlap = F.when(F.substring("given", 1, 1) == F.substring("g", 1, 1), 0.5).otherwise(0.0)
    m = E.metrics(F.col("g") == D.NOMATCH, F.col("given") == D.NOMATCH, F.col("given") == F.col("g"), overlap, overlap / 2)
    return r.select("c_custkey", "c_nationkey", (F.col("pos") + 1).alias("rank"), E.score(F.col("pos") + 1, *m).alias("score"))


_SCORED = """g AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 OR g IS NULL THEN 'NOMATCH' ELSE g END AS g FROM customer LEFT JOIN (SELECT s_nationkey, CAST(min(s_suppkey) AS VARCHAR) AS g FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey),
r AS (SELECT c_custkey, unnest(results) AS given, generate_subscripts(results, 1) AS rank FROM dec),
m AS (SELECT c_custkey, c_nationkey, rank, CASE WHEN g = 'NOMATCH' AND given = 'NOMATCH' THEN [1, 1, 1] WHEN g = 'NOMATCH' OR given = 'NOMATCH' THEN [0, 0, 0] WHEN g = given THEN [1, 1, 0.25] WHEN substr(g, 1, 1) = substr(given, 1, 1) THEN [0, 0.5, 0.25] ELSE [0, 0, 0] END AS m FROM r JOIN g USING (c_custkey)),
sc AS (SELECT c_custkey, c_nationkey, rank, 1.5 * m[1] + m[2] + 0.5 * m[3] + (2 - rank) * (m[1] + m[2] + m[3]) / 3 AS score FROM m)"""


@C.add(f"WITH {_DECIDED}, {_SCORED} SELECT c_custkey, CAST(rank AS INT) AS rank, round(CAST(score AS DOUBLE), 6) AS score FROM sc")
def score_result(spark, d):
    return scored(spark, d).select("c_custkey", "rank", rounded("score").alias("score"))


@C.add(f"WITH {_DECIDED}, {_SCORED} SELECT c_nationkey, round(CAST(avg(best) AS DOUBLE), 6) AS score FROM (SELECT c_nationkey, c_custkey, max(score) AS best FROM sc GROUP BY ALL) GROUP BY c_nationkey")
def score_submission(spark, d):
    return E.submission_score(scored(spark, d), "c_nationkey", "c_custkey").select("c_nationkey", rounded("score").alias("score"))


@C.add("""WITH gold AS (SELECT c_nationkey AS g, c_mktsegment AS observed, max(CAST(c_custkey % 3 AS VARCHAR)) AS code FROM customer GROUP BY ALL), given AS (SELECT c_nationkey AS g, c_mktsegment AS observed, max(CAST(o_orderkey % 3 AS VARCHAR)) AS code FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT gold.g, round(1 - sum(CASE WHEN given.code IS NOT DISTINCT FROM gold.code THEN 0 ELSE 1 END) / count(*), 6) AS score FROM gold LEFT JOIN given USING (g, observed) GROUP BY gold.g""")
def value_domain_score(spark, d):
    """Segments of each nation annotated by its customers, given by their orders; a segment without orders is missing."""
    c = table(spark, d, "customer").select(F.col("c_custkey"), F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("observed"))
    golden = c.groupBy("g", "observed").agg(F.max((F.col("c_custkey") % 3).cast("string")).alias("code")).withColumn("value", F.lit("v")).withColumn("enumerated", F.lit(True))
    orders = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    given = orders.groupBy("g", "observed").agg(F.max((F.col("o_orderkey") % 3).cast("string")).alias("code")).withColumn("value", F.lit("v")).withColumn("place", F.lit(1))
    return E.value_domain_score(golden, given, ["g"]).select("g", rounded("score").alias("score"))


@C.add("""WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS c FROM orders GROUP BY 1), b AS (SELECT c_custkey, c_nationkey, coalesce(c, []) AS c, 1.5 * CAST(c_custkey % 11 = 0 AS INT) AS metric1 FROM customer LEFT JOIN s ON o_custkey = c_custkey),
m AS (SELECT *, CASE WHEN len(c) = 0 THEN 0 ELSE len(list_intersect(c, ['1-URGENT', '5-LOW'])) / len(list_distinct(list_concat(c, ['1-URGENT', '5-LOW']))) END AS metric2 FROM b), t AS (SELECT c_nationkey, max(metric2) AS metric2_max, avg(CAST(metric2 > 0 AS INT)) AS pct FROM m GROUP BY 1)
SELECT c_custkey, CAST(metric1 AS DOUBLE) AS metric1, round(metric2, 6) AS metric2, round(metric2_max, 6) AS metric2_max, round(pct, 6) AS pct_metric2_pos, round(CASE WHEN metric2_max = 0 THEN 0 ELSE metric2 / metric2_max END, 6) AS metric2_frac, CAST(metric1 > 1 AS INT) AS metric3, CAST(metric2 > 0 AS INT) AS metric4, CAST(CASE WHEN metric2_max = 0 THEN false ELSE metric2 / metric2_max > 0.5 END AS INT) AS metric5 FROM m JOIN t USING (c_nationkey)""")
def target_metrics(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("codes"))
    c = table(spark, d, "customer").join(s, "c_custkey", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))).withColumn("golden", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    out = E.target_metrics(c, ["c_nationkey"], F.col("c_custkey") % 11 == 0, "codes", "golden")
    return out.select("c_custkey", "metric1", *(rounded(x).alias(x) for x in ("metric2", "metric2_max", "pct_metric2_pos", "metric2_frac")), "metric3", "metric4", "metric5")


@C.add("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def missing_annotations(spark, d):
    golden = table(spark, d, "events").select("user_id")
    return E.missing_annotations(golden, table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id")


@C.add(f"""WITH {_DECIDED}, {_SCORED.split("m AS (SELECT")[0].rstrip().rstrip(",")}, o AS (SELECT c_custkey, c_nationkey, rank, given = 'NOMATCH' AS none, g = 'NOMATCH' AS truth, CASE WHEN given = g THEN 1.5 ELSE 0 END AS m1, CASE WHEN given = g THEN 1.0 WHEN substr(given, 1, 1) = substr(g, 1, 1) THEN 0.5 ELSE 0 END AS m2 FROM r JOIN g USING (c_custkey))
SELECT c_nationkey, round(avg(best), 6) AS score FROM (SELECT c_nationkey, c_custkey, max(CASE WHEN truth AND none THEN 5 - rank WHEN truth OR none THEN 0 ELSE m1 + m2 + (2 - rank) * (m1 / 1.5 + m2) / 2 END) AS best FROM o GROUP BY ALL) GROUP BY c_nationkey""")
def quick_scores(spark, d):
    """The offline scorer: from weighted metrics, without value domains."""
    r = given_and_golden(spark, d)
    same = F.col("given") == F.col("g")
    m1, m2 = F.when(same, 1.5).otherwise(0.0), F.when(same, 1.0).when(F.substring("given", 1, 1) == F.substring("g", 1, 1), 0.5).otherwise(0.0)
    out = r.withColumn("score", E.quick_score(F.col("pos") + 1, m1, m2, F.col("given") == D.NOMATCH, F.col("g") == D.NOMATCH))
    return E.submission_score(out, "c_nationkey", "c_custkey").select("c_nationkey", rounded("score").alias("score"))


@C.add("""WITH n AS (SELECT o_custkey AS cde_id, o_orderstatus AS target, count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) AS bad FROM orders GROUP BY ALL) SELECT cde_id, target FROM (SELECT *, row_number() OVER (PARTITION BY cde_id ORDER BY bad, target) AS r FROM n) WHERE r = 1""")
def best_nodes(spark, d):
    """Of several nodes with one element id that with the fewest unmatched values."""
    p = F.col("o_orderpriority")
    values = table(spark, d, "orders").select(F.col("o_custkey").alias("cde_id"), F.col("o_orderstatus").alias("target"), F.when(p == "1-URGENT", D.NOMATCH).when(p == "5-LOW", "NONCONFORMING").otherwise("CONFORMING").alias("permissible"))
    return D.best_node_of(values)


QUERIES, ORACLES = C.queries, C.oracles
