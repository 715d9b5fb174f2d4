"""Graph tables and paths, on the star schema: parts as concepts, orders as what they are properties of, customers as targets."""

from pyspark.sql import functions as F

from colweave.operators import graph as G
from colweave.plans.base import Catalogue, rounded, table
from colweave.storage import saved

C = Catalogue()


@C.add("""SELECT 'Synonym' AS label, count(DISTINCT p_name) AS n FROM part UNION ALL SELECT 'Concept', count(DISTINCT p_partkey) FROM part UNION ALL SELECT 'SemanticType', count(DISTINCT p_type) FROM part""")
def graph_nodes(spark, d):
    p = table(spark, d, "part")
    made = [G.nodes(p, "Synonym", "p_name", name_lower=F.lower("p_name")).select("label", "id"), G.nodes(p, "Concept", "p_partkey").select("label", "id"), G.nodes(p, "SemanticType", "p_type").select("label", "id")]
    return made[0].unionAll(made[1]).unionAll(made[2]).groupBy("label").agg(F.count("*").alias("n"))


@C.add("""SELECT 'IS_CALLED' AS edge, count(*) AS n, count(DISTINCT p_name) AS n_dst FROM part UNION ALL SELECT 'IS_TYPE', count(*), count(DISTINCT p_type) FROM (SELECT DISTINCT p_name, p_type FROM part)""")
def graph_edges(spark, d):
    p = table(spark, d, "part")
    made = G.edges(p, "IS_CALLED", ("Concept", "p_partkey"), ("Synonym", "p_name")).unionAll(G.edges(p, "IS_TYPE", ("Synonym", "p_name"), ("SemanticType", "p_type"), distinct=True))
    return made.groupBy("edge").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("n_dst"))


@C.add("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_violations(spark, d):
    return G.duplicates(table(spark, d, "orders"), "o_custkey").select("o_custkey", F.col("count").alias("n"))


@C.add("""SELECT 'N' || n_nationkey AS child, 'N' || p AS parent, 1 AS found FROM (SELECT n_nationkey, unnest([n_regionkey, n_nationkey + 10]) AS p FROM nation) WHERE p < 25
UNION ALL SELECT 'N' || n_nationkey, 'N' || (n_nationkey + 10), 0 FROM nation WHERE n_nationkey + 10 >= 25""")
def parent_lookup(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.concat(F.lit("N"), "n_regionkey", F.lit("|N"), F.col("n_nationkey") + 10).alias("parents"))
    found, missing = G.parents(n, "code", "parents")
    return found.withColumn("found", F.lit(1)).unionAll(missing.withColumn("found", F.lit(0)))


def star(spark, d):
    """Scores of part names, and the steps from them to customers."""
    part, line, orders = table(spark, d, "part"), table(spark, d, "lineitem"), table(spark, d, "orders")
    hits = part.groupBy(F.col("p_brand").alias("q"), F.col("p_name").alias("node")).agg(F.max("p_retailprice").alias("score"))
    steps = [part.select(F.col("p_name").alias("src"), F.col("p_partkey").alias("dst")), line.select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst")), orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))]
    return hits, steps


_PATH = """h AS (SELECT p_brand AS q, p_name, max(p_retailprice) AS score FROM part GROUP BY ALL),
r AS (SELECT DISTINCT p_name, o_custkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey)"""


def reached(spark, d, *of_node):
    """Hits at all that their nodes reach, or (node, target) with sums and the like of each node's hits, as many queries hit one node."""
    hits, steps = star(spark, d)
    own = saved(hits.groupBy("node").agg(*of_node) if of_node else hits)  # a table whose size is known: small ones go to the pairs
    return own.join(G.follow(own, steps, many=True), "node")


@C.add(f"WITH {_PATH} SELECT q, o_custkey AS target, round(sum(score), 4) AS sum, round(max(score), 4) AS max FROM h JOIN r USING (p_name) GROUP BY ALL")
def path_sum_max_once(spark, d):
    return reached(spark, d).groupBy("q", "target").agg(rounded(F.sum("score"), 4).alias("sum"), rounded(F.max("score"), 4).alias("max"))


@C.add(f"WITH {_PATH} SELECT o_custkey AS target, round(sum(score), 4) AS sum, count(*) AS n FROM h JOIN r USING (p_name) GROUP BY ALL")
def path_sum(spark, d):
    return reached(spark, d, F.sum("score").alias("score"), F.count("*").alias("n")).groupBy("target").agg(rounded(F.sum("score"), 4).alias("sum"), F.sum("n").alias("n"))


@C.add(f"WITH {_PATH} SELECT o_custkey AS target, round(max(score), 4) AS max, max_by(q, (score, q)) AS best FROM h JOIN r USING (p_name) GROUP BY ALL")
def path_max(spark, d):
    best = F.max(F.struct("score", "q")).alias("best")
    return reached(spark, d, best).groupBy("target").agg(F.max("best").alias("best")).select("target", rounded("best.score", 4).alias("max"), F.col("best.q").alias("best"))


@C.add("""SELECT s_nationkey AS target, round(sum(s_acctbal), 4) AS sum, round(max(s_acctbal), 4) AS max FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def path_one_hop(spark, d):
    s = table(spark, d, "supplier")
    hits = s.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("score"))
    walk = G.follow(hits, [s.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"))])
    return hits.join(walk, "node").groupBy("target").agg(rounded(F.sum("score"), 4).alias("sum"), rounded(F.max("score"), 4).alias("max"))


@C.add("""SELECT n_nationkey, count(DISTINCT k) AS n FROM nation JOIN (SELECT c_nationkey AS nk, 'c' || c_custkey AS k FROM customer UNION ALL SELECT s_nationkey, 's' || s_suppkey FROM supplier) ON nk = n_nationkey GROUP BY ALL""")
def path_any_edge(spark, d):
    """Edges of either kind: the union of two edge tables is one step."""
    kinds = table(spark, d, "customer").select(F.col("c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")).unionAll(table(spark, d, "supplier").select("s_nationkey", F.concat(F.lit("s"), "s_suppkey")))
    start = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return G.follow(start, [kinds]).groupBy(F.col("node").alias("n_nationkey")).agg(F.count("*").alias("n"))


@C.add("""SELECT p_partkey AS target, CAST(coalesce(n, CASE WHEN p_type = 'PROMO' THEN 2 ELSE rows END) AS BIGINT) AS n_answers FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey, (SELECT count(*) AS rows FROM region)""")
def multi_edge_counts(spark, d):
    from colweave.operators.features import answer_counts

    rows = table(spark, d, "region").agg(F.count("*").alias("rows"))  # one row
    elements = table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.when(F.col("p_type") == "PROMO", "BOOLEAN").alias("datatype")).crossJoin(F.broadcast(rows))
    permits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"))
    return answer_counts(elements, permits).select("target", F.col("n_answers").cast("long").alias("n_answers"))


QUERIES, ORACLES = C.queries, C.oracles
