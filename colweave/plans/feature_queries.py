"""Feature tables: orders as candidates of customers, documents' sources as groups."""

from pyspark.sql import functions as F

from colweave.operators import features as T
from colweave.plans.base import Catalogue, rounded, table

C = Catalogue()


@C.add("""SELECT coalesce(a.k, b.k, e.k) AS k, coalesce(n_orders, 0) AS n_orders, round(coalesce(total, 0), 4) AS total, coalesce(n_events, 0) AS n_events, coalesce(balance, 0) AS balance
FROM (SELECT o_custkey AS k, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1) b ON a.k = b.k FULL JOIN (SELECT c_custkey AS k, round(c_acctbal, 4) AS balance FROM customer) e ON e.k = coalesce(a.k, b.k)""")
def feature_outer_assembly(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n_events"))
    balance = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 4).alias("balance"))
    return T.assemble([orders, events, balance], ["k"]).withColumn("total", F.round("total", 4))


@C.add("""SELECT o_custkey, coalesce(max(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS f, coalesce(max(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS o FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL""")
def feature_pivot(spark, d):
    long = table(spark, d, "orders").where("o_orderstatus IN ('F', 'O')").select("o_custkey", F.lower("o_orderstatus").alias("feature"), F.col("o_totalprice").alias("value"))
    return T.wide(long, ["o_custkey"], ["f", "o"])


def expanded(spark, d):
    c = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0).alias("done"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("secondary_search"))
    return T.expand(c, ["o_custkey"], ["secondary_search", "price", "done"])


_BASE = "o AS (SELECT o_custkey, o_orderkey, o_totalprice AS price, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS done, CAST(o_orderpriority = '1-URGENT' AS INT) AS sec FROM orders), s AS (SELECT o_custkey, avg(sec) AS max_sec, max(price) AS max_price, max(done) AS max_done, avg(CAST(sec > 0 AS INT)) AS pct_sec, avg(CAST(price > 0 AS INT)) AS pct_price, avg(CAST(done > 0 AS INT)) AS pct_done, avg(price) AS ap, stddev_pop(price) AS sp, avg(done) AS ad, stddev_pop(done) AS sd, count(*) AS n FROM o GROUP BY o_custkey)"


@C.add(f"WITH {_BASE} SELECT o_custkey, round(max_sec, 6) AS max_secondary_search, max_price, max_done, round(pct_sec, 6) AS pct_secondary_search, round(pct_done, 6) AS pct_done, n, round(ln(n), 6) AS logn FROM s")
def feature_stats(spark, d):
    return expanded(spark, d).select("o_custkey", rounded("max_secondary_search").alias("max_secondary_search"), "max_price", "max_done", rounded("pct_secondary_search").alias("pct_secondary_search"), rounded("pct_done").alias("pct_done"), "n", rounded("logn").alias("logn")).distinct()


@C.add(f"WITH {_BASE} SELECT o_orderkey, round(CASE WHEN max_price = 0 THEN 0 ELSE price / max_price END, 4) AS price_frac, round(CASE WHEN max_done = 0 THEN 0 ELSE done / max_done END, 4) AS done_frac, round(CASE WHEN sp = 0 THEN 0 ELSE (price - ap) / sp END, 4) AS price_norm, round(CASE WHEN sd = 0 THEN 0 ELSE (done - ad) / sd END, 4) AS done_norm FROM o JOIN s USING (o_custkey) WHERE n > 1")
def feature_frac_norm(spark, d):
    return expanded(spark, d).where("n > 1").select("o_orderkey", *(rounded(c, 4).alias(c) for c in ("price_frac", "done_frac", "price_norm", "done_norm")))


@C.add("""WITH l AS (SELECT 1 AS col_no, 'c_name' AS header, c_name AS value FROM customer UNION ALL SELECT 2, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 3, 'c_mktsegment', nullif(c_mktsegment, 'BUILDING') FROM customer)
SELECT 'customer' AS sheet, col_no, header, count(*) AS n_rows, count(DISTINCT value) AS n_distinct, CAST(count(DISTINCT value) < sqrt(count(*)) AS INT) AS enumerated FROM l WHERE value IS NOT NULL GROUP BY ALL""")
def column_profile(spark, d):
    c = table(spark, d, "customer").select("c_name", "c_nationkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return T.profile(T.unpivoted(c, "customer"))


QUERIES, ORACLES = C.queries, C.oracles
