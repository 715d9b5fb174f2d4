"""Full-text search: benchmark items as queries, documents and part names as texts."""

from pyspark.sql import functions as F

from colweave.operators import search as S
from colweave.plans.base import Catalogue, rounded, table

C = Catalogue()


def bm25_sql(docs: str, queries: str) -> str:
    """Named parts of a WITH clause down to hits(q, d, score), from docs (d, t) and queries (q, t)."""
    tok = r"regexp_extract_all(lower(t), '[\p{L}\p{N}]+')"
    return f"""src AS ({docs}), qsrc AS ({queries}), dt AS (SELECT d, {tok} AS ts FROM src), dl AS (SELECT d, len(ts) AS dl FROM dt), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qt AS (SELECT q, token, count(*) AS qtf FROM (SELECT q, unnest({tok}) AS token FROM qsrc) GROUP BY ALL),
tf AS (SELECT d, token, count(*) AS tf FROM (SELECT d, unnest(ts) AS token FROM dt) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
hits AS (SELECT q, d, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (d), corpus GROUP BY q, d)"""


DOCS, ITEMS = "SELECT doc_id AS d, text AS t FROM documents", "SELECT item_id AS q, text AS t FROM benchmark"


def hits(spark, d):
    return S.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), query="item_id", query_text="text")


@C.add(f"WITH {bm25_sql(DOCS, ITEMS)} SELECT q AS item_id, d AS doc_id, round(score, 6) AS score FROM hits")
def fulltext_bm25(spark, d):
    return hits(spark, d).select("item_id", "doc_id", rounded("score").alias("score"))


@C.add(f"WITH {bm25_sql(DOCS, ITEMS)} SELECT q AS item_id, d AS doc_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d) AS r FROM hits) WHERE r <= 3")
def fulltext_topk(spark, d):
    return S.bm25_top_k(table(spark, d, "documents"), table(spark, d, "benchmark"), 3, query="item_id", query_text="text").select("item_id", "doc_id", rounded("score").alias("score"), "rank")


@C.add(f"""WITH {bm25_sql("SELECT DISTINCT p_name AS d, p_name AS t FROM part", "SELECT p_brand || '~1' AS q, min(p_name) AS t FROM part GROUP BY p_brand UNION ALL SELECT p_brand || '~2', max(p_name) || ' ' || p_brand FROM part GROUP BY p_brand")},
w AS (SELECT split_part(q, '~', 1) AS query_id, d, CASE WHEN split_part(q, '~', 2) = '1' THEN 1.0 ELSE 0.5 END AS c, score FROM hits)
SELECT query_id, d AS p_name, round(max(c * score), 6) AS score FROM w WHERE score > 0.2 / c GROUP BY ALL""")
def fulltext_multi_weighted(spark, d):
    part = table(spark, d, "part")
    g = part.groupBy("p_brand").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    strings = g.select(F.col("p_brand").alias("query_id"), F.lit(1).alias("string_no"), F.lit(1.0).alias("coefficient"), F.col("a").alias("query_text")).unionAll(g.select("p_brand", F.lit(2), F.lit(0.5), F.concat("b", F.lit(" "), "p_brand")))
    return S.weighted_search(part.select("p_name").distinct().withColumn("text", F.col("p_name")), strings, 0.2, "p_name").select("query_id", "p_name", rounded("score").alias("score"))


@C.add("""WITH v AS (SELECT DISTINCT c_nationkey, lower(p) AS v FROM customer JOIN (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) ON o_custkey = c_custkey), n AS (SELECT c_nationkey, count(*) AS n FROM v GROUP BY ALL),
p AS (SELECT DISTINCT p_type AS target, lower(o_orderpriority) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
SELECT c_nationkey, target, round(count(*) / max(n), 6) AS score FROM v JOIN p USING (v) JOIN n USING (c_nationkey) GROUP BY ALL""")
def exact_value_search(spark, d):
    """Priorities of a nation's orders as a column's values, those of orders of a type's parts as permitted values."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    values = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderpriority").distinct()
    permitted = o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_type").alias("target"), "o_orderpriority").distinct()
    return S.exact_share(values, permitted, "c_nationkey", "o_orderpriority", "target").select("c_nationkey", "target", rounded("score").alias("score"))


_VALUES = "v AS (SELECT DISTINCT p_brand AS g, p_name AS v FROM part), vn AS (SELECT g, count(*) AS n FROM v GROUP BY g)"
_NAMES, _WORDS = "SELECT DISTINCT p_type || '/' || p_name AS d, p_name AS t FROM part", "SELECT DISTINCT p_name AS q, p_name AS t FROM part"


def value_hits(spark, d):
    """Part names as values, searched in part names that types permit."""
    part = table(spark, d, "part")
    names = part.select("p_name").distinct()
    docs = part.select("p_type", "p_name").distinct().select(F.struct("p_type", "p_name").alias("doc_id"), F.col("p_name").alias("text"))
    return S.bm25(docs, names.select(F.col("p_name").alias("v"), F.col("p_name").alias("query_text")), query="v").select("v", F.col("doc_id.p_type").alias("target"), "score")


@C.add(f"WITH {bm25_sql(_NAMES, _WORDS)}, {_VALUES}, best AS (SELECT q AS v, split_part(d, '/', 1) AS target, max(score) AS best FROM hits GROUP BY ALL) SELECT g, target, round(sum(best) / max(n), 6) AS score FROM v JOIN best USING (v) JOIN vn USING (g) GROUP BY ALL")
def value_search_mean(spark, d):
    values = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_name").alias("v"))
    return S.mean_over_values(value_hits(spark, d), values, "g", "v", "target").select("g", "target", rounded("score").alias("score"))


@C.add(f"""WITH {bm25_sql(_NAMES, _WORDS)}, {_VALUES}, best AS (SELECT q AS v, split_part(d, '/', 1) AS target FROM hits GROUP BY ALL HAVING max(score) > 1.5), cand AS (SELECT DISTINCT p_brand AS g, p_type AS target FROM part),
f AS (SELECT g, target, count(*) AS h FROM v JOIN best USING (v) GROUP BY ALL) SELECT g, target, round(coalesce(h, 0) / n, 6) AS score FROM cand LEFT JOIN f USING (g, target) JOIN vn USING (g)""")
def value_hit_ratio(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_name").alias("v"), F.col("p_type").alias("target"))
    return S.hit_share(value_hits(spark, d), part, part.select("g", "target"), "g", "v", "target", 1.5).select("g", "target", rounded("score").alias("score"))


@C.add("""WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), t AS (SELECT p_partkey, lower(p_type || p_name || p_brand) AS s FROM part) SELECT p_partkey, word FROM t JOIN w ON contains(s, word)""")
def dictionary_contains(spark, d):
    part = table(spark, d, "part")
    words = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return S.contained_words(part.select("p_partkey", F.concat("p_type", "p_name", "p_brand").alias("s")), words, "p_partkey", "s", "word")


@C.add(f"""WITH {bm25_sql("SELECT DISTINCT p_name AS d, p_name AS t FROM part", "SELECT p_brand || '~1' AS q, max(p_name) AS t FROM part WHERE p_size = 7 GROUP BY p_brand UNION ALL SELECT p_brand || '~2', min(p_name) FROM part GROUP BY p_brand")},
a AS (SELECT split_part(q, '~', 1) AS query_id, d, score FROM hits WHERE split_part(q, '~', 2) = '1'), b AS (SELECT split_part(q, '~', 1) AS query_id, d, score FROM hits WHERE split_part(q, '~', 2) = '2'),
few AS (SELECT query_id FROM b GROUP BY 1 HAVING (SELECT count(*) FROM a WHERE a.query_id = b.query_id) < 6)
SELECT query_id, d AS p_name, round(score, 6) AS score, 0 AS secondary_search FROM a UNION ALL SELECT query_id, d, round(score, 6), 1 FROM b WHERE query_id IN (SELECT query_id FROM few) AND (query_id, d) NOT IN (SELECT query_id, d FROM a)""")
def secondary_search(spark, d):
    part = table(spark, d, "part")
    docs = part.select("p_name").distinct().withColumn("text", F.col("p_name"))
    one = part.where("p_size = 7").groupBy(F.col("p_brand").alias("query_id")).agg(F.max("p_name").alias("query_text"))
    two = part.groupBy(F.col("p_brand").alias("query_id")).agg(F.min("p_name").alias("query_text"))
    out = S.secondary_search(S.bm25(docs, one, "p_name"), S.bm25(docs, two, "p_name"), "query_id", "p_name", 6)
    return out.select("query_id", "p_name", rounded("score").alias("score"), "secondary_search")


QUERIES, ORACLES = C.queries, C.oracles
