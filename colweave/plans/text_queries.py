"""Text functions on the tables."""

from pyspark.sql import functions as F

from colweave.functions import text as X
from colweave.operators.decompose import decompose
from colweave.plans.base import Catalogue, rounded, table

C = Catalogue()
_NORM = r"lower(translate(regexp_replace(regexp_replace(translate({0}, '_.', '  '), '([a-z])([A-Z])', '\1 \2', 'g'), '([0-9])([A-Z,a-z])', '\1 \2', 'g'), '/,+-()[]', '        '))"


@C.add(f"SELECT p_partkey, {_NORM.format('p_brand')} AS brand, {_NORM.format('p_name')} AS name, {_NORM.format(chr(39) + 'patientAge_at.Visit2days(' + chr(39) + ' || p_type || ' + chr(39) + ')' + chr(39))} AS header FROM part")
def header_to_search_string(spark, d):
    h = X.header_to_search_string
    return table(spark, d, "part").select("p_partkey", h("p_brand").alias("brand"), h("p_name").alias("name"), h(F.concat(F.lit("patientAge_at.Visit2days("), "p_type", F.lit(")"))).alias("header"))


@C.add(r"SELECT p_partkey, regexp_replace(regexp_replace('x1,2y' || p_type || 'aB' || p_brand, '([a-z])([A-Z])', '\1 \2', 'g'), '([0-9])([A-Z,a-z])', '\1 \2', 'g') AS split FROM part")
def camel_digit_split(spark, d):
    return table(spark, d, "part").select("p_partkey", X.split_case_and_digits(F.concat(F.lit("x1,2y"), "p_type", F.lit("aB"), "p_brand")).alias("split"))


@C.add(r"""SELECT p_partkey, unnest(list_filter(string_split(p_name || '|' || p_type || '||' || p_brand, '|'), lambda x: x <> '')) AS item FROM part""")
def pipe_parse_explode(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(X.parse_pipes(F.concat("p_name", F.lit("|"), "p_type", F.lit("||"), "p_brand"))).alias("item"))


@C.add(r"""SELECT p_partkey, split_part(i, ':', 1) AS type, split_part(i, ':', 2) AS code FROM (SELECT p_partkey, unnest(string_split('NCI:' || p_brand || '|X:' || p_type, '|')) AS i FROM part)""")
def concept_parse(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(X.parse_concepts(F.concat(F.lit("NCI:"), "p_brand", F.lit("|X:"), "p_type"))).alias("c")).select("p_partkey", "c.type", "c.code")


@C.add(r"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(e, '\'), lambda x: x <> ''))), '/') AS parts FROM (SELECT p_partkey, unnest(string_split(p_type || '\ncit:C' || p_size || '\' || p_type || '|' || p_brand || '\\', '|')) AS e FROM part)""")
def answer_parse(spark, d):
    s = F.concat("p_type", F.lit("\\ncit:C"), "p_size", F.lit("\\"), "p_type", F.lit("|"), "p_brand", F.lit("\\\\"))
    return table(spark, d, "part").select("p_partkey", F.explode(X.parse_answers(s)).alias("e")).select("p_partkey", F.array_join("e", "/").alias("parts"))


@C.add(r"""SELECT p_partkey, split_part(i, ' - ', 1) AS type, split_part(split_part(i, ' - ', 2), '\', 1) AS value, split_part(i, '\', 2) AS context FROM (SELECT p_partkey, unnest(string_split('T - ' || p_type || '\' || p_brand || '|U - ' || p_name, '|')) AS i FROM part)""")
def classification_parse(spark, d):
    s = F.concat(F.lit("T - "), "p_type", F.lit("\\"), "p_brand", F.lit("|U - "), "p_name")
    return table(spark, d, "part").select("p_partkey", F.explode(X.parse_classifications(s)).alias("c")).select("p_partkey", "c.*")


@C.add(r"""SELECT p_partkey, unnest(regexp_extract_all('ncit:C' || p_size || ' ncit:D' || p_partkey || ' x:Y', 'ncit:(\S+)', 1)) AS code FROM part""")
def concept_code_extract(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(X.concept_codes(F.concat(F.lit("ncit:C"), "p_size", F.lit(" ncit:D"), "p_partkey", F.lit(" x:Y")))).alias("code"))


@C.add("""WITH n AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT a.p_brand, a.p_name AS a, b.p_name AS b,
round(CASE WHEN greatest(length(a.p_name), length(b.p_name)) = 0 THEN 0 ELSE levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name)) END, 6) AS lev FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name""")
def normalized_levenshtein(spark, d):
    n = table(spark, d, "part").select("p_brand", "p_name").distinct()
    pairs = n.withColumnRenamed("p_name", "a").join(n.withColumnRenamed("p_name", "b"), "p_brand").where("a < b")
    return pairs.select("p_brand", "a", "b", rounded(X.normalised_levenshtein("a", "b")).alias("lev"))


@C.add("""WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY o_custkey),
u AS (SELECT c_custkey, coalesce(p, []) AS p, CASE WHEN c_custkey % 2 = 0 THEN ['1-URGENT', '2-HIGH', '5-LOW'] ELSE [] END AS g FROM customer LEFT JOIN s ON o_custkey = c_custkey)
SELECT c_custkey, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 ELSE len(list_intersect(p, g)) / len(list_distinct(list_concat(p, g))) END, 6) AS jaccard FROM u""")
def jaccard_similarity(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    u = table(spark, d, "customer").join(s, F.col("o_custkey") == F.col("c_custkey"), "left")
    empty = F.array().cast("array<string>")
    golden = F.when(F.col("c_custkey") % 2 == 0, F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "5-LOW")))).otherwise(empty)
    return u.select("c_custkey", rounded(X.jaccard(F.coalesce("p", empty), golden)).alias("jaccard"))


@C.add("""WITH n AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
m AS (SELECT c_nationkey, round(avg(n)) AS e FROM n GROUP BY c_nationkey)
SELECT c_custkey, round(CASE WHEN e = 0 THEN 0 ELSE 1 - abs(n - e) / (n + e) END, 6) AS closeness FROM n JOIN m USING (c_nationkey)""")
def count_closeness(spark, d):
    n = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_nationkey").agg(F.count("o_orderkey").alias("n"))
    m = n.groupBy("c_nationkey").agg(F.round(F.avg("n")).alias("e"))
    return n.join(m, "c_nationkey").select("c_custkey", rounded(X.count_closeness("n", "e")).alias("closeness"))


@C.add("""SELECT p_partkey, CAST(greatest(floor(sqrt(length(p_name) / 2)), 3) AS BIGINT) AS shortest, CAST(p_size AS VARCHAR) AS observed, 'ncit:' || p_brand AS reference,
round((length(replace(p_name, ' ', '')) / length(p_name)) * (1 - (length(p_name) - length(replace(p_name, ' ', '')) + 1) / length(p_name)), 6) AS seg_score, round((pow(50, p_size / 50.0) - 1) / 49, 6) AS target, round(ln(1 + 49 * (p_size / 50.0)) / ln(50), 6) AS log_target, round(tan(p_size / 50.0), 6) AS tan_target FROM part""")
def string_profile(spark, d):
    return table(spark, d, "part").select("p_partkey", X.shortest_word("p_name").cast("long").alias("shortest"), X.observed("p_size").alias("observed"), X.concept_reference("p_brand").alias("reference"), rounded(X.segmentation_score("p_name", "p_name", "p_name")).alias("seg_score"), rounded(X.exp_target(F.col("p_size") / 50)).alias("target"), rounded(X.log_target(F.col("p_size") / 50)).alias("log_target"), rounded(X.tan_target(F.col("p_size") / 50)).alias("tan_target"))


def segmentations_sql(strings: str, words: str) -> str:
    """Named parts of a recursive WITH clause down to best(t, segments, score, rank), from strings (t) and words (w), both in lower case and words without spaces: all maximal segmentations, one place after another."""
    return f"""strings_ AS ({strings}), words_ AS ({words}), fit AS (SELECT t, w FROM strings_ JOIN words_ ON contains(t, w) AND length(w) >= greatest(floor(sqrt(length(t) / 2)), 3)),
place AS (SELECT t, a, a + length(w) AS b, w FROM (SELECT t, w, unnest(range(1, length(t) - length(w) + 2)) AS a FROM fit) WHERE substr(t, a, length(w)) = w),
starts AS (SELECT DISTINCT t, a FROM place UNION SELECT DISTINCT t, length(t) + 1 FROM fit), froms AS (SELECT t, 1 AS i FROM (SELECT DISTINCT t FROM fit) UNION SELECT DISTINCT t, b FROM place),
gap AS (SELECT f.t, i, s.a AS j, trim(substr(f.t, i, s.a - i)) AS g FROM froms f JOIN starts s ON s.t = f.t AND s.a > i WHERE s.a <= coalesce((SELECT min(b) - 1 FROM place p WHERE p.t = f.t AND p.a >= i), s.a)),
seg AS (SELECT t, 1 AS pos, true AS word, '' AS full_, 0 AS covered, 0 AS m FROM (SELECT DISTINCT t FROM fit) UNION ALL
  SELECT * FROM (SELECT seg.t, b, true, full_ || ' ' || w, covered + length(w), m + 1 FROM seg JOIN place ON place.t = seg.t AND a = pos UNION ALL SELECT seg.t, j, false, full_ || CASE WHEN g = '' THEN '' ELSE ' ' || g END, covered, m + CASE WHEN g = '' THEN 0 ELSE 1 + length(g) - length(replace(g, ' ', '')) END FROM seg JOIN gap ON gap.t = seg.t AND i = pos WHERE word)),
whole AS (SELECT DISTINCT t, trim(full_) AS segments, covered / length(t) * (1 - m / length(t)) AS score FROM seg WHERE pos = length(t) + 1 AND covered > 0 AND m < length(t)),
best AS (SELECT * FROM (SELECT t, segments, score, row_number() OVER (PARTITION BY t ORDER BY round(score, 9) DESC, segments) AS rank FROM whole) WHERE rank <= 3)"""


_WORDS = "SELECT DISTINCT w FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS w FROM part UNION SELECT lower(p_type) FROM part) WHERE w <> ''"


@C.add(f"""WITH RECURSIVE {segmentations_sql("SELECT DISTINCT lower(replace(p_name, ' ', '')) AS t FROM part", _WORDS)}
SELECT id, segments, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT DISTINCT replace(p_name, ' ', '') AS id FROM part) JOIN best ON t = lower(id)""")
def decompose_strings(spark, d):
    """Run-together part names cut at words of part names and types."""
    part = table(spark, d, "part")
    strings = part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("text")).distinct().select(F.col("text").alias("id"), "text")
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).unionAll(part.select(F.lower("p_type"))).distinct()
    return decompose(strings, words).select("id", "segments", rounded("score").alias("score"), "rank")


@C.add(f"""WITH RECURSIVE {segmentations_sql("SELECT DISTINCT lower(p_type || replace(p_name, ' ', '') || p_type) AS t FROM part WHERE p_size % 5 = 0", "SELECT DISTINCT w FROM (SELECT lower(unnest([p_type[1:4], p_type[3:6], p_type[2:], p_name[1:3], p_name[2:5], split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)])) AS w FROM part) WHERE w <> ''")}
SELECT t, segments, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best""")
def decompose_overlapping(spark, d):
    """Longer run-together strings whose words overlap: pieces of types and of names."""
    part = table(spark, d, "part")
    strings = part.where("p_size % 5 = 0").select(F.lower(F.concat("p_type", F.replace("p_name", F.lit(" "), F.lit("")), "p_type")).alias("t")).distinct()
    pieces = F.array(*(F.expr(e) for e in ("substr(p_type, 1, 4)", "substr(p_type, 3, 4)", "substr(p_type, 2)", "substr(p_name, 1, 3)", "substr(p_name, 2, 4)", "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)")))
    words = part.select(F.explode(pieces).alias("word")).distinct()
    return decompose(strings, words, "t", "t").select("t", "segments", rounded("score").alias("score"), "rank")


QUERIES, ORACLES = C.queries, C.oracles
