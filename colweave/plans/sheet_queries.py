"""Sheets matched end to end on the star schema: parts are concepts, suppliers data elements, brands sheets whose columns are sizes of parts."""

import functools
import uuid

from pyspark.sql import functions as F

from colweave.operators import classify as K
from colweave.operators import decide as D
from colweave.operators import graph as G
from colweave.operators import models as M
from colweave.plans.base import Catalogue, rounded, table
from colweave.plans.text_queries import _NORM, segmentations_sql
from colweave.sources.files import write_training
from colweave.sources.sheets import read_sheets
from colweave.storage import at_end, delete, saved, shared_folder

C = Catalogue()
TYPES = ("Integer", "CHARACTER", "BOOLEAN", "NUMBER", "no such type")


def reference(spark, d):
    """Tables of concepts and of data elements."""
    part, lit, c = table(spark, d, "part"), F.lit, F.col
    none = F.lit(None).cast("string")
    code = F.concat(lit("C"), "p_partkey")
    concepts = part.select(code.alias("CODE"), c("p_name").alias("CONCEPT_NAME"), none.alias("DEFINITION"), F.concat("p_name", lit("|"), "p_type").alias("SYNONYMS"), c("p_type").alias("SEMANTIC_TYPE"), F.concat(lit("C"), (c("p_partkey") / 7).cast("long")).alias("PARENTS"))
    own = table(spark, d, "supplier").join(part, c("p_partkey") == c("s_suppkey")).join(table(spark, d, "nation"), c("n_nationkey") == c("s_nationkey"))
    i = c("s_suppkey")
    elements = own.select(
        i.alias("CDE_ID"),
        F.concat("p_name", lit(" "), "p_brand").alias("CDE_LONG_NAME"),
        F.concat(F.upper(F.replace("p_name", lit(" "), lit("_"))), lit("|"), "p_type").alias("CDE_SHORT_NAME"),
        F.when(i % 2 == 0, "Enumerated").otherwise("NonEnumerated").alias("VALUE_DOMAIN_TYPE"),
        F.element_at(F.array(*map(lit, TYPES)), (i % 5 + 1).cast("int")).alias("DATATYPE"),
        none.alias("UNIT_OF_MEASURE"),
        F.when(i % 3 == 0, "YYYY").when(i % 7 == 0, "no such format").alias("DISPLAY_FORMAT"),
        F.when(i % 4 == 0, F.concat(lit("Which "), "p_name", lit("?"))).alias("QUESTION_TEXT"),
        c("s_nationkey").cast("long").alias("DEC_ID"),
        c("n_name").alias("DEC_LONG_NAME"),
        F.concat(lit("NCI:C"), i, lit("|NCI:X"), "s_nationkey").alias("OBJECT_CLASS_CONCEPTS"),
        F.concat(lit("NCI:C"), i + 1).alias("PROPERTY_CONCEPTS"),
        F.concat(lit("T - "), "p_type", lit("\\ctx")).alias("CLASSIFICATIONS"),
        F.concat("p_name", lit("\\ncit:C"), i, lit("|"), "p_type", lit("|"), "p_brand").alias("PERMISSIBLE_VALUES"),
    )
    return concepts, elements


def graph(spark, d):
    return G.build(*reference(spark, d))


@functools.lru_cache(maxsize=4)
def prepared(spark, d):
    """The stored graph and its two stored indexes, made once in a session as a database is."""
    folder = f"{shared_folder(spark)}/graphs/{uuid.uuid4().hex}"
    g = graph(spark, d).stored(spark, folder)
    return g, *K.indexes(spark, g, folder)


def sheets(spark, d):
    """Columns, cells, and strings for the second search."""
    no = (F.col("p_size") % 6 + 1).cast("int")
    part = table(spark, d, "part").withColumn("col_no", no)
    own = part.groupBy(F.col("p_brand").alias("sheet"), "col_no").agg(F.min("p_type").alias("t"), F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    columns = own.select("sheet", "col_no", F.when(F.col("col_no") == 6, F.concat(F.lit("zz"), F.replace("a", F.lit(" "), F.lit("")))).otherwise(F.concat(F.lit("col_"), "t", F.lit("."), "a")).alias("header"))
    value = F.when(F.col("col_no") == 2, (F.col("p_size") + 1990).cast("string")).when(F.col("col_no") == 3, F.concat("p_size", F.lit(".5"))).when(F.col("p_size") % 5 != 0, F.col("p_name"))
    return columns, part.select(F.col("p_brand").alias("sheet"), "col_no", value.alias("value")), own.select("sheet", "col_no", F.lit(1).alias("string_no"), F.lit(0.5).alias("coefficient"), F.col("b").alias("query_text"))


# the same in SQL, by natural keys

_TOK = r"regexp_extract_all(lower(coalesce(t, '')), '[\p{L}\p{N}]+')"
_GRAPH = f"""syn AS (SELECT DISTINCT unnest([p_name, p_type]) AS s FROM part), called AS (SELECT DISTINCT unnest([p_name, p_type]) AS s, 'C' || p_partkey AS code FROM part),
el AS (SELECT s_suppkey AS id, s_nationkey AS dec, n_name, p_name, p_type, p_brand, p_name || ' ' || p_brand AS long_name, upper(replace(p_name, ' ', '_')) AS short_name, s_suppkey % 2 = 0 AS enumerated,
  [{', '.join(repr(t) for t in TYPES)}][s_suppkey % 5 + 1] AS datatype, CASE WHEN s_suppkey % 3 = 0 THEN 'YYYY' WHEN s_suppkey % 7 = 0 THEN 'no such format' END AS format, CASE WHEN s_suppkey % 4 = 0 THEN 'Which ' || p_name || '?' END AS question
  FROM supplier JOIN part ON p_partkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey),
obj AS (SELECT DISTINCT dec, unnest(['C' || id, 'X' || dec]) AS code FROM el), prop AS (SELECT DISTINCT dec, 'C' || (id + 1) AS code FROM el),
perm AS (SELECT id, unnest([{{'a': 'n' || id || p_name, 't': p_name, 'c': 'C' || id}}, {{'a': 't' || p_type, 't': p_type, 'c': NULL}}, {{'a': 'b' || p_brand, 't': p_brand, 'c': NULL}}]) AS x FROM el),
answer AS (SELECT DISTINCT id, x.a AS answer, x.t AS text, x.c AS code FROM perm)"""


def _index(name: str, entries: str, asked: str) -> str:
    """CTEs down to {name}(q, label, node, score) from entries (field, label, node, t) and asked (q, t)."""
    n = name
    return f"""{n}_e AS ({entries}), {n}_t AS (SELECT field, label, node, {_TOK} AS ts FROM {n}_e), {n}_s AS (SELECT field, count(*) AS n, avg(len(ts)) AS avgdl FROM {n}_t GROUP BY field),
{n}_f AS (SELECT field, label, node, dl, token, count(*) AS tf FROM (SELECT field, label, node, len(ts) AS dl, unnest(ts) AS token FROM {n}_t) GROUP BY ALL), {n}_d AS (SELECT field, token, count(*) AS df FROM {n}_f GROUP BY ALL),
{n}_q AS (SELECT q, token, count(*) AS qtf FROM (SELECT q, unnest({_TOK}) AS token FROM ({asked})) GROUP BY ALL),
{n} AS (SELECT q, label, node, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {n}_q JOIN {n}_f USING (token) JOIN {n}_d USING (field, token) JOIN {n}_s USING (field) GROUP BY ALL)"""


_NAMES = """SELECT 'name' AS field, 'Synonym' AS label, s AS node, s AS t FROM syn UNION ALL SELECT DISTINCT 'name', 'CDE_Name', x, x FROM (SELECT unnest([short_name, p_type]) AS x FROM el)
UNION ALL SELECT DISTINCT 'name', 'QuestionText', question, question FROM el WHERE question IS NOT NULL UNION ALL SELECT DISTINCT 'name', 'DEC', CAST(dec AS VARCHAR), n_name FROM el
UNION ALL SELECT 'name', 'CDE', CAST(id AS VARCHAR), short_name || '|' || p_type FROM el UNION ALL SELECT 'CDE_LONG_NAME', 'CDE', CAST(id AS VARCHAR), long_name FROM el"""
_ANSWERS = "SELECT DISTINCT 'name' AS field, 'AnswerText' AS label, text AS node, text AS t FROM answer"
_REACH = """reach AS (SELECT DISTINCT 'Synonym' AS label, s AS node, id, 'prop' AS f FROM called JOIN prop USING (code) JOIN el USING (dec) UNION SELECT 'Synonym', s, id, 'obj' FROM called JOIN obj USING (code) JOIN el USING (dec)
UNION SELECT 'CDE_Name', unnest([short_name, p_type]), id, 'cde' FROM el UNION SELECT 'CDE', CAST(id AS VARCHAR), id, 'cde' FROM el UNION SELECT 'DEC', CAST(dec AS VARCHAR), id, 'dec' FROM el UNION SELECT 'QuestionText', question, id, 'que' FROM el WHERE question IS NOT NULL)"""


def _walk(hits: str) -> str:
    pick = ", ".join(f"coalesce({how}(score) FILTER (f = '{f}'), 0) AS {name}" for name, f, how in (("syn_propsum", "prop", "sum"), ("syn_propmax", "prop", "max"), ("syn_objsum", "obj", "sum"), ("syn_objmax", "obj", "max"), ("ftsearch_cde", "cde", "max"), ("ftsearch_dec", "dec", "max"), ("ftsearch_question", "que", "max")))
    return f"SELECT q, id, {pick} FROM {hits} JOIN reach USING (label, node) GROUP BY q, id"


_VALUE_REACH = """vreach AS (SELECT DISTINCT 'AnswerText' AS label, text AS node, id, 'a' AS f FROM answer UNION SELECT 'Synonym', s, id, 'c' FROM called JOIN answer USING (code))"""
_SHEETS = f"""own AS (SELECT p_brand AS sheet, CAST(p_size % 6 + 1 AS INT) AS col_no, min(p_type) AS ty, min(p_name) AS a, max(p_name) AS b FROM part GROUP BY ALL),
cols AS (SELECT sheet, col_no, header, {{'sheet': sheet, 'col_no': col_no}} AS q, {_NORM.format('header')} AS t FROM (SELECT sheet, col_no, CASE WHEN col_no = 6 THEN 'zz' || replace(a, ' ', '') ELSE 'col_' || ty || '.' || a END AS header FROM own)),
cells AS (SELECT p_brand AS sheet, CAST(p_size % 6 + 1 AS INT) AS col_no, CASE WHEN p_size % 6 = 1 THEN CAST(p_size + 1990 AS VARCHAR) WHEN p_size % 6 = 2 THEN p_size || '.5' WHEN p_size % 5 <> 0 THEN p_name END AS value FROM part),
vals AS (SELECT {{'sheet': sheet, 'col_no': col_no}} AS q, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL), vq AS (SELECT DISTINCT value AS q, value AS t FROM vals)"""
_CAND = f"""{_GRAPH}, {_REACH}, {_VALUE_REACH}, {_SHEETS}, {_index('h1', _NAMES, 'SELECT q, t FROM cols')},
cnt AS (SELECT q, count(*) AS n, count(*) FILTER (label <> 'Synonym') AS m FROM h1 GROUP BY q), few AS (SELECT cols.q, t FROM cols LEFT JOIN cnt ON cnt.q = cols.q WHERE coalesce(n, 0) < 25 OR coalesce(m, 0) < 5),
strs AS (SELECT q, 0 AS no, 1.0 AS w, t FROM few UNION ALL SELECT few.q, 1, 0.5, b FROM few JOIN own ON few.q.sheet = own.sheet AND few.q.col_no = own.col_no),
{_index('hs', _NAMES, "SELECT {'q': q, 'no': no, 'w': w} AS q, t FROM strs")}, h2 AS (SELECT q.q AS q, label, node, max(q.w * score) AS score FROM hs WHERE score > 0 GROUP BY ALL),
one AS ({_walk('h1')}), two AS ({_walk('h2')}), named AS (SELECT *, 0 AS secondary_search FROM one UNION ALL SELECT *, 1 FROM two WHERE NOT EXISTS (FROM one WHERE one.q = two.q AND one.id = two.id)),
{_index('vn', _NAMES, 'SELECT q, t FROM vq')}, {_index('va', _ANSWERS, 'SELECT q, t FROM vq')}, vh AS (SELECT * FROM vn WHERE label = 'Synonym' UNION ALL SELECT * FROM va),
vp AS (SELECT q AS value, id, coalesce(max(score) FILTER (f = 'c'), 0) AS c, coalesce(max(score) FILTER (f = 'a'), 0) AS a FROM vh JOIN vreach USING (label, node) GROUP BY ALL),
nv AS (SELECT q, count(*) AS n_values, sum(n) AS n_rows FROM vals GROUP BY q), valued AS (SELECT q, id, sum(c) / max(n_values) AS enum_concept_search, sum(a) / max(n_values) AS enum_answer_search, count(*) FILTER (c > 0 OR a > 0) AS hits FROM vals JOIN vp USING (value) JOIN nv USING (q) GROUP BY q, id),
joined AS (SELECT coalesce(named.q, valued.q) AS q, coalesce(named.id, valued.id) AS id, coalesce(secondary_search, 0) AS secondary_search, {', '.join(f'coalesce({f}, 0) AS {f}' for f in ('syn_propsum', 'syn_propmax', 'syn_objsum', 'syn_objmax', 'ftsearch_cde', 'ftsearch_dec', 'ftsearch_question', 'enum_concept_search', 'enum_answer_search', 'hits'))} FROM named FULL JOIN valued ON named.q = valued.q AND named.id = valued.id),
conf AS (SELECT q, avg(CAST(regexp_full_match(value, '\\d{{4}}') AS INT)) AS y, avg(CAST(regexp_full_match(value, '[+-]?\\d+') OR regexp_full_match(value, '[+-]?\\d+\\.0*') AS INT)) AS i, avg(CAST(NOT regexp_full_match(value, '[0-9]*.{{0,1}}[0-9]*') AS INT)) AS c, avg(CAST(regexp_full_match(value, '\\d+(\\.\\d*)?') AS INT)) AS u FROM vals GROUP BY q),
counts AS (SELECT id, count(*) AS n FROM perm GROUP BY id),
cand AS (SELECT joined.q.sheet AS sheet, joined.q.col_no AS col_no, joined.id AS cde_id, secondary_search, 0.0 AS syn_classsum, syn_propsum, syn_objsum, 0.0 AS syn_classmax, syn_propmax, syn_objmax, ftsearch_cde, ftsearch_dec, ftsearch_question, enum_concept_search, enum_answer_search,
  1 - abs(coalesce(n_values, 0) - counts.n) / (coalesce(n_values, 0) + counts.n) AS answer_count_score,
  CASE WHEN coalesce(n_values, 0) = 0 THEN 0 WHEN enumerated THEN hits / n_values WHEN format = 'YYYY' THEN y WHEN format IS NOT NULL THEN 0 WHEN datatype = 'Integer' THEN i WHEN datatype = 'CHARACTER' THEN c WHEN datatype = 'BOOLEAN' THEN 1 WHEN datatype = 'NUMBER' THEN u ELSE 0 END AS value_score
  FROM joined JOIN el USING (id) JOIN counts USING (id) LEFT JOIN nv ON nv.q = joined.q LEFT JOIN conf ON conf.q = joined.q)"""


@C.add(f"""WITH {_GRAPH} SELECT 'Concept' AS name, (SELECT count(*) FROM part) + (SELECT count(*) FROM (SELECT DISTINCT code FROM (FROM obj UNION FROM prop) WHERE code NOT IN (SELECT 'C' || p_partkey FROM part))) AS n
UNION ALL SELECT 'Synonym', count(*) FROM syn UNION ALL SELECT 'SemanticType', count(DISTINCT p_type) FROM part UNION ALL SELECT 'CDE', count(*) FROM el UNION ALL SELECT 'CDE_Name', count(DISTINCT x) FROM (SELECT unnest([short_name, p_type]) AS x FROM el)
UNION ALL SELECT 'QuestionText', count(DISTINCT question) FROM el UNION ALL SELECT 'DEC', count(DISTINCT dec) FROM el UNION ALL SELECT 'Classification', count(DISTINCT p_type) FROM el UNION ALL SELECT 'Answer', count(DISTINCT answer) FROM answer UNION ALL SELECT 'AnswerText', count(DISTINCT text) FROM answer
UNION ALL SELECT 'IS_CALLED', 2 * count(*) FROM part UNION ALL SELECT 'IS_TYPE', count(*) FROM part UNION ALL SELECT 'IS_CHILD', count(*) FROM part WHERE p_partkey // 7 IN (SELECT p_partkey FROM part) UNION ALL SELECT 'IS_SHORT', 2 * count(*) FROM el UNION ALL SELECT 'QUESTION', count(question) FROM el
UNION ALL SELECT 'IS_CAT', count(*) FROM el UNION ALL SELECT 'IS_OBJ', 2 * count(*) FROM el UNION ALL SELECT 'IS_PROP', count(*) FROM el UNION ALL SELECT 'IS_CLASS', count(*) FROM el UNION ALL SELECT 'PERMITS', 3 * count(*) FROM el UNION ALL SELECT 'EQUALS', count(DISTINCT (answer, code)) FROM answer WHERE code IS NOT NULL UNION ALL SELECT 'CAN_BE', count(DISTINCT (answer, text)) FROM answer""")
def graph_build(spark, d):
    """Nodes of each label and edges of each kind of a graph built from tables of concepts and elements."""
    g = graph(spark, d)
    out = None
    for name, df in (*g.nodes.items(), *g.edges.items()):
        own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionAll(own)
    return out


@C.add(f"WITH {_GRAPH}, {_REACH}, {_SHEETS}, {_index('h1', _NAMES, 'SELECT q, t FROM cols')}, w AS ({_walk('h1')}) SELECT q.sheet AS sheet, q.col_no AS col_no, id AS cde_id, 0.0 AS syn_classsum, {', '.join(f'round({f}, 6) AS {f}' for f in ('syn_propsum', 'syn_propmax', 'syn_objsum', 'syn_objmax', 'ftsearch_cde', 'ftsearch_dec', 'ftsearch_question'))}, 0.0 AS syn_classmax FROM w")
def propagate_scores(spark, d):
    """Hits of headers in the name index over two fields, carried to elements along all declared paths."""
    g, names, _ = prepared(spark, d)
    columns, _, _ = sheets(spark, d)
    from colweave.functions.text import header_to_search_string

    hits = names.search(columns.select(K.key().alias("query_id"), header_to_search_string("header").alias("query_text")))
    out = G.propagate(hits, g).join(g.nodes["CDE"].select(F.col("id").alias("target"), "cde_id"), "target")
    return out.select("query_id.sheet", "query_id.col_no", "cde_id", *(rounded(f).alias(f) for f in K.NAME_FEATURES))


@C.add(f"WITH {_GRAPH}, {_VALUE_REACH}, {_SHEETS}, {_index('vn', _NAMES, 'SELECT q, t FROM vq')}, {_index('va', _ANSWERS, 'SELECT q, t FROM vq')}, vh AS (SELECT * FROM vn WHERE label = 'Synonym' UNION ALL SELECT * FROM va) SELECT q AS value, id AS cde_id, round(coalesce(max(score) FILTER (f = 'c'), 0), 6) AS enum_concept_search, round(coalesce(max(score) FILTER (f = 'a'), 0), 6) AS enum_answer_search FROM vh JOIN vreach USING (label, node) GROUP BY ALL")
def value_paths(spark, d):
    """Single values at elements that permit them: by answers' texts, and by concepts that answers mean."""
    g, names, answers = prepared(spark, d)
    _, cells, _ = sheets(spark, d)
    out = K.value_hits(cells.where("value IS NOT NULL").select("value", F.col("value").alias("query_text")).distinct(), g, names, answers)
    return out.join(g.nodes["CDE"].select(F.col("id").alias("target"), "cde_id"), "target").select("value", "cde_id", rounded("enum_concept_search").alias("enum_concept_search"), rounded("enum_answer_search").alias("enum_answer_search"))


@C.add(f"WITH {_GRAPH} SELECT id AS cde_id, long_name AS name, CAST(dec AS BIGINT) AS dec_id, n_name AS dec_name, (SELECT string_agg(code, ',' ORDER BY code) FROM (SELECT DISTINCT code FROM (FROM obj UNION FROM prop) o WHERE o.dec = el.dec)) AS codes FROM el")
def element_concepts(spark, d):
    """Header and concept set of every element."""
    g, _, _ = prepared(spark, d)
    codes = saved(G.category_codes(g).select("first", F.array_join("codes", ",").alias("codes")))
    return G.element_headers(g).join(g.categories(), "target").join(codes, "first").select("cde_id", F.col("cde_long_name").alias("name"), "dec_id", "dec_name", "codes")


def candidates(spark, d):
    g, names, answers = prepared(spark, d)
    columns, cells, strings = sheets(spark, d)
    return K.candidate_features(columns, cells, g, names, answers, strings=strings)


@C.add(f"WITH {_CAND} SELECT sheet, col_no, cde_id, secondary_search, {', '.join(f'round({f}, 6) AS {f}' for f in K.FEATURES[1:])} FROM cand")
def column_candidates(spark, d):
    """Both searches of headers, value searches, answer counts and value scores of every candidate of every column."""
    return candidates(spark, d).select("sheet", "col_no", "cde_id", "secondary_search", *(rounded(f).alias(f) for f in K.FEATURES[1:]))


_EXP = f"""stat AS (SELECT sheet, col_no, avg(secondary_search) AS max_secondary_search, avg(secondary_search) AS pct_secondary_search, ln(count(*)) AS logn, {', '.join(f'max({f}) AS max_{f}, avg(CAST({f} > 0 AS INT)) AS pct_{f}, avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}' for f in K.FEATURES[1:])} FROM cand GROUP BY ALL),
ex AS (SELECT cand.*, stat.* EXCLUDE (sheet, col_no), {', '.join(f'CASE WHEN s_{f} < 1e-12 THEN 0 ELSE ({f} - a_{f}) / s_{f} END AS {f}_norm' for f in K.FEATURES[1:])}, pct_secondary_search * max_enum_answer_search AS c1, pct_secondary_search * max_value_score AS c2, pct_secondary_search * pct_enum_concept_search AS c3, pct_secondary_search * pct_ftsearch_question AS c4,
  pct_secondary_search * (pct_syn_propsum + pct_syn_objsum) AS c5, pct_ftsearch_cde + pct_ftsearch_question AS c6, sqrt((max_ftsearch_cde + 1) * (max_ftsearch_question + 1)) - 1 AS c7 FROM cand JOIN stat USING (sheet, col_no))"""


@C.add(f"WITH {_CAND}, {_EXP} SELECT DISTINCT sheet, col_no, {', '.join(f'round({f}, 5) AS {f}' for f in (*M.NOMATCH_COLUMNS, 'c1', 'c2', 'c3', 'c4', 'c5'))} FROM ex")
def nomatch_vectors(spark, d):
    """What the model of columns without a match sees, one row for each column."""
    ex = M.first_of_each(K.expanded_features(candidates(spark, d)), K.COLUMN, ["cde_id"])
    return ex.select("sheet", "col_no", *(rounded(f, 5).alias(f) for f in (*M.NOMATCH_COLUMNS, "c1", "c2", "c3", "c4", "c5")))


@C.add(f"WITH {_CAND}, {_EXP} SELECT sheet, col_no, cde_id, {', '.join(f'round({f}, 4) AS {f}' for f in M.VALUE_COLUMNS)} FROM ex")
def value_vectors(spark, d):
    """What the model of candidates sees."""
    return K.expanded_features(candidates(spark, d)).select("sheet", "col_no", "cde_id", *(rounded(f, 4).alias(f) for f in M.VALUE_COLUMNS))


def simple_nomatch(df):
    return df.withColumn("p_nomatch", F.round(1 / (1 + F.col("max_enum_answer_search") + F.col("c6")), 6))


def simple_estimate(df):
    return df.withColumn("estimate", F.round(F.col("ftsearch_cde") + F.col("enum_answer_search") + F.col("value_score") + 0.1 * F.col("answer_count_score"), 6))


_DECIDED = f"""{_CAND}, {_EXP}, rk AS (SELECT sheet, col_no, cde_id, p, row_number() OVER (PARTITION BY sheet, col_no ORDER BY e DESC, cde_id) AS r FROM (SELECT sheet, col_no, cde_id, round(ftsearch_cde + enum_answer_search + value_score + 0.1 * answer_count_score, 6) AS e, round(1 / (1 + max_enum_answer_search + c6), 6) AS p FROM ex)),
tops AS (SELECT sheet, col_no, max(p) AS p, list(CAST(cde_id AS VARCHAR) ORDER BY r) AS c FROM rk WHERE r <= 3 GROUP BY ALL),
dec_ AS (SELECT cols.sheet, cols.col_no, header, CASE WHEN c IS NULL THEN ['NOMATCH'] WHEN p < 0.4 THEN c WHEN p < 0.5 THEN list_concat(list_concat(c[1:1], ['NOMATCH']), c[2:2]) ELSE list_concat(['NOMATCH'], c[1:2]) END AS results FROM cols LEFT JOIN tops ON tops.sheet = cols.sheet AND tops.col_no = cols.col_no)"""


def decided(spark, d):
    columns, _, _ = sheets(spark, d)
    return K.decide_columns(columns, K.expanded_features(candidates(spark, d)), simple_nomatch, simple_estimate)


@C.add(f"WITH {_DECIDED} SELECT sheet, col_no, header, array_to_string(results, ',') AS results FROM dec_")
def column_decisions(spark, d):
    """Three results or no match for every column, from its candidates' features."""
    return decided(spark, d).select("sheet", "col_no", "header", F.array_join("results", ",").alias("results"))


@C.add(f"""WITH {_DECIDED}, res AS (SELECT sheet, col_no, {{'sheet': sheet, 'col_no': col_no}} AS q, header, unnest(results) AS chosen, generate_subscripts(results, 1) AS no FROM dec_),
pair AS (SELECT DISTINCT value, id, enumerated, format, datatype FROM res JOIN vals USING (q) JOIN el ON chosen = CAST(id AS VARCHAR)),
eh AS (SELECT p.value, p.id, answer, NULL AS s, NULL AS code, score FROM pair p JOIN va ON va.q = p.value JOIN answer a ON a.id = p.id AND a.text = va.node WHERE enumerated UNION ALL SELECT p.value, p.id, answer, c.s, a.code, score FROM pair p JOIN vn ON vn.q = p.value AND label = 'Synonym' JOIN called c ON c.s = vn.node JOIN answer a ON a.id = p.id AND a.code = c.code WHERE enumerated),
ba AS (SELECT value, id, answer FROM (SELECT value, id, answer, row_number() OVER (PARTITION BY value, id ORDER BY max(score) DESC, answer) AS r FROM eh GROUP BY value, id, answer) WHERE r = 1),
hs_ AS (SELECT eh.value, eh.id, first(s ORDER BY score DESC, levenshtein(lower(eh.value), lower(s)) / greatest(length(eh.value), length(s)), s) AS s, any_value(code) AS code FROM eh JOIN ba ON ba.value = eh.value AND ba.id = eh.id AND ba.answer = eh.answer WHERE s IS NOT NULL GROUP BY ALL),
ns AS (SELECT ba.value, ba.id, first(c.s ORDER BY levenshtein(lower(ba.value), lower(c.s)) / greatest(length(ba.value), length(c.s)), c.s) AS s, any_value(c.code) AS code FROM ba JOIN answer a ON a.id = ba.id AND a.answer = ba.answer JOIN called c ON c.code = a.code GROUP BY ALL),
tx AS (SELECT ba.value, ba.id, min(text) AS s FROM ba JOIN answer a ON a.id = ba.id AND a.answer = ba.answer GROUP BY ALL),
cls AS (SELECT p.value, p.id, CASE WHEN enumerated THEN coalesce(hs_.s, ns.s, tx.s, 'NOMATCH') WHEN CASE WHEN format = 'YYYY' THEN regexp_full_match(p.value, '\\d{{4}}') WHEN format IS NOT NULL THEN true WHEN datatype = 'Integer' THEN regexp_full_match(p.value, '[+-]?\\d+') WHEN datatype = 'CHARACTER' THEN NOT regexp_full_match(p.value, '[0-9]*.{{0,1}}[0-9]*') WHEN datatype = 'NUMBER' THEN regexp_full_match(p.value, '\\d+(\\.\\d*)?') ELSE true END THEN 'CONFORMING' ELSE 'NONCONFORMING' END AS w,
  CASE WHEN hs_.s IS NOT NULL THEN hs_.code ELSE ns.code END AS code FROM pair p LEFT JOIN hs_ ON hs_.value = p.value AND hs_.id = p.id LEFT JOIN ns ON ns.value = p.value AND ns.id = p.id LEFT JOIN tx ON tx.value = p.value AND tx.id = p.id),
dom AS (SELECT res.sheet, res.col_no, no, string_agg(value || '=' || CASE WHEN chosen = 'NOMATCH' THEN 'NOMATCH' ELSE cls.w END || CASE WHEN cls.code IS NULL THEN '' ELSE '/ncit:' || cls.code END, ';' ORDER BY value) AS dom FROM res JOIN vals USING (q) LEFT JOIN cls USING (value) WHERE chosen = 'NOMATCH' AND cls.id IS NULL OR chosen = CAST(cls.id AS VARCHAR) GROUP BY ALL),
nodom AS (SELECT res.sheet, res.col_no, no, string_agg(value || '=NOMATCH', ';' ORDER BY value) AS dom FROM res JOIN vals USING (q) WHERE chosen = 'NOMATCH' GROUP BY ALL)
SELECT res.sheet, res.col_no, CAST(no AS INT) AS result_no, header, coalesce(long_name, 'NOMATCH') AS name, coalesce(n_name, 'NOMATCH') AS concept, coalesce((SELECT string_agg('ncit:' || code, ',' ORDER BY 'ncit:' || code) FROM (SELECT DISTINCT code FROM (FROM obj UNION FROM prop) o WHERE o.dec = el.dec)), '') AS codes, coalesce(CASE WHEN chosen = 'NOMATCH' THEN (SELECT dom FROM nodom x WHERE x.sheet = res.sheet AND x.col_no = res.col_no AND x.no = res.no) ELSE (SELECT dom FROM dom x WHERE x.sheet = res.sheet AND x.col_no = res.col_no AND x.no = res.no) END, '') AS domain
FROM res LEFT JOIN el ON chosen = CAST(id AS VARCHAR)""")
def sheet_results(spark, d):
    """Every sheet classified end to end, its nested results laid out in rows."""
    g, names, answers = prepared(spark, d)
    columns, cells, strings = sheets(spark, d)
    out = K.classify_sheets(columns, cells, g, names, answers, simple_nomatch, simple_estimate, strings)
    rows = out.select("sheet", F.explode("columns").alias("c")).select("sheet", F.col("c.columnNumber").alias("col_no"), F.col("c.headerValue").alias("header"), F.explode("c.results").alias("r"))
    value = F.transform("r.result.valueDomain", lambda v: F.concat(v["observedValue"], F.lit("="), v["permissibleValue"]["value"], F.when(v["permissibleValue"]["conceptCode"].isNull(), "").otherwise(F.concat(F.lit("/"), v["permissibleValue"]["conceptCode"]))))
    return rows.select("sheet", "col_no", F.col("r.resultNumber").alias("result_no"), "header", F.col("r.result.dataElement.name").alias("name"), F.col("r.result.dataElementConcept.name").alias("concept"), F.array_join("r.result.dataElementConcept.conceptCodes", ",").alias("codes"), F.array_join(value, ";").alias("domain"))


@C.add(f"""WITH {_GRAPH}, v AS (SELECT DISTINCT p_brand AS g, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || '.5' END AS value FROM part),
cls AS (SELECT g, id, avg(CASE WHEN format = 'YYYY' THEN 0 WHEN format IS NOT NULL THEN 1 WHEN datatype = 'Integer' THEN CAST(NOT contains(value, '.') AS INT) WHEN datatype = 'CHARACTER' THEN 0 ELSE 1 END) AS share FROM v JOIN el ON p_brand = g AND NOT enumerated GROUP BY ALL) SELECT g, id AS cde_id, round(share, 6) AS share FROM cls""")
def matched_values(spark, d):
    """The share of a brand's values that formats and types of its elements take."""
    _, elements = reference(spark, d)
    own = elements.where("VALUE_DOMAIN_TYPE = 'NonEnumerated'").select(F.col("CDE_ID").alias("target"), F.col("VALUE_DOMAIN_TYPE").alias("value_domain_type"), F.col("DATATYPE").alias("datatype"), F.col("DISPLAY_FORMAT").alias("display_format"))
    part = table(spark, d, "part")
    values = part.select(F.col("p_brand").alias("g"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat("p_size", F.lit(".5"))).alias("value")).distinct()
    pairs = values.join(part.select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("target")), "g").join(own.select("target"), "target", "left_semi")
    none = spark.createDataFrame([], "target long, answer long, synonym string, answer_text string, code string")
    hits = spark.createDataFrame([], "value string, target long, answer long, synonym string, code string, score double")
    classes = pairs.join(D.value_classes(pairs, own, none, hits), ["value", "target"])
    return D.matched_share(classes, ["g", "target"]).select("g", F.col("target").alias("cde_id"), rounded("share").alias("share"))


@C.add(f"""WITH RECURSIVE {_GRAPH}, {_SHEETS}, {_index('h1', _NAMES, 'SELECT q, t FROM cols')},
cnt AS (SELECT q, count(*) AS n, count(*) FILTER (label <> 'Synonym') AS m FROM h1 GROUP BY q), few AS (SELECT cols.q, cols.t FROM cols LEFT JOIN cnt ON cnt.q = cols.q WHERE coalesce(n, 0) < 25 OR coalesce(m, 0) < 5),
{segmentations_sql("SELECT DISTINCT lower(t) AS t FROM few", "SELECT DISTINCT w FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS w FROM part) WHERE w <> ''")},
strs AS (SELECT q, 0 AS no, CAST(1 AS DOUBLE) AS w, t FROM few UNION ALL SELECT q, rank, CAST(score AS DOUBLE), {_NORM.format('segments')} FROM few JOIN best ON best.t = lower(few.t)),
{_index('hs', _NAMES, "SELECT {'q': q, 'no': no, 'w': w} AS q, t FROM strs")}, h2 AS (SELECT q.q AS q, label, node, max(q.w * score) AS score FROM hs WHERE score > 0 GROUP BY ALL)
SELECT q.sheet AS sheet, q.col_no AS col_no, label, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM h2 GROUP BY ALL""")
def adaptive_words(spark, d):
    """The second search of columns whose headers find too little: the headers themselves, and their segmentations by words of part names, weighed by their scores."""
    from colweave.functions.text import header_to_search_string

    g, names, _ = prepared(spark, d)
    columns, _, _ = sheets(spark, d)
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    _, second = K.adaptive_search(columns.select(*K.COLUMN, header_to_search_string("header").alias("search")), names, words)
    return second.groupBy("query_id.sheet", "query_id.col_no", "label").agg(F.count("*").alias("n"), rounded(F.max("score")).alias("best"), rounded(F.sum("score"), 4).alias("total"))


@C.add(f"""WITH {_CAND}, {_EXP}, golden AS (SELECT sheet, col_no, min(cde_id) AS golden_id FROM cand WHERE col_no % 2 = 1 GROUP BY ALL), sets AS (SELECT id, list(DISTINCT code) AS codes FROM el JOIN (FROM obj UNION FROM prop) USING (dec) GROUP BY id),
m AS (SELECT ex.*, CAST(CASE WHEN cde_id = golden_id THEN 1.5 ELSE 0 END AS DOUBLE) AS metric1, CAST(coalesce(len(list_intersect(a.codes, b.codes)) / len(list_distinct(list_concat(a.codes, b.codes))), 0) AS DOUBLE) AS metric2 FROM ex LEFT JOIN golden USING (sheet, col_no) LEFT JOIN sets a ON a.id = cde_id LEFT JOIN sets b ON b.id = golden_id),
f AS (SELECT *, max(metric2) OVER w AS metric2_max, avg(CAST(metric2 > 0 AS INT)) OVER w AS pct_metric2_pos FROM m WINDOW w AS (PARTITION BY sheet, col_no))
SELECT sheet, col_no, cde_id, {', '.join(f'round({f}, 4) AS {f}' for f in M.VALUE_COLUMNS)}, round(metric1, 6) AS metric1, round(metric2, 6) AS metric2, round(metric2_max, 6) AS metric2_max, round(pct_metric2_pos, 6) AS pct_metric2_pos, round(CAST(CASE WHEN metric2_max = 0 THEN 0 ELSE metric2 / metric2_max END AS DOUBLE), 6) AS metric2_frac, CAST(metric1 > 1 AS INT) AS metric3, CAST(metric2 > 0 AS INT) AS metric4, CAST(CASE WHEN metric2_max = 0 THEN 0 ELSE metric2 / metric2_max END > 0.5 AS INT) AS metric5 FROM f""")
def training_set(spark, d):
    """Rows that the models learn from: expanded features of all candidates with target metrics, the least candidate of every other column being what is annotated; written to a file and read again."""
    g, names, answers = prepared(spark, d)
    columns, cells, strings = sheets(spark, d)
    rows = saved(K.candidate_features(columns, cells, g, names, answers, strings=strings))
    golden = rows.where("col_no % 2 = 1").groupBy(*K.COLUMN).agg(F.min("cde_id").alias("cde_id"))
    folder = f"{shared_folder(spark)}/training/{uuid.uuid4().hex}"
    write_training(K.training_rows(K.expanded_features(rows), golden, g), folder)
    at_end(lambda: delete(spark, folder))
    return spark.read.parquet(folder).select("sheet", "col_no", "cde_id", *(rounded(f, 4).alias(f) for f in M.VALUE_COLUMNS), *(rounded(f"metric{m}").alias(f"metric{m}") for m in ("1", "2", "2_max", "2_frac")), rounded("pct_metric2_pos").alias("pct_metric2_pos"), "metric3", "metric4", "metric5")


def written_sheets(spark, d):
    """Parts as sheets in files, one for each brand, half of them with tabs: names are quoted, two to a field with a line end between, a heading stands twice and one is empty; brands differ in width."""
    part, lit, c = table(spark, d, "part"), F.lit, F.col
    tabs = F.substring("p_brand", -1, 1).isin("1", "3")
    wide = F.substring("p_brand", -2, 1) == "2"
    sep = F.when(tabs, "\t").otherwise(",")
    more = lambda a, b: F.when(wide, F.concat(a, sep, b)).otherwise(lit(""))
    head = F.concat(lit("partKey"), sep, lit("p_name"), sep, lit('"size"""'), sep, lit("p_name"), more(lit(""), lit("")), more(lit(""), lit("price")))
    body = F.concat("p_partkey", sep, lit('"'), "p_name", lit("\n"), "p_type", lit('"'), sep, F.when(c("p_size") % 4 == 0, "NA").otherwise(c("p_size").cast("string")), sep, F.when(c("p_size") % 3 == 0, F.concat(lit('"'), "p_type", lit(',\t"""'))).otherwise(c("p_type")), more(lit(""), lit("")), more(lit(""), F.format_string("%.2f", "p_retailprice")))
    rows = part.select("p_brand", sep.alias("sep"), F.explode(F.array(F.struct(lit(0).alias("part"), lit(0).alias("no"), head.alias("value")), F.struct(lit(1).alias("part"), c("p_partkey").alias("no"), body.alias("value")))).alias("r")).select("p_brand", tabs.alias("tabs"), "r.*").distinct()
    rows = rows.withColumn("name", F.concat("p_brand", F.when(c("tabs"), ".tsv").otherwise(".csv"))).repartition("name").sortWithinPartitions("name", "part", "no").select("name", "value")  # the head first, whatever the keys
    folder = f"{shared_folder(spark)}/sheets/{uuid.uuid4().hex}"
    rows.write.partitionBy("name").text(folder)
    at_end(lambda: delete(spark, folder))
    return folder


@C.add("""WITH p AS (SELECT *, right(p_brand, 1) IN ('1', '3') AS tabs, substr(p_brand, -2, 1) = '2' AS wide FROM part),
v AS (SELECT p_brand, tabs, unnest([{'no': 1, 'h': 'partKey', 'v': CAST(p_partkey AS VARCHAR)}, {'no': 2, 'h': 'p_name', 'v': p_name || chr(10) || p_type}, {'no': 3, 'h': 'size"', 'v': CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS VARCHAR) END}, {'no': 4, 'h': 'p_name.1', 'v': p_type || CASE WHEN p_size % 3 = 0 THEN ',' || chr(9) || '"' ELSE '' END},
  {'no': 5, 'h': CASE WHEN wide THEN 'Unnamed: 4' END, 'v': NULL}, {'no': 6, 'h': CASE WHEN wide THEN 'price' END, 'v': printf('%.2f', p_retailprice)}]) AS x FROM p)
SELECT p_brand || CASE WHEN tabs THEN '.tsv' ELSE '.csv' END AS sheet, CAST(x.no AS INTEGER) AS col_no, x.h AS header, count(x.v) AS n_values, count(DISTINCT x.v) AS n_distinct, md5(coalesce(string_agg(x.v, '|' ORDER BY x.v), '')) AS digest FROM v WHERE x.h IS NOT NULL GROUP BY ALL""")
def folder_sheets(spark, d):
    """All sheets of a folder in one scan: their columns, and counts and digests of their cells."""
    sheet = F.url_decode(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "/name=([^/]+)/", 1)))  # a folder's name in a path
    columns, cells = read_sheets(spark, written_sheets(spark, d), sheet)
    own = cells.where("value IS NOT NULL").groupBy("sheet", "col_no").agg(F.count("*").alias("n_values"), F.count_distinct("value").alias("n_distinct"), F.md5(F.array_join(F.array_sort(F.collect_list("value")), "|").cast("binary")).alias("digest"))
    out = columns.join(own, ["sheet", "col_no"], "left").na.fill(0, ["n_values", "n_distinct"])
    return out.withColumn("digest", F.coalesce("digest", F.md5(F.lit("").cast("binary"))))


QUERIES, ORACLES = C.queries, C.oracles
