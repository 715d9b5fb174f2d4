"""Validators on values of the tables written in each style."""

from pyspark.sql import functions as F

from colweave.functions import validators as V
from colweave.functions.text import normalised_levenshtein
from colweave.operators import decide as D
from colweave.plans.base import Catalogue, rounded, table

C = Catalogue()

_NUM = r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*"
_NAMED = rf"({_NUM}|\s*[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*)"
_TYPED = f"""CASE WHEN t IN ('CHARACTER', 'varchar') THEN NOT regexp_full_match(v, '[0-9]*.{{0,1}}[0-9]*') WHEN t = 'UMLBinaryv1.0' THEN regexp_full_match(v, '[0-1]*')
WHEN t IN ('Integer', 'HL7INTv3') THEN regexp_full_match(v, '{_NUM}') AND coalesce(try_cast(trim(v) AS DOUBLE) = floor(try_cast(trim(v) AS DOUBLE)), false)
WHEN t IN ('NUMBER', 'HL7REALv3') THEN regexp_full_match(v, '{_NAMED}') WHEN t = 'binary' THEN regexp_full_match(v, '{_NUM}') AND coalesce(try_cast(trim(v) AS DOUBLE) > -1 AND try_cast(trim(v) AS DOUBLE) < 2, false) ELSE true END"""
TYPES = ("CHARACTER", "UMLBinaryv1.0", "Integer", "NUMBER", "binary", "DATE")
_CELLS = "SELECT p_partkey AS k, unnest([p_name, p_brand, CAST(p_size AS VARCHAR), p_size || '.0', p_size || 'e1', ' ' || (p_size % 3) || ' ', '1.' || p_size || 'x', 'nan', '.5', '-0.5', '1d', '0110', 'a', '']) AS v FROM part"


def cells(spark, d):
    size = F.col("p_size").cast("string")
    texts = ["p_name", "p_brand", size, F.concat(size, F.lit(".0")), F.concat(size, F.lit("e1")), F.concat(F.lit(" "), (F.col("p_size") % 3).cast("string"), F.lit(" ")), F.concat(F.lit("1."), size, F.lit("x"))]
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.explode(F.array(*texts, *map(F.lit, ("nan", ".5", "-0.5", "1d", "0110", "a", "")))).alias("v"))


@C.add(f"WITH c AS ({_CELLS}) SELECT k, v, t, {_TYPED} AS ok FROM c, (SELECT unnest([{', '.join(repr(t) for t in TYPES)}]) AS t)")
def check_datatype(spark, d):
    return cells(spark, d).withColumn("t", F.explode(F.array(*map(F.lit, TYPES)))).select("k", "v", "t", V.check_datatype("v", "t").alias("ok"))


_STYLES = """SELECT o_orderkey AS k, unnest([mm || '/' || dd || '/' || yyyy, CAST(month(x) AS VARCHAR) || '/' || day(x) || '/' || substr(yyyy, 3), dd || '/' || substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', 3 * month(x) - 2, 3) || '/' || yyyy, yyyy || '-' || mm || '-' || dd, yyyy || mm || dd, mm || yyyy, mm || dd || substr(yyyy, 3), yyyy,
dd || ':' || mm, dd || ':' || mm || ':' || dd, mm || dd || '.' || mm, '.' || dd, dd || '%', '123-45-' || yyyy, '13/01/' || yyyy, '2/30/' || yyyy, '25:00', 'Foo']) AS v
FROM (SELECT o_orderkey, o_orderdate AS x, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS mm, lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') AS dd, CAST(year(o_orderdate) AS VARCHAR) AS yyyy FROM orders)"""


def styles(spark, d):
    x = F.col("o_orderdate")
    mm, dd, yyyy = F.lpad(F.month(x).cast("string"), 2, "0"), F.lpad(F.day(x).cast("string"), 2, "0"), F.year(x).cast("string")
    yy, mon, lit = F.substring(yyyy, 3, 2), F.substr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), 3 * F.month(x) - 2, F.lit(3)), F.lit
    out = [F.concat(mm, lit("/"), dd, lit("/"), yyyy), F.concat(F.month(x).cast("string"), lit("/"), F.day(x).cast("string"), lit("/"), yy), F.concat(dd, lit("/"), mon, lit("/"), yyyy), F.concat(yyyy, lit("-"), mm, lit("-"), dd), F.concat(yyyy, mm, dd), F.concat(mm, yyyy), F.concat(mm, dd, yy), yyyy]
    out += [F.concat(dd, lit(":"), mm), F.concat(dd, lit(":"), mm, lit(":"), dd), F.concat(mm, dd, lit("."), mm), F.concat(lit("."), dd), F.concat(dd, lit("%")), F.concat(lit("123-45-"), yyyy), F.concat(lit("13/01/"), yyyy), F.concat(lit("2/30/"), yyyy), lit("25:00"), lit("Foo")]
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.array(*out)).alias("v"))


def _int(x: str) -> str:
    return f"coalesce(try_cast({x} AS INT), -1)"


def _day(m: str, d: str) -> str:
    return f"({_int(m)} BETWEEN 1 AND 12 AND {_int(d)} BETWEEN 1 AND [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][{_int(m)}])"


def _clock(*parts: int) -> str:
    return " AND ".join(f"{_int(f'split_part(v, chr(58), {p})')} BETWEEN 0 AND {24 if p == 1 else 59}" for p in parts)


def _decimals(least: int, most: int, places: int) -> str:
    return rf"regexp_full_match(v, '\d{{{least},{most}}}[.]\d{{0,{places}}}') OR regexp_full_match(v, '\d{{1,{most}}}')"


_SLASHES = _day("split_part(v, '/', 1)", "split_part(v, '/', 2)")
# What fits a display format, in SQL of its own.
_RULES = {
    "mm/dd/yy": rf"regexp_full_match(v, '\d\d?/\d\d?/\d\d') AND {_SLASHES}",
    "mm/dd/yyyy": rf"regexp_full_match(v, '\d\d?/\d\d?/\d{{4}}') AND {_SLASHES}",
    "MM/DD/YYYY": rf"regexp_full_match(v, '\d\d?/\d\d?/\d{{4}}') AND {_SLASHES}",
    "DD/MON/YYYY": r"regexp_full_match(v, '\d\d?/[A-Z,a-z]{3}/\d{4}') AND strpos('jan feb mar apr may jun jul aug sep oct nov dec', lower(split_part(v, '/', 2))) % 4 = 1 AND " + _day("CAST((strpos('jan feb mar apr may jun jul aug sep oct nov dec', lower(split_part(v, '/', 2))) + 3) // 4 AS VARCHAR)", "split_part(v, '/', 1)"),
    "YYYY-MM-DD": r"regexp_full_match(v, '\d{4}-\d\d?-\d\d?') AND " + _day("split_part(v, '-', 2)", "split_part(v, '-', 3)"),
    "YYYY": r"regexp_full_match(v, '\d{4}')",
    "TIME (HR(24):MN": rf"regexp_full_match(v, '\d\d?:\d\d') AND {_clock(1, 2)}",
    "YYYYMMDD": r"regexp_full_match(v, '\d{8}') AND " + _day("substr(v, 5, 2)", "substr(v, 7, 2)"),
    "hh:mm:ss": rf"regexp_full_match(v, '\d\d?:\d\d:\d\d') AND {_clock(1, 2, 3)}",
    "hh:mm:ss:rr": rf"regexp_full_match(v, '\d\d?:\d\d:\d\d:\d\d?') AND {_clock(1, 2, 3)}",
    "hh:mm": rf"regexp_full_match(v, '\d\d?:\d\d') AND {_clock(1, 2)}",
    "TIME_HH:MM": rf"regexp_full_match(v, '\d\d?:\d\d') AND {_clock(1, 2)}",
    "MMYYYY": r"regexp_full_match(v, '\d{6}') AND " + _day("substr(v, 1, 2)", "'1'"),
    "MMDDYYYY": r"regexp_full_match(v, '\d{6}') AND " + _day("substr(v, 1, 2)", "substr(v, 3, 2)"),
    "YYYYMM": r"regexp_full_match(v, '\d{6}') AND " + _day("substr(v, 5, 2)", "'1'"),
    "999-99-9999": r"regexp_full_match(v, '\d{3}-\d{2}-\d{4}')",
    "9999999": r"regexp_full_match(v, '\d{1,7}')",
    "10,3": _decimals(1, 10, 3),
    "%": r"regexp_full_match(v, '\d*.?\d*%?')",
    "9999.99": _decimals(1, 4, 2),
    "9999.9": _decimals(1, 4, 1),
    "999.9": _decimals(1, 3, 1),
    "99.9": _decimals(1, 2, 1),
    "999.99": _decimals(1, 3, 2),
    "9.999": _decimals(0, 1, 3),
    "999999.9": _decimals(0, 6, 1),
    "99.99": _decimals(0, 2, 2),
    "9999.999": _decimals(0, 4, 3),
    "99999.99": _decimals(0, 5, 2),
}
_FORMATTED = "CASE " + " ".join(f"WHEN f = '{name}' THEN coalesce({rule}, false)" for name, rule in _RULES.items()) + " ELSE true END"
NAMES = [*V.FORMATS, "TIME (HR(24):MN)", "TIME_MIN", "unknown"]
_NAMES = f"(SELECT unnest([{', '.join(repr(n) for n in NAMES)}]) AS f)"


def formatted(spark, d):
    return styles(spark, d).withColumn("f", F.explode(F.array(*map(F.lit, NAMES)))).withColumn("ok", V.check_display_format("v", "f"))


@C.add(f"WITH c AS (SELECT DISTINCT v FROM ({_STYLES})) SELECT v, f, {_FORMATTED} AS ok FROM c, {_NAMES}")
def check_display_format(spark, d):
    return styles(spark, d).select("v").distinct().withColumn("f", F.explode(F.array(*map(F.lit, NAMES)))).select("v", "f", V.check_display_format("v", "f").alias("ok"))


@C.add(f"WITH c AS (SELECT DISTINCT v FROM ({_STYLES})) SELECT f, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS share, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS conforming FROM (SELECT f, {_FORMATTED} AS ok FROM c, {_NAMES}) GROUP BY f")
def conforming_ratio(spark, d):
    out = check_display_format(spark, d)
    return out.groupBy("f").agg(F.count("*").alias("n"), rounded(F.avg(F.col("ok").cast("int"))).alias("share"), F.count_if(V.conformity(F.col("ok")) == "CONFORMING").alias("conforming"))


@C.add("""WITH pairs AS (SELECT DISTINCT a.p_name AS value, b.p_type AS target FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size), p AS (SELECT DISTINCT p_type AS target, p_brand AS answer, p_name AS synonym FROM part),
h AS (SELECT value, target, answer, synonym, length(synonym) / 100.0 + CASE WHEN value = synonym THEN 1 ELSE 0 END AS score, levenshtein(value, synonym) / greatest(length(value), length(synonym)) AS lev FROM pairs JOIN p USING (target) WHERE split_part(value, ' ', 1) = split_part(synonym, ' ', 1)),
a AS (SELECT *, row_number() OVER (PARTITION BY target, value ORDER BY s DESC, answer) AS r FROM (SELECT target, value, answer, max(score) AS s FROM h GROUP BY ALL)),
b AS (SELECT h.*, row_number() OVER (PARTITION BY h.target, h.value ORDER BY score DESC, lev, synonym) AS r FROM h JOIN a ON a.r = 1 AND a.target = h.target AND a.value = h.value AND a.answer = h.answer)
SELECT pairs.target, pairs.value, coalesce(b.synonym, 'NOMATCH') AS permissible FROM pairs LEFT JOIN b ON b.r = 1 AND b.target = pairs.target AND b.value = pairs.value""")
def enum_value_classify(spark, d):
    """Names of parts against the answers of types that occur with their brand and size."""
    part = table(spark, d, "part")
    pairs = part.select("p_brand", "p_size", F.col("p_name").alias("value")).distinct().join(part.select("p_brand", "p_size", F.col("p_type").alias("target")).distinct(), ["p_brand", "p_size"]).select("value", "target").distinct()
    permitted = part.select(F.col("p_type").alias("target"), F.col("p_brand").alias("answer"), F.col("p_name").alias("synonym"), F.lit(None).cast("string").alias("answer_text"), F.lit(None).cast("string").alias("code")).distinct()
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    hits = pairs.join(permitted, (pairs["target"] == permitted["target"]) & (word("value") == word("synonym"))).select("value", permitted["target"], "answer", "synonym", "code").withColumn("score", F.length("synonym") / 100 + F.when(F.col("value") == F.col("synonym"), 1.0).otherwise(0.0))
    return D.classify_values(pairs, permitted, hits).select("target", "value", "permissible")


@C.add("SELECT o_orderkey, h BETWEEN 0 AND 24 AS hour_24, h BETWEEN 0 AND 12 AS hour_12, CAST(h AS VARCHAR) || ':' || lpad(CAST(m AS VARCHAR), 2, '0') AS clock, h <= 24 AND m <= 59 AS conforming FROM (SELECT o_orderkey, o_orderkey % 27 AS h, o_orderkey % 63 AS m FROM orders)")
def clock_times(spark, d):
    """Hours of both clocks, and times by a display format."""
    h, m = F.col("o_orderkey") % 27, F.col("o_orderkey") % 63
    rows = table(spark, d, "orders").select("o_orderkey", h.alias("h"), F.concat_ws(":", h.cast("string"), F.lpad(m.cast("string"), 2, "0")).alias("clock"))
    return rows.select("o_orderkey", V.valid_hour(F.col("h")).alias("hour_24"), V.valid_hour(F.col("h"), 12).alias("hour_12"), "clock", V.check_display_format("clock", F.lit("hh:mm")).alias("conforming"))


QUERIES, ORACLES = C.queries, C.oracles
