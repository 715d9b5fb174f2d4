"""String and scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_field(c, to_lower: bool = False) -> Column:
    """Text with NaN as null, lower-cased on demand. Escapes that only a query language needs are not added."""
    text = F.when(F.lower(col(c).cast("string")) != "nan", col(c).cast("string"))
    return F.lower(text) if to_lower else text


def split_case_and_digits(c) -> Column:
    """aB -> a B, then 1a -> 1 a; the second class holds a comma, so 1,2 -> 1 ,2. Acronyms stay whole."""
    return F.regexp_replace(F.regexp_replace(col(c), "([a-z])([A-Z])", "$1 $2"), "([0-9])([A-Z,a-z])", "$1 $2")


def separators_to_spaces(c) -> Column:
    return F.translate(col(c), "_.", "  ")


def clean_for_search(c) -> Column:
    return F.lower(F.translate(col(c).cast("string"), "/,+-()[]", " " * 8))


def header_to_search_string(c) -> Column:
    """Underscores and periods to spaces, case and digits split, signs to spaces, lower case, in this order."""
    return clean_for_search(split_case_and_digits(separators_to_spaces(c)))


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"({TOKEN})"), 1)


def parse_concepts(c) -> Column:
    """type:code|type:code as an array of structs."""
    return F.transform(F.filter(F.split(col(c), r"\|"), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("type"), F.split_part(x, F.lit(":"), F.lit(2)).alias("code")))


def parse_pipes(c) -> Column:
    return F.filter(F.split(col(c), r"\|"), lambda x: x != "")


def parse_answers(c) -> Column:
    """Entries by |, their parts by backslash, without empty or repeated parts; sorted, where a set's order was left to chance."""
    return F.transform(F.split(col(c), r"\|"), lambda e: F.array_sort(F.array_distinct(F.filter(F.split(e, r"\\"), lambda x: x != ""))))


def parse_classifications(c) -> Column:
    r"""TYPE - VALUE\CONTEXT items as structs; the context is what follows the first backslash."""
    item = lambda x: F.struct(F.split_part(x, F.lit(" - "), F.lit(1)).alias("type"), F.regexp_extract(x, r"^.*? - ([^\\]*)", 1).alias("value"), F.regexp_extract(x, r"\\(.*)$", 1).alias("context"))
    return F.transform(F.filter(F.split(col(c), r"\|"), lambda x: x != ""), item)


def concept_codes(c) -> Column:
    """Codes behind `ncit:` in a text."""
    return F.regexp_extract_all(col(c), F.lit(r"ncit:(\S+)"), 1)


def jaccard(a, b) -> Column:
    """Of two arrays as sets: 1 if both are empty, else the share of what they have in common."""
    a, b = F.array_distinct(col(a)), F.array_distinct(col(b))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(both / F.size(F.array_union(a, b)))


def normalised_levenshtein(a, b) -> Column:
    a, b = F.lower(col(a)), F.lower(col(b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def count_closeness(actual, expected) -> Column:
    """1 for equal counts, 0 if none are expected."""
    a, e = col(actual), col(expected)
    return F.when(e == 0, 0.0).otherwise(1 - F.abs(a - e) / (a + e))


def shortest_word(c) -> Column:
    return F.greatest(F.floor(F.sqrt(F.length(col(c)) / 2)), F.lit(3))


def segmentation_score(segments, words, text) -> Column:
    """How much of the text its words cover, less for many segments."""
    n = F.length(col(text))
    spaces = F.length(col(segments)) - F.length(F.replace(col(segments), F.lit(" "), F.lit("")))
    return F.length(F.replace(col(words), F.lit(" "), F.lit(""))) / n * (1 - (spaces + 1) / n)


def exp_target(y) -> Column:
    return (F.pow(F.lit(50.0), col(y)) - 1) / 49


def log_target(y) -> Column:
    return F.log(1 + 49 * col(y)) / F.log(F.lit(50.0))


def tan_target(y) -> Column:
    return F.tan(col(y))


def observed(c) -> Column:
    return col(c).cast("string")


def concept_reference(code) -> Column:
    return F.concat(F.lit("ncit:"), col(code))
