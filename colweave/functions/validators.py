"""Value-domain validators: data types and display formats as Column expressions, from rules in tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colweave.functions.text import col

NUMBER = r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*"
NUMBER_OR_NAMED = rf"({NUMBER}|\s*[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*)"
# Data types with a rule; every other type accepts anything.
TEXT_TYPES = ("CHARACTER", "varchar")
INTEGER_TYPES = ("Integer", "HL7INTv3")
NUMBER_TYPES = ("NUMBER", "HL7REALv3")
FREE_TYPES = (
    "DATETIME", "SAS Date", "SAS Time", "DATE", "ALPHANUMERIC", "TIME", "HL7EDv3", "BOOLEAN", "Numeric Alpha DVG", "Date Alpha DVG", "Derived", "UMLUidv1.0", "DATE/TIME", "HL7STv3",
    "CLOB", "HL7CDv3", "HL7TSv3", "HL7PNv3", "HL7TELv3", "OBJECT", "Alpha DVG", "xsd:string", "xsd:boolean", "UMLUriv1.0", "UMLOctetv1.0", "UMLCodev1.0", "UMLXMLv1.0", "xsd:dateTime",
)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# Display formats and what fits them.
#: Format: (pattern, {part: the number of its group}). Parts are checked as month, day, hour, minute or second.
DATE, CLOCK = r"(\d{1,2})/(\d{1,2})/", r"(\d{1,2}):(\d{2})"
FORMATS: dict[str, tuple[str, dict[str, int]]] = {
    "mm/dd/yy": (DATE + r"\d{2}", {"m": 1, "d": 2}),
    "mm/dd/yyyy": (DATE + r"\d{4}", {"m": 1, "d": 2}),
    "MM/DD/YYYY": (DATE + r"\d{4}", {"m": 1, "d": 2}),
    "DD/MON/YYYY": (r"(\d{1,2})/([A-Z,a-z]{3})/\d{4}", {"d": 1, "mon": 2}),
    "YYYY-MM-DD": (r"\d{4}-(\d{1,2})-(\d{1,2})", {"m": 1, "d": 2}),
    "YYYY": (r"\d{4}", {}),
    "TIME (HR(24):MN": (CLOCK, {"h": 1, "min": 2}),  # the catalogue spells it with a last parenthesis, which accepts anything
    "YYYYMMDD": (r"\d{4}(\d{2})(\d{2})", {"m": 1, "d": 2}),
    "hh:mm:ss": (CLOCK + r":(\d{2})", {"h": 1, "min": 2, "sec": 3}),
    "hh:mm:ss:rr": (CLOCK + r":(\d{2}):\d{1,2}", {"h": 1, "min": 2, "sec": 3}),
    "hh:mm": (CLOCK, {"h": 1, "min": 2}),
    "TIME_HH:MM": (CLOCK, {"h": 1, "min": 2}),
    "MMYYYY": (r"(\d{2})\d{4}", {"m": 1}),
    "MMDDYYYY": (r"(\d{2})(\d{2})\d{2}", {"m": 1, "d": 2}),  # 6 digits, not 8
    "YYYYMM": (r"\d{4}(\d{2})", {"m": 1}),
    "999-99-9999": (r"\d{3}-\d{2}-\d{4}", {}),
    "9999999": (r"\d{1,7}", {}),
    "10,3": (r"\d{1,10}\.\d{0,3}|\d{1,10}", {}),
    "%": (r"\d*.{0,1}\d*%|\d*.{0,1}\d*", {}),
    "9999.99": (r"\d{1,4}\.\d{0,2}|\d{1,4}", {}),
    "9999.9": (r"\d{1,4}\.\d{0,1}|\d{1,4}", {}),
    "999.9": (r"\d{1,3}\.\d{0,1}|\d{1,3}", {}),
    "99.9": (r"\d{1,2}\.\d{0,1}|\d{1,2}", {}),
    "999.99": (r"\d{1,3}\.\d{0,2}|\d{1,3}", {}),
    "9.999": (r"\d{0,1}\.\d{0,3}|\d{1,1}", {}),
    "999999.9": (r"\d{0,6}\.\d{0,1}|\d{1,6}", {}),
    "99.99": (r"\d{0,2}\.\d{0,2}|\d{1,2}", {}),
    "9999.999": (r"\d{0,4}\.\d{0,3}|\d{1,4}", {}),
    "99999.99": (r"\d{0,5}\.\d{0,2}|\d{1,5}", {}),
}


#: Names that a catalogue lists: only for these has an element a share of conforming values.
LISTED_TYPES = (*FREE_TYPES, *TEXT_TYPES, "UMLBinaryv1.0", *INTEGER_TYPES, *NUMBER_TYPES, "binary")
LISTED_FORMATS = (*(f for f in FORMATS if f != "TIME (HR(24):MN"), "TIME (HR(24):MN)", "TIME_MIN")


def full_match(c, pattern: str) -> Column:
    return col(c).rlike(rf"\A(?:{pattern})\z")


def valid_day(month: Column, day: Column) -> Column:
    """Without the year: February has 29 days."""
    last = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= last)


def valid_hour(hour: Column, hours: int = 24) -> Column:
    return hour.between(0, hours)


def valid_minute(x: Column) -> Column:
    return x.between(0, 59)


def check_datatype(value, datatype) -> Column:
    """Whether a text value has a data type; a null type and types without a rule accept anything."""
    v, t = col(value), col(datatype)
    number = F.when(full_match(v, NUMBER), F.trim(v).try_cast("double"))
    return F.coalesce(
        F.when(t.isin(*TEXT_TYPES), ~full_match(v, "[0-9]*.{0,1}[0-9]*"))
        .when(t == "UMLBinaryv1.0", full_match(v, "[0-1]*"))
        .when(t.isin(*INTEGER_TYPES), F.coalesce(number == F.floor(number), F.lit(False)))
        .when(t.isin(*NUMBER_TYPES), full_match(v, NUMBER_OR_NAMED))
        .when(t == "binary", F.coalesce((number > -1) & (number < 2), F.lit(False))),
        F.lit(True),
    )


def format_rule(value: Column, pattern: str, parts: dict[str, int]) -> Column:
    whole = rf"\A(?:{pattern})\z"
    get = lambda p: F.regexp_extract(value, whole, parts[p]).try_cast("int")
    ok = value.rlike(whole)
    if "mon" in parts:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(value, whole, parts["mon"]))).cast("int")
        ok &= valid_day(month, get("d"))
    elif "m" in parts:
        ok &= valid_day(get("m"), get("d") if "d" in parts else F.lit(1))
    if "h" in parts:
        ok &= valid_hour(get("h")) & valid_minute(get("min"))
    if "sec" in parts:
        ok &= valid_minute(get("sec"))
    return F.coalesce(ok, F.lit(False))


def check_display_format(value, display_format) -> Column:
    """Whether a text value has a display format; a null format and unknown ones accept anything."""
    v, f = col(value), col(display_format)
    rule = F.when(F.lit(False), F.lit(True))
    for name, (pattern, parts) in FORMATS.items():
        rule = rule.when(f == name, format_rule(v, pattern, parts))
    return F.coalesce(rule, F.lit(True))


def conforms(value, datatype, display_format) -> Column:
    """By the display format if there is one, else by the data type."""
    return F.when(col(display_format).isNotNull(), check_display_format(value, display_format)).otherwise(check_datatype(value, datatype))


def conformity(ok: Column) -> Column:
    return F.when(ok, "CONFORMING").otherwise("NONCONFORMING")


def permissible(ok: Column) -> Column:
    """What a value of a domain without listed answers is permitted as."""
    return F.struct(conformity(ok).alias("value"), F.lit(None).cast("string").alias("conceptCode"))


def listed(datatype, display_format) -> Column:
    """Whether an element without listed answers takes part in the share of conforming values: its format is a listed one, or it has none and its type is."""
    return F.when(col(display_format).isNotNull(), col(display_format).isin(*LISTED_FORMATS)).otherwise(F.coalesce(col(datatype).isin(*LISTED_TYPES), F.lit(False)))


def looks_enumerated(n_distinct, n_rows) -> Column:
    return col(n_distinct) < F.sqrt(col(n_rows))
