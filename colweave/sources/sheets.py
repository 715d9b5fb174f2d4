"""All sheets of a folder in one scan: lines, records, headers and cells as tables, whatever the number, width and size of the sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colweave.sources.files import MISSING, SEPARATORS
from colweave.storage import saved

#: Sheets by their extension, in whatever case.
SHEETS = "*.[cCtT][sS][vV]"
#: What follows an opening quote up to the closing one; two quotes are one of the text.
QUOTED = '[^"]*(?:""[^"]*)*+"'


def by_separator(sheet: Column, f) -> Column:
    """f of the separator that a sheet's extension stands for."""
    out = None
    for extension, separator in SEPARATORS.items():
        own = f(separator)
        out = own if out is None else F.when(F.lower(F.substring(sheet, -4, 4)) == extension, own).otherwise(out)
    return out


def left_open(line: Column, separator: str, inside: bool) -> Column:
    """Whether a quoted field is open at the end of a line, if one is, or none, at its start. A quote opens a field only as its first character."""
    rest = F.regexp_replace(line, f"^{QUOTED}", "") if inside else F.concat(F.lit(separator), line)
    after = F.contains(F.regexp_replace(rest, f"{separator}\"{QUOTED}", separator + "_"), F.lit(separator + '"'))
    return F.when(line.rlike(f"^{QUOTED}"), after).otherwise(True) if inside else after


def open_before(df: DataFrame, within: list[str], order: str, start: Column, name: str) -> DataFrame:
    """df with a column: is a field open before the row? A row closes it, opens it, leaves it (`from_shut` = false, `from_open` = true) or turns it.

    What the last row before that sets whatever went before, turned as often as rows since then turn it; `start`, if there is none. So states follow from two running values
    and need no row after row.
    """
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.col("from_shut") == F.col("from_open"), (F.col("from_shut") & ~F.col("from_open")).cast("int")
    turned = df.withColumn("__turns", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    last = F.last(F.when(sets, F.struct(F.col("from_shut").alias("s"), F.col("__turns").alias("t"))), True).over(before)
    odd = lambda c: c % 2 == 1
    out = turned.withColumn("__last", last).withColumn(name, F.when(F.col("__last").isNull(), start != odd(F.col("__turns"))).otherwise(F.col("__last.s") != odd(F.col("__turns") - F.col("__last.t"))))
    return out.drop("__turns", "__last")


def joined_lines(lines: DataFrame) -> DataFrame:
    """Records (sheet, at, record) from lines (sheet, block, i, line): a line that ends within quotes goes on in the next one, also across blocks of a file.

    Blocks are what tasks read of a file; their lines are looked at block by block, and blocks, a row each, sheet by sheet. Only lines of records of several lines are gathered, a record in a group.
    """
    kinds = lines.withColumns({"from_shut": by_separator(F.col("sheet"), lambda s: left_open(F.col("line"), s, False)), "from_open": by_separator(F.col("sheet"), lambda s: left_open(F.col("line"), s, True))})
    here = open_before(kinds, ["sheet", "block"], "i", F.lit(False), "if_shut")
    here = saved(open_before(here, ["sheet", "block"], "i", F.lit(True), "if_open"))
    ends = lambda state: F.when(F.col(state), F.col("from_open")).otherwise(F.col("from_shut"))
    last = lambda c: F.max_by(c, F.struct("i"))
    at = F.struct("block", "i")
    blocks = here.groupBy("sheet", "block").agg(last(ends("if_shut")).alias("from_shut"), last(ends("if_open")).alias("from_open"), F.max(F.when(~F.col("if_shut"), at)).alias("start_if_shut"), F.max(F.when(~F.col("if_open"), at)).alias("start_if_open"))
    blocks = open_before(blocks, ["sheet"], "block", F.lit(False), "opened")
    own = F.when(F.col("opened"), F.col("start_if_open")).otherwise(F.col("start_if_shut"))
    former = Window.partitionBy("sheet").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("former", F.last(own, True).over(former)).select("sheet", "block", "opened", "former")
    inside = F.when(F.col("opened"), F.col("if_open")).otherwise(F.col("if_shut"))
    placed = here.join(blocks, ["sheet", "block"]).withColumn("inside", inside).withColumn("goes_on", F.when(F.col("inside"), F.col("from_open")).otherwise(F.col("from_shut")))
    whole = placed.where(~F.col("inside") & ~F.col("goes_on")).select("sheet", at.alias("at"), F.col("line").alias("record"))
    upto = Window.partitionBy("sheet", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    begun = placed.withColumn("at", F.coalesce(F.last(F.when(~F.col("inside"), at), True).over(upto), "former")).where(F.col("inside") | F.col("goes_on"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "i", "line"))), lambda x: x["line"])
    return whole.unionByName(begun.groupBy("sheet", "at").agg(F.array_join(parts, "\n").alias("record")))


def fields(record: Column, separator: str) -> Column:
    """A record's fields; quotes around a field go, two quotes in it are one."""
    cut = F.regexp_extract_all(F.concat(F.lit(separator), record), F.lit(f"{separator}((?:\"{QUOTED})?[^{separator}]*)"), F.lit(1))
    plain = lambda f: F.concat(F.replace(F.regexp_extract(f, f'^"({QUOTED[:-1]})"', 1), F.lit('""'), F.lit('"')), F.regexp_replace(f, f'^"{QUOTED}', ""))
    unquoted = F.transform(cut, lambda f: F.when(F.startswith(f, F.lit('"')) & f.rlike(f'^"{QUOTED}'), plain(f)).otherwise(f))
    return F.when(F.contains(record, F.lit('"')), unquoted).otherwise(F.split(record, separator))


def read_sheets(spark: SparkSession, folder: str, sheet: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sheet, col_no, header) of the columns of all .csv and .tsv files of a folder, and (sheet, col_no, value) of their cells.

    sheet: its name, the file's unless given as an expression over `_metadata`; folders below are read if it is given. One scan of lines, whatever the number of files, and a large file is
    read by many tasks; lines are stored once, with the block of the file and the place that they were read from, as headers and cells are told apart by it. Fields may be
    quoted and then hold separators, line ends and doubled quotes; of a sheet without any quote nothing is shuffled but its header. The first record that isn't blank is the header;
    blank records are passed over. Headers that stand again get .1, .2 and so on, empty ones `Unnamed: ` and their place from 0. Cells stay text, missing ones are null;
    what a short record lacks has no cells, and what goes beyond the header is left out. A file without records gives nothing.
    """
    reader = spark.read.option("pathGlobFilter", SHEETS) if sheet is None else spark.read.option("recursiveFileLookup", "true")
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))) if sheet is None else sheet
    lines = saved(reader.text(folder).select(name.alias("sheet"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line")))
    quoted = lines.where(F.contains("line", F.lit('"'))).select("sheet").distinct()
    simple = lines.join(quoted, "sheet", "left_anti").select("sheet", F.struct("block", "i").alias("at"), F.col("line").alias("record"))
    records = simple.unionByName(joined_lines(lines.join(quoted, "sheet", "left_semi")))
    records = records.withColumn("record", F.regexp_replace("record", "^\\uFEFF", "")).where("record <> ''")
    split = lambda df: df.withColumn("fields", by_separator(F.col("sheet"), lambda s: fields(F.col("record"), s)))
    first = records.groupBy("sheet").agg(F.min("at").alias("at"), F.min_by("record", "at").alias("record"))
    headers = saved(split(first).select("sheet", F.col("at").alias("header_at"), "fields", F.size("fields").alias("width")))
    given = headers.select("sheet", F.posexplode("fields").alias("place", "header"))
    named = given.withColumn("header", F.when(F.col("header") == "", F.concat(F.lit("Unnamed: "), "place")).otherwise(F.col("header")))
    again = F.row_number().over(Window.partitionBy("sheet", "header").orderBy("place")) - 1  # columns of one sheet
    columns = named.withColumn("again", again).select("sheet", (F.col("place") + 1).alias("col_no"), F.when(F.col("again") > 0, F.concat_ws(".", "header", "again")).otherwise(F.col("header")).alias("header"))
    body = split(records.join(headers.drop("fields"), "sheet").where(F.col("at") != F.col("header_at")))
    cells = body.select("sheet", F.posexplode(F.slice("fields", F.lit(1), F.col("width"))).alias("place", "value"))
    return columns, cells.select("sheet", (F.col("place") + 1).alias("col_no"), F.when(~F.col("value").isin(*MISSING), F.col("value")).alias("value"))
