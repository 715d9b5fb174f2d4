"""Tables, annotations, submissions and models in files."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colweave.storage import exists

# What stands for a missing cell.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SEPARATORS = {".csv": ",", ".tsv": "\t"}


def read_table(spark: SparkSession, name: str, folder: str, keep_text: bool = True) -> DataFrame:
    """A .csv or .tsv file with a header; without an extension .tsv is tried, then .csv. Cells stay text, missing ones null."""
    for candidate in (name, f"{name}.tsv", f"{name}.csv"):
        separator = SEPARATORS.get(candidate[-4:].lower())
        if separator and exists(spark, f"{folder}/{candidate}"):
            df = spark.read.csv(f"{folder}/{candidate}", sep=separator, header=True, multiLine=True, escape='"', inferSchema=not keep_text)
            return df.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))
    raise FileNotFoundError(f"{folder}/{name}")


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folder's tables, in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(n for n in (f.getPath().getName() for f in found) if n[-4:].lower() in SEPARATORS)


def without_mount(argument: str, mount: str = "/input/") -> str:
    """A file argument without the mount in front, cut as a whole and not letter by letter."""
    return re.sub(f"^{re.escape(mount)}", "", argument)


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """(col_no, header, result): the first result of each annotated column."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode("columns").alias("c")).select(F.col("c.columnNumber").alias("col_no"), F.col("c.headerValue").alias("header"), F.element_at("c.results", 1)["result"].alias("result"))


def write_submissions(columns: DataFrame, folder: str) -> None:
    """(sheet, columns) as one file <base>-Submission.json for each sheet; keys with null stay. Files are written by the tasks, a name of its own each, and put in place whole.

    base is the sheet's name without its extension, which sheets that differ by nothing else keep: a.csv and a.tsv give two files.
    """
    spark = columns.sparkSession
    base = F.regexp_replace("sheet", "(?i)[.](csv|tsv)$", "")
    alone = F.count("*").over(Window.partitionBy(F.lower(base))) == 1  # a row for each sheet; some stores don't tell cases apart
    named = columns.select(F.when(alone, base).otherwise(F.col("sheet")).alias("base"), F.to_json(F.struct("columns"), {"ignoreNullFields": "false"}).alias("value"))
    parts = f"{folder}/_parts"
    named.write.mode("overwrite").partitionBy("base").text(parts)
    fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs_of.Path(parts)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def put(sheet) -> None:
        part = next(f.getPath() for f in fs.listStatus(sheet) if f.getPath().getName().startswith("part-"))
        target = fs_of.Path(f"{folder}/{unquote(sheet.getName().removeprefix('base='))}-Submission.json")
        fs.delete(target, False)
        fs.rename(part, target)

    with ThreadPoolExecutor(16) as pool:
        for done in [pool.submit(put, f.getPath()) for f in fs.listStatus(root) if f.getPath().getName().startswith("base=")]:
            done.result()
    fs.delete(root, True)


def read_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """(sheet, columns) of a folder's submissions."""
    raw = spark.read.json(f"{folder}/*-Submission.json", multiLine=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*)-Submission[.]json$", 1).alias("sheet"), "columns")


def write_training(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
