"""Folders of sheets against Python's own reader of such files."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from colweave.operators import classify as K
from colweave.operators import decide as D
from colweave.sources import files
from colweave.sources import sheets as H

VALUES = ["a", "", "NA", "x y", 'q"r', '5" pipe', "a,b", "a\tb", "line1\nline2", '""', 'he said "hi"', "\n", "nan", "é", '"', "\n\n,\t\n", "1"]


def written(folder, n, seed=1, rows=30):
    """(headers, cells) by file of n random sheets."""
    draw, headers, cells = random.Random(seed), {}, {}
    for k in range(n):
        separator, extension = draw.choice([(",", ".csv"), ("\t", ".TSV"), (",", ".Csv")])
        width = draw.randint(1, 6)
        header = [draw.choice(["a", "b", "", "c,d", 'x"y', "a\nb"]) for _ in range(width)]
        header[0] = header[0] or "h"
        body = [[draw.choice(VALUES) for _ in range(width)] for _ in range(draw.randint(0, rows))]
        body = [r for r in body if width > 1 or r[0]]
        out = io.StringIO()
        w = csv.writer(out, delimiter=separator, lineterminator="\r\n" if k % 3 == 0 else "\n", quoting=csv.QUOTE_MINIMAL if k % 2 else csv.QUOTE_ALL)
        w.writerow(header)
        w.writerows(body)
        name = f"s+ {k}é{extension}"
        (folder / name).write_text(("﻿" if k % 7 == 3 else "\n" if k % 7 == 5 else "") + out.getvalue(), newline="")
        seen, own = {}, []
        for i, h in enumerate(header):
            h = h or f"Unnamed: {i}"
            own.append(f"{h}.{seen[h]}" if seen.get(h) else h)
            seen[h] = seen.get(h, 0) + 1
        headers[name] = own
        cells[name] = sorted(((i + 1, None if v in files.MISSING else v) for r in body for i, v in enumerate(r)), key=str)
    return headers, cells


def read(spark, folder):
    columns, cells = H.read_sheets(spark, f"file://{folder}")
    headers, found = {}, {}
    for r in columns.orderBy("sheet", "col_no").collect():
        headers.setdefault(r.sheet, []).append(r.header)
    for r in cells.collect():
        found.setdefault(r.sheet, []).append((r.col_no, r.value))
    return headers, {k: sorted(v, key=str) for k, v in found.items()}


@pytest.mark.parametrize("block", [None, 40])
def test_against_the_csv_module(spark, tmp_path, block):
    """Also with files read in blocks of 40 bytes, so that records, fields and quoted lines go across many of them."""
    headers, cells = written(tmp_path, 12 if block else 60, rows=12 if block else 30)
    (tmp_path / "nothing.csv").write_text("")
    (tmp_path / "other.txt").write_text("x\n1\n")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        if block:
            for n in names:
                spark.conf.set(n, str(block) if n == names[0] else "0")
            assert spark.read.text(f"file://{tmp_path}").select("_metadata.file_block_start").distinct().count() > 8
        got = read(spark, tmp_path)
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert got[0] == headers
    assert got[1] == {k: v for k, v in cells.items() if v}


def test_odd_records(spark, tmp_path):
    """Short and long records, stray quotes inside fields, text behind a closing quote, a quote that is never closed, blank lines."""
    (tmp_path / "a.csv").write_text('x,y\n1\n\n2,3,4\n5" pipe,6\n"7"8,9\n\n,\n')
    (tmp_path / "b.tsv").write_text('x\ty\n1\t"open\n2\t3\n')
    (tmp_path / "c.csv").write_text("only,a,header")
    headers, cells = read(spark, tmp_path)
    assert headers == {"a.csv": ["x", "y"], "b.tsv": ["x", "y"], "c.csv": ["only", "a", "header"]}
    assert cells["a.csv"] == sorted([(1, "1"), (1, "2"), (2, "3"), (1, '5" pipe'), (2, "6"), (1, "78"), (2, "9"), (1, None), (2, None)], key=str)
    assert cells["b.tsv"][0] == (1, "1") and len(cells["b.tsv"]) == 2 and "c.csv" not in cells


def test_two_thousand_files(spark, tmp_path):
    """As many plans and stages as for two files."""
    sizes = []
    for n in (2, 2000):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"t{i}.csv").write_text(f"k{i},v\n{i},x\n{i + 1},\n")
        columns, cells = H.read_sheets(spark, f"file://{folder}")
        assert columns.count() == 2 * n and cells.count() == 4 * n and cells.where("value IS NULL").count() == n
        sizes.append([len(df._jdf.queryExecution().optimizedPlan().toString().split("\n")) for df in (columns, cells)])
    assert sizes[0] == sizes[1]


def test_folder_to_submissions(spark, tmp_path):
    """Files of one base keep apart; a failed run leaves no submission; the folder is read as such."""
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "a.tsv", "b.csv"):
        (tmp_path / "in" / name).write_text(f"h{name[-3:]}\n1\n")
    columns, cells = K.columns_and_cells(f"file://{tmp_path}/in", spark)
    assert sorted(tuple(r) for r in columns.collect()) == [("a.csv", 1, "hcsv"), ("a.tsv", 1, "htsv"), ("b.csv", 1, "hcsv")]
    values = cells.join(columns, ["sheet", "col_no"]).withColumn("permissible", F.lit("CONFORMING")).withColumn("code", F.lit(None).cast("string"))
    out = D.submission(D.value_domain(values, ["sheet", "col_no", "header"]).withColumn("results", F.array(D.nomatch_result(F.col("value_domain")))))
    broken = out.withColumn("columns", F.when(F.col("sheet") == "b.csv", F.raise_error(F.lit("no"))).otherwise(F.col("columns")))
    with pytest.raises(Exception, match="no"):
        files.write_submissions(broken, f"file://{tmp_path}/out")
    assert not list((tmp_path / "out").glob("*.json"))
    files.write_submissions(out, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0] != ".") == ["a.csv-Submission.json", "a.tsv-Submission.json", "b-Submission.json"]
    assert json.loads((tmp_path / "out" / "a.tsv-Submission.json").read_text())["columns"][0]["headerValue"] == "htsv"


def test_training_rows_in_files(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 0.5), (None, 2, None)], "sheet string, col_no int, metric1 double")
    files.write_training(df, f"file://{tmp_path}/t")
    files.write_training(df, f"file://{tmp_path}/t")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/t").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
