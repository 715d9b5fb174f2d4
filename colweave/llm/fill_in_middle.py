"""Fill-in-the-middle transformation by run-length classes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import map_batches, rows_of, table, type_of, utf8_of

#: What marks prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


class Runs:
    """The maximal runs of letters `A-Za-z` and of other characters of a UTF-8 text.

    A run of letters is one unit, a run of others a unit for each code point. `starts` are the runs' first code points, `ends` the units up to each run's end, its own included.
    """

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        self.leads = np.flatnonzero((raw & 0xC0) != 0x80)  # each code point's first byte
        self.letters = (raw[self.leads] | 0x20) - np.uint8(97) < 26
        self.starts = np.flatnonzero(np.diff(self.letters, prepend=~self.letters[:1]))
        lengths = np.diff(self.starts, append=len(self.leads))
        self.ends = np.cumsum(np.where(self.letters[self.starts], 1, lengths))
        self.size = len(text)

    @property
    def units(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def cut(self, unit: int) -> int:
        """The code points of the first `unit` units: the run that holds the cut is found by binary search, what lies before the cut in it by arithmetic."""
        run = int(np.searchsorted(self.ends, unit, side="right"))
        if run == len(self.ends):
            return len(self.leads)
        before = int(self.ends[run - 1]) if run else 0
        return int(self.starts[run]) + (unit - before)  # in a run of letters the cut can only stand at its start, where unit = before

    def byte(self, chars: int) -> int:
        return int(self.leads[chars]) if chars < len(self.leads) else self.size


def restored(output: bytes, form: str) -> bytes:
    """The text that an output of that form was made of. A text that holds a mark is never cut, so the first of each mark is the one that was put in."""
    if form == "plain":
        return output
    first, second = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    head, _, rest = output[len(PREFIX) :].partition(first)
    body, _, middle = rest.partition(second)
    prefix, suffix = (head, body) if form == "psm" else (body, head)
    return prefix + middle + suffix


def transformed(text: bytes, draws: tuple[int, int, int, int], plain_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of a text."""
    runs = Runs(text)
    n = runs.units
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = runs.cut(low), runs.cut(high)
    prefix, middle, suffix = text[: runs.byte(a)], text[runs.byte(a) : runs.byte(b)], text[runs.byte(b) :]
    if draws[3] % 100 < spm_percent:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(df: DataFrame, seed: str = "1:", plain_percent: int = 10, spm_percent: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row: its text cut at two places drawn by its key, and put together anew.

    Units are what `[A-Za-z]+|[^A-Za-z]` matches; n is their number. The draws are the first four 8-digit groups of the SHA-256 of `seed` and the key as text (a null key adds
    nothing): two cuts, the share that stays plain, the share whose suffix comes first. A null text is empty; empty texts and such with a mark in them stay plain, and have no
    prefix_chars and middle_chars. A text's runs of classes are held, never a list of its units. Rows are independent: nothing is shuffled, equal rows give equal results, a
    row each; an empty table gives none. The key may have any type and name; other columns aren't looked at.
    """
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    given = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), hashed.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            out = [transformed(t, tuple(int(h[8 * i : 8 * i + 8], 16) for i in range(4)), plain_percent, spm_percent) for t, h in zip(utf8_of(batch, "t"), rows_of(batch, "h"))]
            n, form, prefix, middle, output = zip(*out) if out else ((), (), (), (), ())
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.record_batch([batch.column(0), *columns], names)

    out = map_batches(given, run, f"k {type_of(df, key)}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("k", key)


def digests(df: DataFrame) -> DataFrame:
    """Rows of fill_in_middle() with the SHA-256 of the output, and of the text rebuilt from output and form alone, in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output, form = utf8_of(batch, "output"), rows_of(batch, "form")
            columns = [[hashlib.sha256(o).hexdigest() for o in output], [hashlib.sha256(restored(o, f)).hexdigest() for o, f in zip(output, form)]]
            at = batch.schema.get_field_index("output")
            yield pa.record_batch([*(batch.column(i) for i in range(batch.num_columns) if i != at), *(pa.array(c, pa.string()) for c in columns)], [*(x for x in batch.schema.names if x != "output"), "output_sha256", "restored_sha256"])

    kept = df.drop("output")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_batches(df, run, f"{schema}, output_sha256 string, restored_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents."""
    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
d AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
