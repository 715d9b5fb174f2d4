"""Tables in the folder that driver and executors share: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: Bytes of a batch of rows that goes to a worker, and of one of texts or of what is made of them, which takes many times its size while it is worked on; a session's own setting is left alone.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES, TEXT_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "268435456", 8 << 20, 2 << 20

#: Rows of a row group where a row is long: Spark's reader takes as many as 4,096 of a row group into memory at once.
GROUP_SETTING, GROUP_ROWS = "parquet.block.row.count.limit", 8

#: How many bytes a byte of a file is in memory, for the planner.
FACTOR_SETTING, FACTOR_DEFAULT, FACTOR = "spark.sql.sources.fileCompressionFactor", "1.0", 20.0

#: What the scopes that are open now undo at their end, the innermost last.
_open: list[list[Callable[[], None]]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a session of one machine gets a new folder of its own; on a cluster, whose machines share no such folder, it has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="colweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables of saved() and values of broadcast() made inside are removed at its end: results that read them have to be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for undo in reversed(_open.pop()):
            undo()


def at_end(undo: Callable[[], None]) -> None:
    if _open:
        _open[-1].append(undo)


def broadcast(spark: SparkSession, value) -> Broadcast:
    """A value of bounded size for all tasks, removed at the end of the scope around it, if there is one."""
    shared = spark.sparkContext.broadcast(value)
    at_end(shared.destroy)
    return shared


def batches_of(spark: SparkSession, size: int) -> None:
    """From now on batches are of about `size` bytes, unless the session has a setting of its own."""
    if spark.conf.get(BATCH_SETTING, None) in (None, BATCH_DEFAULT, str(BATCH_BYTES), str(TEXT_BATCH_BYTES)):
        spark.conf.set(BATCH_SETTING, str(size))


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of bounded size: ten thousand rows may be gigabytes."""
    batches_of(df.sparkSession, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def saved(df: DataFrame, path: str | None = None, long_rows: bool = False) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, survives a lost executor, and gives the planner exact sizes. Long rows, of about a megabyte, are read a few at a time."""
    path = path or f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    (in_small_groups(df.write) if long_rows else df.write).parquet(path)
    at_end(lambda spark=df.sparkSession: delete(spark, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_groups(writer: DataFrameWriter) -> DataFrameWriter:
    """The writer with row groups of GROUP_ROWS rows, for tables whose rows are long: readers hold one row group at most."""
    return writer.option(GROUP_SETTING, GROUP_ROWS)


def sizes_in_memory(spark: SparkSession) -> None:
    """Files of repeated values are far smaller than their rows: by their size millions of rows would be sent whole through the driver. A session's own setting is left alone; small sides are still found by their rows while a query runs."""
    if spark.conf.get(FACTOR_SETTING, None) in (None, FACTOR_DEFAULT):
        spark.conf.set(FACTOR_SETTING, str(FACTOR))


def bucketed(df: DataFrame, column: str, path: str) -> DataFrame:
    """df as a table of buckets by a column, as many as shuffles have partitions: joins by it leave the table where it is. Read again by bucketed_at()."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"colweave_{uuid.uuid4().hex}"
    df.repartition(n, column).write.format("parquet").option("path", f"{path}/{column}-{n}").bucketBy(n, column).sortBy(column).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return bucketed_at(spark, column, path)


def bucketed_at(spark: SparkSession, column: str, path: str) -> DataFrame:
    """The table that bucketed() wrote to a path, also in another session."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    at = next(f.getPath().getName() for f in found if f.getPath().getName().startswith(f"{column}-"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{at}").schema)
    name = f"colweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (`{column}`) SORTED BY (`{column}`) INTO {at.rsplit('-', 1)[1]} BUCKETS LOCATION '{path}/{at}'")
    at_end(lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"))
    return spark.table(name)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def clear_saved(spark: SparkSession) -> None:
    """Delete all tables of saved(); call it once results that read them have been written."""
    delete(spark, f"{shared_folder(spark)}/tables")
