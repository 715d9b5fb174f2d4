"""What the operators share: words of texts, tables in the shared folder, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colweave.storage import TEXT_BATCH_BYTES, batches_of, saved

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: As LOWER, with every ASCII byte that is neither a letter nor a digit turned into a space. UTF-8 bytes from 128 on are parts of words.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)

#: Rows of one key that a task may take in a join, at least.
HOT_ROWS = 500


def words(text: bytes) -> list[bytes]:
    """The lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text."""
    return text.translate(WORD_BYTES).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that a worker no longer uses back to the machine: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has its own ways
        return


def type_of(df: DataFrame, column: str) -> str:
    return df.select(F.col(f"`{column}`")).schema[0].dataType.simpleString()


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, made unlike all of df's columns, whatever these are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return tuple(out)


def with_columns(schema: StructType, added: str) -> StructType:
    """A schema with further columns, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(added).fields])


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    # a batch by bytes, not by rows alone: ten thousand long texts would be held twice over in each worker, and as buffers outside the heap in the executor
    batches_of(df.sparkSession, TEXT_BATCH_BYTES)
    return df.mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def utf8_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def looked_up(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows joined with values, which has one row for each key, so that no key gathers its rows in one task.

    Keys that over a ten-thousandth of the rows have, and over HOT_ROWS, are counted with partial sums; there can be ten thousand of them at most, so their values are broadcast and
    their rows stay where they are. All other rows are dealt by their key. rows and values should be saved tables, as both are read twice.
    """
    n = rows.count()
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(HOT_ROWS, n // 10_000)).select(key)
    hot = saved(values.join(F.broadcast(hot), key, "left_semi"))  # ten thousand rows at most
    if hot.isEmpty():
        return rows.join(values, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(values, key))


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every id in edges (src, dst): component_id is the smallest id it is connected with.

    Rounds of hooking each id to its smallest neighbour, pointer jumping, and contracting the edges; what remains
    shrinks by a constant factor at least. Minima are combined on the map side and joins are plain equi-joins
    of saved tables, so that a hub neither gathers in one task nor keeps adaptive execution from splitting it.
    """
    edges = saved(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).select("id", F.least("id", "p").alias("p")))
        while True:
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            jumped = saved(parent.join(up, "p").select("id", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            parent = jumped.select("id", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("id", F.col("p").alias("component_id"))
        else:
            hop = parent.select(F.col("id").alias("component_id"), "p")
            labels = saved(labels.join(hop, "component_id", "left").select("id", F.coalesce("p", "component_id").alias("component_id")))
        left, right = parent.select(F.col("id").alias("a"), F.col("p").alias("pa")), parent.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        edges = saved(edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return labels
