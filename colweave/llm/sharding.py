"""Sharding by vector bin packing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colweave.llm.common import table
from colweave.storage import saved


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item, a row of (bytes, tokens, rows): largest first, each where the dot product of its size with what is left of the shard's capacities is highest."""
    total = items.sum(axis=0)
    sizes = items / np.where(total > 0, total, 1)
    residual = np.full((shards, items.shape[1]), 1 / shards)
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -sizes.sum(axis=1), -sizes.max(axis=1))):
        out[i] = int(np.argmax(residual @ sizes[i]))
        residual[out[i]] -= sizes[i]
    return out


def vector_pack(df: DataFrame, shards: int = 8, buckets: int = 4096, key: str = "doc_id", text: str = "text", slack: float = 0.01) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row: sizes, tokens and rows of shards nearly equal; slots gapless from 0.

    What is packed are vectors of bytes, tokens and rows, each placed where the dot product with what is left of the shards is highest. Equal texts are a group. Groups larger than
    an average bucket are vectors of their own; all smaller groups are gathered by the hash of their text into `buckets` buckets, which are placed as wholes, so
    that the driver packs a few times `buckets` vectors, however many rows there are. A group stays in one shard, unless it exceeds a shard's capacity, or
    the shards' bytes would differ by more than `slack` of a shard, or two average buckets: then groups beyond a 32nd of a shard are cut into pieces of that size. size: UTF-8 bytes plus 1,
    null as none. tokens: runs of anything but ASCII white space. Rows are numbered within pieces of items, no larger than an average bucket,
    behind offsets summed by the driver: no task sorts a shard. Rows equal in all columns are interchangeable; null keys come first. Keys are of any type;
    an empty table gives no rows; other columns aren't looked at.
    """
    spark = df.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = saved(df.select(F.col(key).alias("k"), (F.octet_length(t) + 1).cast("long").alias("size"), F.regexp_count(t, F.lit(r"\S+")).cast("long").alias("tokens"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(t).alias("h")))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    capacity, mean_bytes, mean_rows = max(1, total[0] / shards), max(1, total[0] / buckets), max(1, total[1] / buckets)
    hot = rows.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > mean_bytes) | (F.col("n") > 4 * mean_rows)).collect()  # fewer than 1.25 x buckets
    split = {r.h: (min(r.n, max(math.ceil(r.b / mean_bytes), math.ceil(r.n / mean_rows))), r.b) for r in hot}
    pieces = spark.createDataFrame([(h, n) for h, (n, _) in split.items()], "h long, pieces long")
    rows = rows.join(F.broadcast(pieces), "h", "left")
    piece = F.coalesce(F.pmod(F.xxhash64("k", F.lit(1)), F.col("pieces")), F.lit(0))
    rows = rows.select("k", "size", "tokens", "crc", F.when(F.col("pieces").isNull(), F.pmod("h", F.lit(buckets))).otherwise(F.col("h")).alias("g"), F.col("pieces").isNotNull().alias("alone"), piece.alias("piece"))
    units = sorted(tuple(r) for r in rows.groupBy("alone", "g", "piece").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect())
    for most in (capacity, capacity / 32):  # groups whole where they fit, else in pieces
        index: dict[tuple, int] = {}
        parts = {h: min(n, math.ceil(b / most)) for h, (n, b) in split.items()}
        at = [index.setdefault((alone, g, p * parts[g] // split[g][0] if alone else 0), len(index)) for alone, g, p, *_ in units]
        vectors = np.zeros((len(index), 3))
        np.add.at(vectors, at, np.array([u[3:] for u in units], dtype=float).reshape(-1, 3))
        where = place(vectors, shards)
        filled = np.bincount(where, weights=vectors[:, 0], minlength=shards)
        if np.ptp(filled) <= max(slack * capacity, 2 * mean_bytes):
            break
    ends, placed = [0] * shards, []
    for i, u in zip(at, units, strict=True):
        s = int(where[i])
        placed.append((*u[:3], s, ends[s]))
        ends[s] += u[5]
    offsets = spark.createDataFrame(placed, "alone boolean, g long, piece long, shard int, offset long")
    order = Window.partitionBy("alone", "g", "piece").orderBy("k", "size", "crc")
    numbered = rows.withColumn("n", F.row_number().over(order) - 1).join(F.broadcast(offsets), ["alone", "g", "piece"])
    return numbered.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("n")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents in 8 shards of nearly equal bytes."""
    out = vector_pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
