"""Embedding near-duplicates by an exact metric range join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import components, looked_up, map_batches, table
from colweave.llm.simhash import spanned
from colweave.storage import broadcast, saved

#: Vectors that a pivot may stand for, the most pivots and their bytes, the most vectors of a block of a cell, vectors on which numbers of pivots are tried, and rows to be dealt for each vector at most, if that is possible.
PER_PIVOT = (8192, 2048, 512, 128)
MAX_PIVOTS, PIVOT_BYTES = 4096, 32 << 20
BLOCK = 8192
TRIED = 2048
COPIES = 6
#: Distances are widened by so much against rounding when vectors are dealt out; links themselves are decided by the cosine in double precision.
SLACK = 1e-6
#: Cosines this near to the threshold are summed once more in an order that both vectors share.
NEAR = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked(x: np.ndarray, y: np.ndarray, cosine: float, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of x and y with at least the cosine; with `upper` only i < j. Whether a pair is linked doesn't depend on the block it is met in."""
    for at in range(0, len(x), 512):
        i, j = np.nonzero(x[at : at + 512] @ y.T >= cosine - NEAR)
        i = i + at
        if upper:
            i, j = i[i < j], j[i < j]
        for lo in range(0, len(i), 65536):
            a, b = i[lo : lo + 65536], j[lo : lo + 65536]
            same = (x[a] * y[b]).sum(axis=1) >= cosine
            yield a[same], b[same]


def leaves_home(d: np.ndarray, between: np.ndarray, rank: np.ndarray, reach: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """From distances to all pivots: each vector's own cell, and which other cells it goes to."""
    near = d.argmin(axis=1)
    best = d[np.arange(len(d)), near][:, None]
    goes = (d <= best + 2 * r) & (d <= reach[None, :] + SLACK) & (d * d - best * best <= 2 * r * between[near] + SLACK) & (rank[None, :] > rank[near][:, None])
    goes[np.arange(len(d)), near] = False
    return near, goes


def ranks(size: np.ndarray) -> np.ndarray:
    """Places of cells by size; of two cells that of the higher place joins what lies across their border."""
    rank = np.empty(len(size), dtype=np.int64)
    rank[np.lexsort((np.arange(len(size)), size))] = np.arange(len(size))
    return rank


def chosen_pivots(sample: np.ndarray, n: int, r: float) -> np.ndarray:
    """The first vectors of a sample, as many as give the least comparisons among those numbers that deal at most COPIES rows a vector, or else deal the fewest.

    Vectors in clusters want a pivot for each cluster, evenly spread ones few pivots. Tried on the sample's other vectors; the result doesn't depend on the choice.
    """
    best = None
    for k in sorted({min(MAX_PIVOTS, max(1, n // per)) for per in PER_PIVOT}):
        p, rest = sample[:k], sample[k : k + TRIED]
        if len(p) < k or not len(rest):
            break
        d = distances(rest, p)
        size = np.bincount(d.argmin(axis=1), minlength=k)
        near, goes = leaves_home(d, distances(p, p), ranks(size), np.full(k, np.inf), r)
        own, guests = size * n / len(rest), goes.sum(axis=0) * n / len(rest)
        nh, ng = np.ceil(own / BLOCK), np.ceil(guests / BLOCK)
        dealt, pairs = (own * (nh + ng) + guests * nh).sum() / n, (own * (own / 2 + guests)).sum() / n
        cost = (dealt > COPIES, dealt if dealt > COPIES else pairs)
        if best is None or cost < best[0]:
            best = (cost, p)
    return sample[: max(1, min(MAX_PIVOTS, n // PER_PIVOT[0]))] if best is None else best[1]


def range_join(df: DataFrame, cosine: float = 0.95, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every vector: others with a cosine of `cosine` or more are linked.

    On unit vectors the cosine is a distance r. Vectors go to the cell of their nearest pivot. By the triangle inequality a
    vector may be linked into another cell only if its distance to that pivot is at most 2r beyond that to its own pivot and at most r
    beyond the cell's radius; and as the border of two cells is the plane midway between their pivots, only if it is at most r away from this plane. Of two cells the larger one
    joins what lies across their border: only the smaller one's vectors are copied, each pair is met once, and none is lost. Cells are joined independently, in pairs of blocks of
    at most BLOCK vectors, each pair a task's group. Equal vectors are one class with a count; classes of copies
    are never expanded into pairs. Pivots are a bounded sample by hash, drawn for each number of dimensions; see chosen_pivots(). Null vectors, zero vectors, and such with null or non-finite components link
    with nothing. Repeated rows count as other vectors. A null key never names a component; kept is false for it unless its component has no key at all. An empty table gives no rows;
    other columns aren't looked at.
    """
    spark = df.sparkSession
    kind = "float" if "float" in df.select(embedding).schema[0].dataType.simpleString() else "double"  # single floats are dealt out as such, and compared as doubles
    e = F.col(embedding).cast("array<double>")
    valid = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) & F.exists(e, lambda x: x != 0)
    given = df.select(F.col(key).alias("k"), F.when(F.coalesce(valid, F.lit(False)), F.transform(e, lambda x: (x + F.lit(0.0)).cast(kind))).alias("e"))  # + 0.0: -0.0 is 0.0
    # a class is named by a digest of its vector, as keys may be null or repeated
    named = given.select("k", "e", F.when(F.col("e").isNotNull(), F.substring(F.unhex(F.sha2(F.to_json(F.struct("e")).cast("binary"), 256)), 1, 16)).alias("c"))
    rows = saved(named.select("k", "c"))
    classes = saved(named.where("c IS NOT NULL").groupBy("c").agg(F.min("k").alias("k"), F.count("*").alias("n"), F.first("e").alias("e")).withColumn("dim", F.size("e")))
    sizes = {r.dim: r["count"] for r in classes.groupBy("dim").count().orderBy(F.desc("count")).limit(64).collect()}
    r = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        most = min(MAX_PIVOTS, max(1, n // PER_PIVOT[-1])) + TRIED
        sample = [x.e for x in classes.where(F.col("dim") == dim).orderBy(F.xxhash64("c")).select("e").limit(max(1, min(most, PIVOT_BYTES // (8 * dim)))).collect()]
        pivots[dim] = chosen_pivots(unit(np.array(sample)), n, r)
    shared = broadcast(spark, pivots)  # MAX_PIVOTS at most for each of 64 dimensions

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = unit(matrix(own.column(2)))
                if int(dim) in shared.value:
                    d = np.concatenate([distances(x[i : i + 1024], shared.value[int(dim)]) for i in range(0, len(x), 1024)])
                    at = d.argmin(axis=1)
                    near = d[np.arange(len(x)), at]
                else:  # beyond the 64 commonest dimensions: one cell
                    at, near = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
                yield pa.record_batch([own.column(3), pa.array(at.astype(np.int32)), pa.array(near)], ["dim", "cell", "d"])

    found = map_batches(classes.select("c", "n", "e", "dim"), home, "dim int, cell int, d double").groupBy("dim", "cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()  # at most 64 x MAX_PIVOTS, and other dimensions
    cells = broadcast(spark, {(c.dim, c.cell): (c.radius, c.n) for c in found})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "cell", "home", "c", "n", "e"]
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in map(int, np.unique(dims)):
                own = batch.filter(pa.array(dims == dim))
                x = unit(matrix(own.column(2)))
                if dim not in shared.value:
                    yield pa.record_batch([own.column(3), pa.array(np.zeros(len(x), np.int32)), pa.array(np.ones(len(x), bool)), own.column(0), own.column(1), own.column(2)], names)
                    continue
                p = shared.value[dim]
                known = [cells.value.get((dim, j), (-math.inf, -1)) for j in range(len(p))]
                reach, size = np.array([k[0] for k in known]) + r, np.array([k[1] for k in known])
                between, rank = distances(p, p), ranks(size)
                for at in range(0, len(x), 1024):
                    near, goes = leaves_home(distances(x[at : at + 1024], p), between, rank, reach, r)
                    goes[np.arange(len(near)), near] = True
                    i, j = np.nonzero(goes)
                    take = own.take(pa.array(i + at))
                    yield pa.record_batch([pa.array(np.full(len(i), dim, np.int32)), pa.array(j.astype(np.int32)), pa.array(near[i] == j), take.column(0), take.column(1), take.column(2)], names)

    dealt = saved(map_batches(classes.select("c", "n", "e", "dim"), deal, f"dim int, cell int, home boolean, c binary, n long, e array<{kind}>"))
    # a cell's home vectors lie in nh blocks, its guests in ng; a task's group is a pair of home blocks, i <= j, or a home block i and a block j of guests
    counts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("nh"), F.ceil(F.count_if(~F.col("home")) / BLOCK).cast("int").alias("ng")).collect()
    plan = spark.createDataFrame([tuple(c) for c in counts], "dim int, cell int, nh int, ng int")
    placed = dealt.join(F.broadcast(plan), ["dim", "cell"])  # a row for each cell: bounded by the pivots
    placed = placed.withColumn("b", F.pmod(F.xxhash64("c"), F.greatest(F.when(F.col("home"), F.col("nh")).otherwise(F.col("ng")), F.lit(1))).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    spot = lambda guest, i, j: F.struct(F.lit(guest).alias("guest"), i.alias("i"), j.alias("j"))
    spots = F.when(F.col("home"), F.concat(F.transform(upto("nh"), lambda o: spot(False, F.least("b", o), F.greatest("b", o))), F.transform(upto("ng"), lambda o: spot(True, F.col("b"), o)))).otherwise(F.transform(upto("nh"), lambda o: spot(True, o, F.col("b"))))
    met = placed.select("dim", "cell", "home", "b", "c", "n", "e", F.explode(spots).alias("s")).select("dim", "cell", "s.*", "home", "b", "c", "n", "e")

    def joined(arrow):
        schema = pa.schema([("c", pa.binary()), ("links", pa.int64()), ("partner", pa.binary())])
        guest, i, j = (arrow.column(x)[0].as_py() for x in ("guest", "i", "j"))
        first = arrow.column("home").to_numpy() if guest else arrow.column("b").to_numpy() == i
        one = arrow.filter(pa.array(first)).combine_chunks()
        two = one if not guest and i == j else arrow.filter(pa.array(~first)).combine_chunks()
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        x = unit(matrix(one.column("e").combine_chunks()))
        y = x if two is one else unit(matrix(two.column("e").combine_chunks()))
        at = 0 if two is one else len(x)
        names = one.column("c").to_pylist() + ([] if two is one else two.column("c").to_pylist())
        n = np.concatenate([one.column("n").to_numpy(), *([] if two is one else [two.column("n").to_numpy()])])
        links = np.zeros(len(names), dtype=np.int64)

        def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in linked(x, y, cosine, two is one):
                np.add.at(links, a, n[b + at])
                np.add.at(links, b + at, n[a])
                yield a, b + at

        a, b = spanned(np.arange(len(names)), counted())
        rows = [(names[k], int(links[k]), None) for k in np.flatnonzero(links)] + [(names[p], 0, names[q]) for p, q in zip(a, b)]
        return pa.table([[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]], schema=schema)

    met = saved(met.groupBy("dim", "cell", "guest", "i", "j").applyInArrow(joined, "c binary, links long, partner binary"))
    groups = components(met.where("partner IS NOT NULL").select(F.col("c").alias("src"), F.col("partner").alias("dst")))
    own = met.groupBy("c").agg(F.sum("links").alias("links"))
    known = classes.select("c", "k", "n").join(own, "c", "left").join(groups.select(F.col("id").alias("c"), "component_id"), "c", "left")
    known = saved(known.select("c", "k", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "c").alias("g")))
    names = known.groupBy("g").agg(F.min("k").alias("component_id"))
    by_class = saved(known.join(names, "g").select("c", "n_links", "component_id"))
    alone = rows.where("c IS NULL").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    in_class = looked_up(rows.where("c IS NOT NULL"), by_class, "c").select("k", "n_links", "component_id")
    return in_class.unionAll(alone).select(F.col("k").alias(key), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all embeddings, cosine 0.95."""
    return range_join(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
       WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS ra, b.r AS rb, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT ra, count(*) AS n FROM link GROUP BY ra)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least_.component_id, v.vec_id = least_.component_id AS kept
FROM v LEFT JOIN n ON n.ra = v.r JOIN least_ ON least_.a = v.vec_id
"""
