"""Embedding whitening by a residue-number scatter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import map_batches, table, type_of
from colweave.storage import broadcast, saved

#: An entry c becomes floor(SCALE c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Moduli lie below 2^21, and residues within half of one: sums of BLOCK products of two are below 2^53, so a product of matrices of doubles is exact.
MODULUS, BLOCK = 1 << 21, 4096
#: Integers up to here are held in 64 bits, larger ones as Python's.
LONG = 1 << 62


def moduli(most: int) -> list[int]:
    """The largest primes below MODULUS, one at least, whose product exceeds 2 x most: integers from -most to most are told apart by their residues."""
    out, product, p = [], 1, MODULUS
    while not out or product <= 2 * most:
        p -= 1
        while any(p % q == 0 for q in range(2, math.isqrt(p) + 1)):
            p -= 1
        out.append(p)
        product *= p
    return out


def reconstructed(residues: dict[int, np.ndarray]) -> np.ndarray:
    """By the Chinese remainder theorem, the integers between -M/2 and M/2 with these residues, M being the product of the moduli."""
    product = math.prod(residues)
    total = sum(r.astype(object) * (product // p * pow(product // p, -1, p)) for p, r in residues.items()) % product
    return np.where(total > product // 2, total - product, total)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each dimension and place of vectors (dim, x): their number, the sums of the entries' high and low 32 bits, the extremes."""
    found: dict[int, list] = {}
    for batch in batches:
        for dim, own in by_dimension(batch):
            x = matrix(own.column(own.schema.get_field_index("x")), dim)
            now = [len(x), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
            old = found.get(dim)
            found[dim] = now if old is None else [old[0] + now[0], old[1] + now[1], old[2] + now[2], np.minimum(old[3], now[3]), np.maximum(old[4], now[4])]
    for dim, (n, high, low, least, most) in found.items():
        yield pa.record_batch([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), *map(pa.array, (high, low, least, most))], ["dim", "place", "n", "high", "low", "least", "most"])


class Fit:
    """n distinct vectors of one dimension with sums S by place; y = n x - S is centred without rounding."""

    def __init__(self, n: int, sums: list[int], least: list[int], most: list[int]):
        self.n, self.sums, self.dim = n, np.array(sums, dtype=object), len(sums)
        self.reach = n * max(b - a for a, b in zip(least, most))  # no y is larger
        self.moduli = moduli(n * self.reach**2)
        # y = n (x - m) - (S - n m) for the floor m of the mean: both parts are small
        self.floor = np.array([s // n for s in sums], dtype=object)
        self.left = self.sums - n * self.floor

    def residues(self, x: np.ndarray, p: int) -> np.ndarray:
        """y modulo p, between -p/2 and p/2, as doubles."""
        r = (x % p * (self.n % p) - (self.sums % p).astype(np.int64)) % p
        return np.where(r > p // 2, r - p, r).astype(np.float64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        if 2 * self.reach < LONG:
            return (x - self.floor.astype(np.int64)) * self.n - self.left.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def deviations(self, y: np.ndarray) -> list[Decimal | None]:
        """Sums of squares, which decimals of 38 digits hold or which are null."""
        if self.dim * self.reach**2 < LONG:
            return list(map(Decimal, (y * y).sum(axis=1).tolist()))
        y = y.astype(object)
        return [Decimal(int(v)) if v < 10**38 else None for v in (y * y).sum(axis=1)]


def scatter(fits, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of this partition's sums of products y_i y_j for each modulus: (dim, modulus, i, sums by j)."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for dim, own in by_dimension(batch):
            x, fit = matrix(own.column(own.schema.get_field_index("x")), dim), fits.value[dim]
            for p in fit.moduli:
                total = sums.setdefault((dim, p), np.zeros((dim, dim), np.int64))
                for at in range(0, len(x), BLOCK):
                    r = fit.residues(x[at : at + BLOCK], p)
                    total += np.rint(r.T @ r).astype(np.int64) % p
                total %= p
    for (dim, p), total in sums.items():
        ids = [pa.array(np.full(dim, v, t)) for v, t in ((dim, np.int32), (p, np.int64))]
        yield pa.record_batch([*ids, pa.array(np.arange(dim, dtype=np.int32)), pa.ListArray.from_arrays(np.arange(0, dim * dim + 1, dim, dtype=np.int32), total.ravel())], ["dim", "modulus", "i", "sums"])


def added(arrow: pa.Table) -> pa.Table:
    """One row of a scatter from the rows of all partitions: as many as there are partitions."""
    dim, p, i = (arrow.column(c)[0].as_py() for c in ("dim", "modulus", "i"))
    total = matrix(arrow.column("sums").combine_chunks(), dim).sum(axis=0) % p
    return pa.table({"dim": pa.array([dim], pa.int32()), "modulus": [p], "i": pa.array([i], pa.int32()), "sums": [total]})


class Model:
    """The first components of a fit: unit eigenvectors of its covariance, eigenvalues, shares of its trace."""

    def __init__(self, fit: Fit, scattered: np.ndarray, components: int):
        covariance = (scattered / fit.n**3).astype(np.float64)  # of Python integers, each quotient correctly rounded
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[: min(components, fit.dim)]
        trace = sum(int(v) for v in scattered.diagonal()) / fit.n**3
        self.fit, self.values, self.vectors = fit, values[order], vectors[:, order]
        self.found = self.values > max(values.max(), 0.0) * fit.dim * np.finfo(np.float64).eps
        self.explained = np.where(self.found, self.values, 0.0) / (trace or 1.0)
        self.scale = np.where(self.found, 1.0 / np.sqrt(np.where(self.found, self.values, 1.0)), np.nan)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y / self.fit.n).astype(np.float64) @ self.vectors * self.scale


def products(models, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This partition's sums of products of whitened components: (dim, i, j, sum)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, own in by_dimension(batch):
            model = models.value[dim]
            w = model.whitened(model.fit.centred(matrix(own.column(own.schema.get_field_index("x")), dim)))[:, model.found]
            sums[dim] = sums.get(dim, 0) + w.T @ w
    for dim, total in sums.items():
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.record_batch([pa.array(np.full(total.size, dim, np.int32)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["dim", "i", "j", "sum"])


def whitened(df: DataFrame, components: int = 16, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every vector and its first components.

    Entries c become integers x = floor(64 c) + 1000000. The fit list is each distinct vector once, n of them with sums S. Tasks multiply the residues of n x - S with each other modulo
    several primes below 2^21, in doubles without rounding; sums of all tasks are put together by the Chinese remainder theorem to the exact scatter; the
    driver divides it by n^3, which gives the covariance, and takes its eigenvectors in double precision. There are as many primes as the scatter's bound, known from n and the
    extremes of x, asks for. deviation is the sum of (n x - S)^2 over the places, a decimal of 38 digits, null beyond them. whitened is the projection of x - S/n on a component over
    the root of its eigenvalue; explained the eigenvalue over the trace; identity_error the largest entry of whitened's covariance over the fit list minus the identity.

    Vectors go through four passes and one shuffle, which finds distinct ones, copies being combined before it; the driver and each task hold matrices of dimension x dimension.
    Vectors of each length are a space of their own. Vectors that are null or empty, or hold null, non-finite or such entries as no long can hold, are dropped.
    Where a component has no variance, as all have where n is 1, whitened is null and explained 0; identity_error leaves it out, and is null if none is left.
    Repeated rows and null keys stay, a row for each; an empty table gives none. The key may have any type and name; other columns aren't looked at.
    """
    spark = df.sparkSession
    e = F.col(embedding).cast("array<double>")
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= float(LONG))
    given = df.select(F.col(key).alias("k"), e.alias("e")).where(e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, entry))
    rows = saved(given.select("k", F.transform("e", lambda c: (F.floor(c * F.lit(float(SCALE))) + F.lit(OFFSET)).cast("long")).alias("x"), F.size("e").alias("dim")))
    fit = saved(rows.select("dim", "x").distinct())
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    places = map_batches(fit, totals, "dim int, place int, n long, high long, low long, least long, most long").groupBy("dim", "place")
    found: dict[int, list] = {}
    for r in places.agg(F.sum("n").alias("n"), exact("high"), exact("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim", "place").collect():  # a row for each place of a vector
        found.setdefault(r.dim, []).append((r.n, (int(r.high) << 32) + int(r.low), r.least, r.most))
    fits = {dim: Fit(v[0][0], *map(list, list(zip(*v))[1:])) for dim, v in found.items()}
    shared = broadcast(spark, fits)
    sums = map_batches(fit, lambda batches: scatter(shared, batches), "dim int, modulus long, i int, sums array<long>")
    scatters: dict[int, dict[int, np.ndarray]] = {}
    for r in sums.groupBy("dim", "modulus", "i").applyInArrow(added, "dim int, modulus long, i int, sums array<long>").collect():  # a matrix for each modulus
        scatters.setdefault(r.dim, {}).setdefault(r.modulus, np.zeros((r.dim, r.dim), np.int64))[r.i] = r.sums
    models = broadcast(spark, {dim: Model(fits[dim], reconstructed(residues), components) for dim, residues in scatters.items()})
    error: dict[int, float] = {}
    for r in map_batches(fit, lambda batches: products(models, batches), "dim int, i int, j int, sum double").groupBy("dim", "i", "j").agg(F.sum("sum").alias("sum")).collect():  # components squared
        error[r.dim] = max(error.get(r.dim, 0.0), abs(r["sum"] / fits[r.dim].n - (r.i == r.j)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in by_dimension(batch):
                model = models.value[dim]
                y = model.fit.centred(matrix(own.column(own.schema.get_field_index("x")), dim))
                w = model.whitened(y)
                m, c = w.shape
                each = pa.array(np.repeat(np.arange(m), c))
                deviation = pa.array(model.fit.deviations(y), pa.decimal128(38, 0))
                constant = lambda v, t: pa.array([v] * (m * c), t)  # noqa: E731, B023
                columns = [own.column(0).take(each), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), constant(model.fit.n, pa.int64()), deviation.take(each)]
                yield pa.record_batch([*columns, pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(model.explained, m)), constant(error.get(dim), pa.float64())], ["k", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = map_batches(rows, run, f"k {type_of(df, key)}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all embeddings, 16 components. A deviation that no long can hold is null."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
