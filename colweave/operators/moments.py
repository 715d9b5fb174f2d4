"""Linear models from one pass of moments: ridge, lasso, principal axes and cross-validation without reading the rows again."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.storage import map_batches

#: Partial results of tasks are put together this many groups at a time, then once more.
GROUPS = 32
FIELDS = "n double, weight double, mean array<double>, products array<double>, centre array<double>, squares array<double>, least array<double>, most array<double>"


def terms(columns: list[str], degree: int = 2) -> list[tuple[str, ...]]:
    """The products that a model sees: columns, and with degree 2 all products of two."""
    return [(c,) for c in columns] + [(a, b) for i, a in enumerate(columns) for b in columns[i:] if degree == 2]


def term(names: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a * b, (F.col(f"`{n}`") for n in names))


def expanded(x: np.ndarray, degree: int = 2) -> np.ndarray:
    """The terms of rows of columns."""
    return np.hstack([x, *(x[:, [i]] * x[:, [j]] for i in range(x.shape[1]) for j in range(i, x.shape[1]) if degree == 2)])


@dataclasses.dataclass
class Moments:
    """What rows of terms and a label, the last, leave behind: rows, weight, weighted means and products of deviations from them; unweighted means, squared deviations and extremes.

    All are kept about their own means, so that sums of large numbers don't swallow what differs.
    """

    n: float
    weight: float
    mean: np.ndarray
    products: np.ndarray
    centre: np.ndarray
    squares: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(x: np.ndarray, w: np.ndarray) -> Moments:
        weight = w.sum()
        mean = (w @ x) / weight if weight else np.zeros(x.shape[1])
        centred, centre = x - mean, x.mean(axis=0)
        return Moments(len(x), weight, mean, (centred * w[:, None]).T @ centred, centre, ((x - centre) ** 2).sum(axis=0), x.min(axis=0), x.max(axis=0))

    def __add__(self, other: Moments) -> Moments:
        n, weight = self.n + other.n, self.weight + other.weight
        apart, shift = other.mean - self.mean, other.centre - self.centre
        share = other.weight / weight if weight else 0.0
        return Moments(
            n, weight, self.mean + share * apart, self.products + other.products + np.outer(apart, apart) * (self.weight * share),
            self.centre + shift * (other.n / n), self.squares + other.squares + shift**2 * (self.n * other.n / n), np.minimum(self.least, other.least), np.maximum(self.most, other.most),
        )

    def scale(self) -> np.ndarray:
        """Norms of the columns about their weighted means, 1 for constant ones."""
        norm = np.sqrt(self.squares + self.n * (self.centre - self.mean) ** 2)[:-1]
        return np.where(norm > 0, norm, 1.0)

    def row(self) -> list:
        return [self.n, self.weight, self.mean, self.products.ravel(), self.centre, self.squares, self.least, self.most]

    @staticmethod
    def from_row(r) -> Moments:
        size = len(r["mean"])
        arrays = {f: np.array(r[f], dtype=np.float64) for f in ("mean", "products", "centre", "squares", "least", "most")}
        arrays["products"] = arrays["products"].reshape(size, size)
        return Moments(r["n"], r["weight"], **arrays)


def moments(df: DataFrame, columns: list[str], label: str, weight: str | None = None, fold: Column | None = None, degree: int = 2) -> dict[int, Moments]:
    """Moments of each fold (0 without one) by one scan. Rows with a null or NaN anywhere are left out.

    Each task gives a row for each fold, put together in two steps: what moves and what the driver sees are matrices of terms x terms, however many rows there are.
    """
    base = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    given = df.select(*base, F.col(f"`{label}`").cast("double").alias("y"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"), (F.lit(0) if fold is None else fold.cast("int")).alias("fold"))
    for c in given.columns:
        given = given.where(F.col(c).isNotNull() if c == "fold" else F.col(c).isNotNull() & ~F.isnan(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            values = np.column_stack([np.asarray(batch.column(i)) for i in range(len(columns) + 2)])
            x, y, w = values[:, :-2], values[:, -2:-1], values[:, -1]
            full = np.hstack([expanded(x, degree), y])
            folds = np.asarray(batch.column(batch.num_columns - 1))
            for k in np.unique(folds):
                own = Moments.of(full[folds == k], w[folds == k])
                found[int(k)] = found[int(k)] + own if int(k) in found else own
        task = TaskContext.get().partitionId()
        yield table([(k, task, *m.row()) for k, m in sorted(found.items())])

    def table(rows: list) -> pa.RecordBatch:
        lists = pa.list_(pa.float64())
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[lists] * 6]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["fold", "task", *(f.split()[0] for f in FIELDS.split(", "))])

    def together(arrow: pa.Table) -> pa.Table:
        rows = sorted(arrow.to_pylist(), key=lambda r: r["task"])  # the same sum whatever arrives first
        return pa.Table.from_batches([table([(rows[0]["fold"], rows[0]["task"], *functools.reduce(lambda a, b: a + b, map(Moments.from_row, rows)).row())])])

    schema = f"fold int, task int, {FIELDS}"
    parts = map_batches(given, run, schema)
    some = parts.groupBy("fold", F.pmod("task", F.lit(GROUPS)).alias("__group")).applyInArrow(together, schema)
    return {r["fold"]: Moments.from_row(r) for r in some.groupBy("fold").applyInArrow(together, schema).collect()}


@dataclasses.dataclass
class Linear:
    """A model of terms: an intercept and coefficients."""

    intercept: float
    coefficients: np.ndarray

    def predict(self, columns: list[str], degree: int = 2) -> Column:
        parts = (term(t) * F.lit(float(c)) for t, c in zip(terms(columns, degree), self.coefficients, strict=True))
        return functools.reduce(lambda a, b: a + b, parts, F.lit(float(self.intercept)))


def scaled(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of scaled terms with each other and with the label, and the scale."""
    s = m.scale()
    return m.products[:-1, :-1] / np.outer(s, s), m.products[:-1, -1] / s, s


def model(m: Moments, scaled_coefficients: np.ndarray, scale: np.ndarray) -> Linear:
    own = scaled_coefficients / scale
    return Linear(float(m.mean[-1] - m.mean[:-1] @ own), own)


def ridge(m: Moments, alphas: list[float]) -> list[Linear]:
    """Ridge models on columns that are centred and scaled by their norms, one for each penalty, from one decomposition."""
    gram, towards, scale = scaled(m)
    values, vectors = np.linalg.eigh(gram)
    turned = vectors.T @ towards
    return [model(m, vectors @ (turned / (np.maximum(values, 0) + a)), scale) for a in alphas]


def lasso(m: Moments, penalty: float, rounds: int = 10_000, tolerance: float = 1e-12) -> Linear:
    """Half the mean squared error plus `penalty` times the sizes of coefficients, on columns centred and scaled by their norms, by coordinate descent."""
    gram, towards, scale = scaled(m)
    limit, b = penalty * m.weight, np.zeros(len(towards))
    for _ in range(rounds):
        most = 0.0
        for i in range(len(b)):
            if gram[i, i] > 0:
                rest = towards[i] - gram[i] @ b + gram[i, i] * b[i]
                new = np.sign(rest) * max(abs(rest) - limit, 0.0) / gram[i, i]
                most, b[i] = max(most, abs(new - b[i])), new
        if most <= tolerance * max(1.0, np.abs(b).max()):
            break
    return model(m, b, scale)


@dataclasses.dataclass
class Axes:
    """Principal axes of terms, each a row with its largest entry positive, their variances, and where they cross."""

    variances: np.ndarray
    axes: np.ndarray
    centre: np.ndarray
    total: float

    def project(self, columns: list[str], degree: int = 1) -> list[Column]:
        own = terms(columns, degree)
        return [functools.reduce(lambda a, b: a + b, ((term(t) - F.lit(float(c))) * F.lit(float(v)) for t, c, v in zip(own, self.centre, axis, strict=True))) for axis in self.axes]


def principal_axes(m: Moments, k: int | None = None, by_range: bool = False) -> Axes:
    """Of the covariance of the terms; by_range: of terms stretched to 0 to 1."""
    wide = np.where(m.most > m.least, m.most - m.least, 1.0)[:-1] if by_range else np.ones(len(m.mean) - 1)
    covariance = m.products[:-1, :-1] / np.outer(wide, wide) / max(m.weight - 1, 1)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:k]
    axes = vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Axes(np.maximum(values[order], 0), axes / wide, m.mean[:-1], float(np.trace(covariance)))


def squared_error(m: Moments, fitted: Linear) -> float:
    """The weighted sum of squared errors of a model on the rows that left these moments."""
    b = fitted.coefficients
    off = m.mean[-1] - fitted.intercept - m.mean[:-1] @ b
    return float(m.products[-1, -1] - 2 * b @ m.products[:-1, -1] + b @ m.products[:-1, :-1] @ b + m.weight * off * off)


def folds_left_out(parts: dict[int, Moments], alphas: list[float]) -> list[tuple[int, float, float, float]]:
    """(fold, alpha, weight, squared error) of ridge models that are fitted without a fold, on that fold: all from the moments of one scan."""
    out = []
    for k, own in sorted(parts.items()):
        others = [m for j, m in sorted(parts.items()) if j != k]
        if others:
            rest = functools.reduce(lambda a, b: a + b, others)
            out += [(k, a, float(own.weight), squared_error(own, fitted)) for a, fitted in zip(alphas, ridge(rest, alphas))]
    return out
