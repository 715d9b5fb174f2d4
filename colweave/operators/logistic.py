"""Logistic models of products of columns, many at once: a step of all of them is one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.operators import moments as N
from colweave.storage import map_batches

#: Sums of tasks are put together this many groups at a time, then once more.
GROUPS = 32
#: A model is done when its next step would lower the mean loss by no more than this.
TOLERANCE = 1e-12


def nearest(b: np.ndarray, g: np.ndarray, h: np.ndarray, limit: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """The t for which g (t - b) + (t - b) h (t - b) / 2 + limit |t| is least: by coordinate descent until it has found which entries are zero and the others' signs, then by solving for those."""
    t, seen = b.copy(), np.diag(h) > 0
    for _ in range(rounds):
        for j in np.flatnonzero(seen):
            rest = h[j, j] * t[j] - g[j] - h[j] @ (t - b)
            t[j] = np.sign(rest) * max(abs(rest) - limit[j], 0.0) / h[j, j]
        free = seen & ((t != 0) | (limit == 0))
        solved = np.where(seen, 0.0, b)
        solved[free] = np.linalg.lstsq(h[np.ix_(free, free)], (h @ b - g - limit * np.sign(t))[free], rcond=None)[0]
        slope = g + h @ (solved - b)
        if np.all((np.sign(solved) == np.sign(t))[limit > 0]) and np.all(np.abs(slope[~free]) <= limit[~free] + 1e-15):
            return solved
    return t


class Descent:
    """A model on its way: Newton steps, halved as long as one doesn't lower the mean loss with its penalty."""

    def __init__(self, weights: np.ndarray, l1: bool):
        """weights: the penalty of each coefficient's size (l1) or half its square."""
        self.limit, self.square = (weights, np.zeros_like(weights)) if l1 else (np.zeros_like(weights), weights)
        self.at, self.trial, self.value = np.zeros_like(weights), np.zeros_like(weights), np.inf
        self.way, self.share, self.gain = np.zeros_like(weights), 1.0, 0.0

    def take(self, n: float, loss: float, g: np.ndarray, h: np.ndarray) -> bool:
        """What the rows say of the trial, as sums; whether the model is done."""
        b = self.trial
        value = loss / n + self.square @ b**2 / 2 + self.limit @ np.abs(b)
        if value > self.value + 1e-4 * self.share * self.gain + 1e-15:
            self.share /= 2
            self.trial = self.at + self.share * self.way
            return self.share < 1e-6
        slope = g / n + self.square * b
        target = nearest(b, slope, h / n + np.diag(self.square), self.limit)
        self.at, self.value, self.way, self.share = b, value, target - b, 1.0
        self.gain = slope @ self.way + self.limit @ (np.abs(target) - np.abs(b))
        self.trial = target
        if self.gain >= -TOLERANCE:
            self.at = target
            return True
        return False


def sums(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows, loss, gradient and second derivatives of a model."""
    z = x @ b
    p = np.exp(-np.logaddexp(0, -z))
    return np.concatenate([[len(x), (np.logaddexp(0, z) - y * z).sum()], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def fit(df: DataFrame, columns: list[str], label: str, wanted: list[tuple[int | None, float]], fold: str | None = None, l1: bool = True, degree: int = 2, rounds: int = 200) -> list[N.Linear]:
    """A model of the label, 0 or 1, for each wanted (fold that it doesn't see or None, c), whose predict() gives the log of the odds: the least mean loss with a penalty of 1 / (c n) on the
    sizes of coefficients (l1) or half their squares, n being the rows of all folds. Rows with a null or NaN are left out.

    df is read once for each step of all models, so it should be a stored table of few columns. Tasks give sums for each model, of as many numbers as its squared terms, which are added in two steps.
    """
    parts = N.moments(df, columns, label, fold=F.col(fold) if fold else None, degree=degree)
    if not parts:
        raise ValueError("no rows to fit a model to")
    if any(not 0 <= v <= 1 for m in parts.values() for v in (m.least[-1], m.most[-1])):
        raise ValueError("labels have to be 0 or 1")
    whole = sum((m for _, m in sorted(parts.items())[1:]), sorted(parts.items())[0][1])
    deviation = np.sqrt(whole.squares[:-1] / whole.n)
    mean, scale = whole.centre[:-1], np.where(deviation > 0, deviation, 1.0)
    models = [Descent(np.append(0.0, 1 / (c * whole.n) / (scale if l1 else scale**2)), l1) for _, c in wanted]
    left = {i for i, (k, _) in enumerate(wanted) if set(parts) - {k}}  # a model that sees no row stays at zero
    given = df.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)), F.col(f"`{label}`").cast("double").alias("y"), (F.col(f"`{fold}`").cast("int") if fold else F.lit(0)).alias("fold"))
    for c in given.columns:
        given = given.where(F.col(c).isNotNull() if c == "fold" else F.col(c).isNotNull() & ~F.isnan(c))
    schema = "model int, task int, sums array<double>"

    def record(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["model", "task", "sums"])

    def together(arrow: pa.Table) -> pa.Table:
        rows = sorted(arrow.to_pylist(), key=lambda r: r["task"])  # the same sum whatever arrives first
        return pa.Table.from_batches([record([(rows[0]["model"], rows[0]["task"], np.sum([r["sums"] for r in rows], axis=0))])])

    for _ in range(rounds):
        if not left:
            break
        trials = [(i, wanted[i][0], models[i].trial) for i in sorted(left)]

        def run(batches: Iterator[pa.RecordBatch], trials=trials) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                values = np.column_stack([np.asarray(c) for c in batch.columns[:-1]])
                folds, y = np.asarray(batch.column(batch.num_columns - 1)), values[:, -1]
                x = np.column_stack([np.ones(len(y)), (N.expanded(values[:, :-1], degree) - mean) / scale])
                for i, k, b in trials:
                    own = np.full(len(y), True) if k is None else folds != k
                    found[i] = found.get(i, 0.0) + sums(x[own], y[own], b)
            task = TaskContext.get().partitionId()
            yield record([(i, task, s) for i, s in found.items()])

        some = map_batches(given, run, schema).groupBy("model", F.pmod("task", F.lit(GROUPS)).alias("__group")).applyInArrow(together, schema)
        rows = sorted(some.collect(), key=lambda r: r.task)  # GROUPS rows of a model at most
        for i in sorted(left):
            total = np.sum([r.sums for r in rows if r.model == i], axis=0)
            size = len(mean) + 1
            if models[i].take(total[0], total[1], total[2 : 2 + size], total[2 + size :].reshape(size, size)):
                left.remove(i)
    if left:
        raise RuntimeError(f"{len(left)} models haven't settled after {rounds} steps")
    return [N.Linear(float(m.at[0] - m.at[1:] / scale @ mean), m.at[1:] / scale) for m in models]
