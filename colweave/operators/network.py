"""A small dense network: gradients summed over partitions, weights sent out anew each round."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.storage import broadcast, map_batches, saved

#: Units of the hidden layers, between the inputs and the one output.
HIDDEN = (48, 12)
#: Partial gradients are added this many groups at a time, then once more.
GROUPS = 32


@dataclasses.dataclass
class Network:
    """Layers of weights and biases: rectified units inside, a tangent at the end, so outputs lie within -1 and 1. Inputs are stretched to 0 to 1 by the extremes they were fitted on."""

    columns: list[str]
    least: np.ndarray
    wide: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def start(columns: list[str], least: np.ndarray, most: np.ndarray, hidden: tuple[int, ...] = HIDDEN, seed: int = 0) -> Network:
        """Weights evenly drawn up to the root of 6 over a layer's inputs and outputs."""
        rng, sizes = np.random.default_rng(seed), (len(columns), *hidden, 1)
        layers = [(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
        return Network(columns, least, np.where(most > least, most - least, 1.0), layers)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The inputs as they were stretched, and what each layer gives."""
        out = [(x - self.least) / self.wide]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(np.tanh(z) if i == len(self.layers) - 1 else np.maximum(z, 0.0))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the sum of squared errors, by all weights and biases one behind the other; and that sum."""
        out = self.forward(x)
        error = out[-1][:, 0] - y
        back, parts = (2 * error * (1 - out[-1][:, 0] ** 2))[:, None], []
        for i in range(len(self.layers) - 1, -1, -1):
            parts.append(np.concatenate([(out[i].T @ back).ravel(), back.sum(axis=0)]))
            if i:
                back = (back @ self.layers[i][0].T) * (out[i] > 0)
        return np.concatenate(parts[::-1]), float(error @ error)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for layer in self.layers for v in layer])

    def moved(self, flat: np.ndarray) -> Network:
        layers, at = [], 0
        for w, b in self.layers:
            layers.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return dataclasses.replace(self, layers=layers)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the network's output, null where an input is. Built-in expressions only: weights are literals, so rows stay where they are and no worker is needed."""
        values: Column = F.array(*((F.col(f"`{c}`").cast("double") - float(a)) / float(w) for c, a, w in zip(self.columns, self.least, self.wide)))
        out, held = df, []
        for i, (w, b) in enumerate(self.layers):
            held.append(f"__layer{i}")
            out = out.withColumn(held[-1], values)
            values = layer(F.col(held[-1]), w, b, F.tanh if i == len(self.layers) - 1 else lambda v: F.greatest(v, F.lit(0.0)))
        return out.withColumn(name, values[0]).drop(*held)


def layer(inputs: Column, w: np.ndarray, b: np.ndarray, bent) -> Column:
    """What a layer gives for an array of inputs; null if one of them is."""
    units = F.array(*(F.struct(F.array(*(F.lit(float(v)) for v in row)).alias("w"), F.lit(float(v)).alias("b")) for row, v in zip(w.T, b)))
    weighed = lambda u: F.aggregate(F.zip_with(u["w"], inputs, lambda p, q: p * q), u["b"], lambda s, v: s + v)
    given = F.transform(units, lambda u: bent(weighed(u)))
    return F.when(F.exists(inputs, lambda v: v.isNull()), F.array(F.lit(None).cast("double"))).otherwise(given)


def fit(df: DataFrame, columns: list[str], label: str, rounds: int = 100, rate: float = 0.01, hidden: tuple[int, ...] = HIDDEN, seed: int = 0) -> tuple[Network, list[float]]:
    """A network and the mean squared error before each round. Rows with a null or NaN are left out.

    A round is one pass: weights go to all tasks, a task sends one gradient, gradients are added in two steps. Steps are as long as the root of a running mean of squared gradients
    allows (nine tenths of it kept). All rows take part in each round, so the result doesn't hang on how they are dealt, but for rounding.
    """
    given = df.select(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)), F.col(f"`{label}`").cast("double").alias("y"))
    for c in given.columns:
        given = given.where(F.col(c).isNotNull() & ~F.isnan(c))
    given = saved(given)
    row = given.agg(F.count("*").alias("n"), *(f(f"x{i}") for f in (F.min, F.max) for i in range(len(columns)))).first()
    n = row[0]
    if not n:
        raise ValueError("no rows to fit a network to")
    network = Network.start(columns, np.array(row[1 : 1 + len(columns)]), np.array(row[1 + len(columns) :]), hidden, seed)
    schema, mean, errors = "task int, gradient array<double>, error double", 0.0, []
    for _ in range(rounds):
        shared = broadcast(df.sparkSession, network)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total, error = 0.0, 0.0
            for batch in batches:
                values = np.column_stack([np.asarray(c) for c in batch.columns])
                g, e = shared.value.gradient(values[:, :-1], values[:, -1])
                total, error = total + g, error + e
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total]), pa.array([error])], ["task", "gradient", "error"])

        def together(arrow: pa.Table) -> pa.Table:
            rows = sorted(arrow.to_pylist(), key=lambda r: r["task"])
            return pa.table({"task": pa.array([rows[0]["task"]], pa.int32()), "gradient": [np.sum([r["gradient"] for r in rows], axis=0)], "error": [sum(r["error"] for r in rows)]})

        some = map_batches(given, run, schema).groupBy(F.pmod("task", F.lit(GROUPS)).alias("__group")).applyInArrow(together, schema)
        parts = sorted(some.collect(), key=lambda r: r.task)  # GROUPS rows of as many numbers as there are weights
        shared.destroy()
        gradient = np.sum([r.gradient for r in parts], axis=0) / n
        errors.append(sum(r.error for r in parts) / n)
        mean = 0.9 * mean + 0.1 * gradient**2
        network = network.moved(network.flat() - rate * gradient / (np.sqrt(mean) + 1e-7))
    return network, errors
