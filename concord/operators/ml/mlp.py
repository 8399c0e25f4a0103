"""A small multilayer perceptron, learned by parties and averaged layer by layer.

A step is one pass: each task adds up the gradient of its rows by party (numpy
on Arrow batches), Spark sums the parts by party and place, and the driver, which
sees as many numbers as the network has, moves the weights.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.stats import PARTY
from concord.types import require_columns

TASKS = ("regression", "binary", "multiclass")


def first_weights(sizes: list[int], seed: int) -> list[float]:
    """Uniform within 1 / sqrt(inputs), layer by layer: a layer's matrix by rows, then its biases."""
    rng = np.random.default_rng(seed)
    return [float(v) for a, b in zip(sizes, sizes[1:], strict=False) for v in rng.uniform(-1, 1, (a + 1) * b) / np.sqrt(a)]


def layers(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def forward(x: np.ndarray, weights: np.ndarray, sizes: list[int], task: str) -> list[np.ndarray]:
    """The values of each layer; ReLU inside, then nothing, a sigmoid or a softmax."""
    out = [x]
    parts = layers(weights, sizes)
    for i, (w, b) in enumerate(parts):
        z = out[-1] @ w + b
        if i + 1 < len(parts):
            out.append(np.maximum(z, 0.0))
        elif task == "binary":
            out.append(1 / (1 + np.exp(-z)))
        elif task == "multiclass":
            e = np.exp(z - z.max(1, keepdims=True))
            out.append(e / e.sum(1, keepdims=True))
        else:
            out.append(z)
    return out


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, sizes: list[int], task: str) -> np.ndarray:
    """Summed gradient of squared error (halved) or cross-entropy."""
    values = forward(x, weights, sizes, task)
    want = np.eye(sizes[-1])[y.astype(int)] if task == "multiclass" else y[:, None]
    d, out = values[-1] - want, []
    parts = layers(weights, sizes)
    for i in range(len(parts) - 1, -1, -1):
        out[:0] = [(values[i].T @ d).ravel(), d.sum(0)]
        if i:
            d = (d @ parts[i][0].T) * (values[i] > 0)
    return np.concatenate(out)


@dataclass
class Mlp:
    features: list[str]
    sizes: list[int]
    task: str
    weights: list[float]

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Adds the value, the probability of 1 or, for more classes, the class and all probabilities."""
        sizes, task, w, many = self.sizes, self.task, np.array(self.weights), len(self.features)

        @F.pandas_udf("array<double>")
        def run(x):  # noqa: ANN001
            import pandas as pd

            a = np.stack(x.to_numpy()) if len(x) else np.empty((0, many))
            return pd.Series(list(forward(a.astype(float), w, sizes, task)[-1]))

        run.__annotations__ = {}
        out = df.withColumn(f"{name}_all", run(F.array(*(F.col(c).cast("double") for c in self.features))))
        if task == "multiclass":
            return out.withColumn(name, (F.array_position(f"{name}_all", F.array_max(f"{name}_all")) - 1).cast("int"))
        return out.withColumn(name, F.get(f"{name}_all", F.lit(0))).drop(f"{name}_all")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Mlp":
        return cls(**json.loads(text))


def fit_mlp(
    df: DataFrame, features: list[str], label: str, hidden: list[int], task: str = "binary", classes: int = 1, rounds: int = 5, local_epochs: int = 1, rate: float = 0.1,
    seed: int = 0, weighted: bool = True,
) -> Mlp:
    """Rounds of local epochs by party (column _party; without one there is a single party), then the mean of the parties' weights, by examples or unweighted."""
    if task not in TASKS:
        raise ValueError(f"no such task: {task}")
    require_columns(df, [*features, label])
    sizes = [len(features), *hidden, classes if task == "multiclass" else 1]
    party = F.col(PARTY).cast("string") if PARTY in df.columns else F.lit("")
    view = df.select(party.alias("party"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(label).cast("double").alias("y")).persist()
    model = Mlp(list(features), sizes, task, first_weights(sizes, seed))

    def step(own: dict[str, np.ndarray]) -> None:
        def run(frames):
            sums: dict[str, np.ndarray] = {}
            for b in frames:
                names = np.array(b.column(0).to_pylist(), object)
                x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(features))])
                y = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
                for p in sorted(set(names)):
                    at = names == p
                    sums[p] = sums.get(p, 0.0) + gradient(x[at], y[at], own[p], sizes, task)
            for p, g in sums.items():
                yield pa.RecordBatch.from_pydict({"party": [p], "g": pa.array([g.tolist()], pa.list_(pa.float64()))})

        parts = view.mapInArrow(run, "party string, g array<double>").select("party", F.posexplode("g").alias("i", "g"))
        for r in parts.groupBy("party", "i").agg(F.sum("g").alias("g")).groupBy("party").agg(F.array_sort(F.collect_list(F.struct("i", "g"))).alias("g")).collect():
            own[r.party] = own[r.party] - rate * np.array([v.g for v in r.g]) / counts[r.party]

    try:
        counts = {r.party: r.n for r in view.groupBy("party").agg(F.count("*").alias("n")).collect()}  # a row a party
        for _ in range(rounds):
            own = {p: np.array(model.weights) for p in counts}
            for _ in range(local_epochs):
                step(own)
            share = {p: n if weighted else 1 for p, n in counts.items()}
            if own:
                model.weights = (sum(own[p] * share[p] for p in own) / sum(share.values())).tolist()
    finally:
        view.unpersist()
    return model
