"""Linear and logistic models by gradient descent, over all rows, by party, or privately.

One step over all rows is one aggregate: each partition adds up its gradient and
Spark combines them. In federated averaging a step of all parties is one aggregate by party,
and the weights of parties are averaged by their examples.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.scalar import piecewise_sigmoid, sigmoid
from concord.operators.stats import PARTY
from concord.types import require_columns


#: What a step takes for the prediction. taylor is the sigmoid's tangent at 0, which needs no more than sums and products.
LINKS = {"linear": lambda z: z, "logistic": sigmoid, "piecewise": piecewise_sigmoid, "taylor": lambda z: 0.5 + z / 4}


@dataclass
class LinearModel:
    """kind linear, logistic, piecewise or taylor (logistic with a simpler link in its steps); weights end with the bias; classes over 2: a row of weights each."""

    kind: str
    features: list[str]
    weights: list = field(default_factory=list)
    classes: int = 2
    epsilon: float | None = None

    def margin(self, w: list[float] | None = None) -> Column:
        w = self.weights if w is None else w
        out = F.lit(float(w[-1]))
        for c, v in zip(self.features, w, strict=False):
            out = out + F.col(c).cast("double") * float(v)
        return out

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Adds the predicted value, probability or, for more classes, class and probabilities."""
        if self.classes > 2:
            own = f"_{name}_share_"
            parts = [F.col(f"{own}{k}") for k in range(self.classes)]
            out = self.shares(df, own).withColumn(f"{name}_all", F.array(*parts)).drop(*(f"{own}{k}" for k in range(self.classes)))
            return out.withColumn(name, (F.array_position(F.col(f"{name}_all"), F.array_max(f"{name}_all")) - 1).cast("int"))
        link = sigmoid if self.kind == "taylor" else LINKS[self.kind]
        return df.withColumn(name, link(self.margin()))

    def shares(self, df: DataFrame, name: str) -> DataFrame:
        """df with each class's probability as a column of its own, <name>0 and so on; plain columns are compiled, functions over arrays are not."""
        at = [f"{name}{k}" for k in range(self.classes)]
        z = df.withColumns({n: self.margin(w) for n, w in zip(at, self.weights, strict=True)})
        e = z.withColumn(f"{name}_most", F.greatest(*at)).withColumns({n: F.exp(F.col(n) - F.col(f"{name}_most")) for n in at})
        whole = e.withColumn(f"{name}_most", sum((F.col(n) for n in at[1:]), F.col(at[0])))
        return whole.withColumns({n: F.col(n) / F.col(f"{name}_most") for n in at}).drop(f"{name}_most")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "LinearModel":
        return cls(**json.loads(text))


def _gradient(model: LinearModel, label: str, clip: float | None) -> list[Column]:
    """Summed loss, gradient and rows; with clip each row's gradient is cut to that length."""
    y = F.col(label).cast("double")
    x = [F.col(c).cast("double") for c in model.features] + [F.lit(1.0)]
    z = model.margin()
    link = LINKS[model.kind](z)
    err = link - y
    if clip is not None:
        length = F.sqrt(sum((v * v for v in x[1:]), x[0] * x[0])) * F.abs(err)
        err = err / F.greatest(F.lit(1.0), length / clip)
    loss = err * err / 2 if model.kind == "linear" else -(y * F.log(F.greatest(link, F.lit(1e-12))) + (1 - y) * F.log(F.greatest(1 - link, F.lit(1e-12))))
    return [F.sum(loss).alias("loss"), *(F.sum(err * v).alias(f"g{i}") for i, v in enumerate(x)), F.count(err).alias("n")]


def fit(
    df: DataFrame, features: list[str], label: str, kind: str = "linear", epochs: int = 50, rate: float = 0.1, l2: float = 0.0, batch: float = 1.0, seed: int = 0,
    clip: float | None = None, noise: float = 0.0, delta: float = 1e-5, tol: float = 0.0,
) -> LinearModel:
    """Gradient descent from zero weights; batch: share of rows for a step. With clip and noise: a private fit whose epsilon (at delta) is kept."""
    require_columns(df, [*features, label])
    if kind not in LINKS:
        raise ValueError(f"no such model: {kind}")
    view = df.select(*features, label).persist()
    model = LinearModel(kind, features, [0.0] * (len(features) + 1))
    rng, last = np.random.default_rng(seed), np.inf
    try:
        for k in range(epochs):
            rows = view if batch >= 1 else view.sample(batch, seed + k)
            got = rows.agg(*_gradient(model, label, clip)).first()
            if not got.n:
                continue
            g = np.array([got[f"g{i}"] for i in range(len(features) + 1)])
            if clip is not None and noise:
                g = g + rng.normal(0, noise * clip, len(g))
            w = np.array(model.weights)
            decay = l2 * np.append(w[:-1], 0.0)
            model.weights = (w - rate * (g / got.n + decay)).tolist()
            if tol and abs(last - got.loss / got.n) < tol:
                break
            last = got.loss / got.n
    finally:
        view.unpersist()
    if clip is not None and noise:
        model.epsilon = private_epsilon(min(batch, 1.0), noise, epochs, delta)
    return model


def fit_softmax(df: DataFrame, features: list[str], label: str, classes: int, epochs: int = 50, rate: float = 0.1, l2: float = 0.0) -> LinearModel:
    """Softmax regression for labels 0 to classes - 1."""
    model = LinearModel("logistic", features, [[0.0] * (len(features) + 1) for _ in range(classes)], classes)
    names = [f"x{i}" for i in range(len(features))]
    x = [*(F.col(n) for n in names), F.lit(1.0)]
    view = df.select(*(F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)), F.col(label).alias("y")).persist()
    inner = LinearModel("logistic", names, model.weights, classes)
    try:
        for _ in range(epochs):
            err = [F.col(f"p{k}") - (F.col("y") == k).cast("double") for k in range(classes)]
            got = inner.shares(view, "p").agg(F.count("*").alias("n"), *(F.sum(e * v).alias(f"g{k}_{i}") for k, e in enumerate(err) for i, v in enumerate(x))).first()
            for k, w in enumerate(model.weights):
                model.weights[k] = [v - rate * (got[f"g{k}_{i}"] / got.n + (l2 * v if i < len(features) else 0.0)) for i, v in enumerate(w)]
    finally:
        view.unpersist()
    return model


def private_epsilon(share: float, noise: float, steps: int, delta: float) -> float:
    """Epsilon of noisy gradient steps, by Renyi accounting: the Gaussian mechanism, with amplification by subsampling at integer orders."""
    from math import comb, exp, log

    best = float("inf")
    for a in [*range(2, 64), 128, 256]:
        if share >= 1:
            rdp = a / (2 * noise**2)
        else:
            terms = [comb(a, k) * (1 - share) ** (a - k) * share**k * exp(min(700, (k * k - k) / (2 * noise**2))) for k in range(a + 1)] if a <= 63 else None
            if terms is None:
                continue
            rdp = log(sum(terms)) / (a - 1)
        best = min(best, steps * rdp + log(1 / delta) / (a - 1))
    return best


def fedavg(
    df: DataFrame, features: list[str], label: str, kind: str = "linear", rounds: int = 5, local_epochs: int = 1, rate: float = 0.1, l2: float = 0.0, batches: int = 1,
    weighted: bool = True,
) -> LinearModel:
    """Rounds of local epochs by party (column _party), then the mean of the parties' weights, by examples or unweighted.

    An epoch takes a party's rows in ``batches`` steps; the step of a row comes
    from a hash of it. Each step is one aggregate over all parties at once, so
    the result depends on the data alone, and a large party is spread over tasks.
    """
    require_columns(df, [*features, label, PARTY])
    model = LinearModel(kind, features, [0.0] * (len(features) + 1))
    view = df.select(PARTY, *(F.col(c).cast("double").alias(c) for c in features), F.col(label).cast("double").alias("_y"))
    view = view.withColumn("_step", F.pmod(F.xxhash64(*features, "_y"), F.lit(batches))).persist()
    names = [f"_w{i}" for i in range(len(features) + 1)]
    try:
        sizes = {r[0]: r.n for r in view.groupBy(PARTY).agg(F.count("*").alias("n")).collect()}  # a row a party
        for _ in range(rounds):
            own = {p: list(model.weights) for p in sizes}
            for step in range(local_epochs * batches):
                held = df.sparkSession.createDataFrame([(p, *map(float, w)) for p, w in own.items()], f"{PARTY} string, " + ", ".join(f"{n} double" for n in names))
                rows = view.where(F.col("_step") == step % batches).join(F.broadcast(held), PARTY)  # a row a party
                x = [*(F.col(c) for c in features), F.lit(1.0)]
                z = sum((F.col(n) * v for n, v in zip(names[:-1], x, strict=False)), F.col(names[-1]))
                err = LINKS[kind](z) - F.col("_y")
                for r in rows.groupBy(PARTY).agg(*(F.avg(err * v).alias(f"g{i}") for i, v in enumerate(x))).collect():
                    own[r[PARTY]] = [w - rate * (r[f"g{i}"] + (l2 * w if i < len(features) else 0.0)) for i, w in enumerate(own[r[PARTY]])]
            share = {p: n if weighted else 1 for p, n in sizes.items()}
            model.weights = [sum(own[p][i] * share[p] for p in own) / sum(share.values()) for i in range(len(names))] if own else model.weights
    finally:
        view.unpersist()
    return model


def fit_vertical(parties: list[DataFrame], key: str, features: list[str], label: str, **options) -> LinearModel:
    """Parties hold columns of the same rows; the joint gradient over the join on the key is what they would exchange."""
    from concord.functions.expression import joined

    return fit(joined(parties, key), features, label, **options)
