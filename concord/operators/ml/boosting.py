"""Boosted trees, grown level by level; each level is one aggregate over (node, feature, bucket).

Rows carry bucket numbers, their margin and node; per level Spark sums
gradients and hessians by node and bucket for all features at once, and the
driver, which sees only those sums, takes the best split of each node.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.files import remove, scratch, stored
from concord.functions.scalar import sigmoid
from concord.types import present, require_columns

OBJECTIVES = ("linear", "logistic")
CODE = 32  # bits for a bucket below the number of its feature


@dataclass
class Boosted:
    """trees: each a list of nodes {feature, cut, left, right} or {leaf}."""

    objective: str
    features: list[str]
    base: float
    rate: float
    trees: list = field(default_factory=list)

    def tree(self, nodes: list[dict], at: int = 0) -> Column:
        n = nodes[at]
        if "leaf" in n:
            return F.lit(float(n["leaf"]))
        # Missing values go left.
        return F.when(present(n["feature"]) > n["cut"], self.tree(nodes, n["right"])).otherwise(self.tree(nodes, n["left"]))

    def margin(self) -> Column:
        return reduce(lambda a, t: a + self.rate * self.tree(t), self.trees, F.lit(self.base))

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Adds the value or probability; logistic ones also a label, 1 from 0.5 on."""
        if self.objective == "linear":
            return df.withColumn(name, self.margin())
        return df.withColumn(name, sigmoid(self.margin())).withColumn(f"{name}_label", (F.col(name) >= 0.5).cast("int"))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Boosted":
        return cls(**json.loads(text))


def cut_points(df: DataFrame, features: list[str], bins: int, uniform: bool = False) -> dict[str, list[float]]:
    """Quantiles of each feature, distinct, but for the largest; uniform: equal steps from least to largest."""
    if uniform:
        row = df.agg(*(f(present(c)).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max)))).first()
        ends = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(features)}
        return {c: [lo + (hi - lo) * k / bins for k in range(1, bins)] if lo is not None and hi > lo else [] for c, (lo, hi) in ends.items()}
    row = df.agg(*(F.percentile_approx(present(c), [i / bins for i in range(1, bins)], 10_000).alias(c) for c in features), *(F.max(present(c)).alias(f"_max_{c}") for c in features)).first()
    return {c: [v for v in sorted(set(row[c] or [])) if v < row[f"_max_{c}"]] for c in features}


def gain(gl: float, hl: float, g: float, h: float, l2: float, gamma: float) -> float:
    """What a split adds: half of the children's scores less the parent's, less gamma."""
    gr, hr = g - gl, h - hl
    return (gl * gl / (hl + l2) + gr * gr / (hr + l2) - g * g / (h + l2)) / 2 - gamma


def train(
    df: DataFrame, features: list[str], label: str, objective: str = "logistic", trees: int = 5, depth: int = 3, rate: float = 0.3, l2: float = 1.0, gamma: float = 0.0,
    bins: int = 32, min_child_weight: float = 1.0, min_child_sample: int = 1, column_share: float = 1.0, row_share: float = 1.0, goss: tuple[float, float] | None = None, seed: int = 0, uniform: bool = False, written: int = 8,
    cuts: dict[str, list[float]] | None = None,
) -> Boosted:
    """goss: (top, other): rows with the largest gradients by share, and a share of the others, whose g and h are scaled up alike.

    Rows keep their margin; each tree adds to it, and after every ``written``
    trees rows are written to the shared folder, so plans stay short. cuts: cut
    points that are known already, by feature, ascending.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"no such objective: {objective}")
    if not label:
        raise ValueError("a label is needed")
    require_columns(df, [*features, label])
    import random

    rng = random.Random(seed)
    cuts = cut_points(df, features, bins, uniform) if cuts is None else {c: cuts[c] for c in features}
    bucket = bucketed(df, cuts)
    rows = df.select(F.col(label).cast("double").alias("_y"), *(present(c).alias(c) for c in features), *(b.cast("short").alias(f"_b_{c}") for c, b in bucket.items())).where("_y IS NOT NULL").persist()
    base = rows.agg(F.avg("_y")).first()[0] or 0.0 if objective == "linear" else 0.0
    model = Boosted(objective, features, base, rate)
    folder = scratch(df.sparkSession, "boosting") if trees > written else ""
    rows, kept = rows.withColumn("_m", F.lit(float(base))), rows
    try:
        for t in range(trees):
            chosen = features if column_share >= 1 else rng.sample(features, max(1, round(column_share * len(features))))
            m = F.col("_m")
            g, h = (m - F.col("_y"), F.lit(1.0)) if objective == "linear" else (sigmoid(m) - F.col("_y"), sigmoid(m) * (1 - sigmoid(m)))
            now = rows.withColumns({"_g": g, "_h": h, "_w": F.lit(1.0)})
            if row_share < 1:
                now = now.sample(row_share, seed + t)
            if goss:
                top, other = goss
                limit = now.agg(F.percentile_approx(F.abs("_g"), 1 - top, 10_000)).first()[0]
                keep = F.abs("_g") >= limit
                now = now.where(keep | (F.rand(seed + t) < other / (1 - top))).withColumn("_w", F.when(keep, 1.0).otherwise((1 - top) / other))
            model.trees.append(_grow(now, chosen, cuts, depth, l2, gamma, min_child_weight, min_child_sample))
            rows = rows.withColumn("_m", F.col("_m") + rate * model.tree(model.trees[-1]))
            if (t + 1) % written == 0 and t + 1 < trees:
                rows = stored(rows, f"{folder}/{t}")
                remove(f"{folder}/{t - written}")
    finally:
        kept.unpersist()
    return model


def gradient_sums(rows: DataFrame, features: list[str], g: str = "g", h: str = "h", node: str = "node") -> DataFrame:
    """node, feature (its place), bucket, g, h and n: sums by node and bucket of all features in one aggregate. Bucket columns are _b_<feature>."""
    # Whole numbers for feature and bucket: an array of those needs no object for each row and feature.
    stacked = F.explode(F.array(*(F.lit(i << CODE).cast("long") + F.col(f"_b_{c}").cast("long") for i, c in enumerate(features))))
    sums = rows.select(F.col(node).alias("node"), F.col(g).alias("g"), F.col(h).alias("h"), stacked.alias("x"))
    got = sums.groupBy("node", "x").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    return got.select("node", F.shiftright("x", CODE).cast("int").alias("f"), F.col("x").bitwiseAND(F.lit((1 << CODE) - 1)).cast("int").alias("b"), "g", "h", "n")


def bucketed(df: DataFrame, cuts: dict[str, list[float]]) -> dict[str, Column]:
    """Bucket of each feature: how many of its (ascending) cut points lie below it, by bisection; a missing value is in the first."""

    def place(c: str, lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(c).cast("double") > cuts[c][mid], place(c, mid + 1, hi)).otherwise(place(c, lo, mid))

    return {c: F.when(present(c).isNull(), 0).otherwise(place(c, 0, len(v))) for c, v in cuts.items()}


def _grow(rows: DataFrame, features: list[str], cuts: dict, depth: int, l2: float, gamma: float, least_weight: float, least_rows: int) -> list[dict]:
    """A tree, with one aggregate a level; the last level's leaves come from the sums by which their parents were split."""
    nodes: list[dict] = [{}]
    open_nodes = [0]
    leaf = lambda g, h: {"leaf": -g / (h + l2) if h + l2 else 0.0}
    for level in range(max(1, depth)):
        at = _route(nodes)
        w = F.col("_w")
        here = rows.withColumns({"node": at, "g": F.col("_g") * w, "h": F.col("_h") * w}).where(F.col("node").isin(open_nodes))
        got = gradient_sums(here, features).collect()  # nodes x features x buckets
        cells: dict = {}
        for r in got:
            cells.setdefault(r.node, {}).setdefault(r.f, []).append((r.b, r.g, r.h, r.n))
        following = []
        for k in open_nodes:
            by = cells.get(k, {0: []})
            one = next(iter(by.values()))
            g, h, n = (sum(x[i] for x in one) for i in (1, 2, 3))
            best = None
            for f, buckets in sorted(by.items()) if depth else ():
                gl = hl = nl = 0
                for b, bg, bh, bn in sorted(buckets)[:-1]:
                    gl, hl, nl = gl + bg, hl + bh, nl + bn
                    if min(hl, h - hl) < least_weight or min(nl, n - nl) < least_rows:
                        continue
                    v = gain(gl, hl, g, h, l2, gamma)
                    if v > 1e-12 and (best is None or v > best[0] + 1e-12):
                        best = (v, f, b)
            if best is None:
                nodes[k] = leaf(g, h)
            else:
                c = features[best[1]]
                nodes[k] = {"feature": c, "cut": cuts[c][best[2]], "bucket": best[2], "left": len(nodes), "right": len(nodes) + 1}
                following += [len(nodes), len(nodes) + 1]
                sides = [[x for x in by[best[1]] if (x[0] > best[2]) == right] for right in (False, True)]
                nodes += [leaf(*(sum(x[i] for x in side) for i in (1, 2))) if level + 1 == depth else {} for side in sides]
        open_nodes = following
        if not open_nodes:
            break
    return nodes


def _route(nodes: list[dict], at: int = 0) -> Column:
    n = nodes[at]
    if "feature" not in n:
        return F.lit(at)
    return F.when(F.col(f"_b_{n['feature']}") > n["bucket"], _route(nodes, n["right"])).otherwise(_route(nodes, n["left"]))
