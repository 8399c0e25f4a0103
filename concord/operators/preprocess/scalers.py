"""Scalers: one aggregate to fit, arithmetic to transform. Missing values stay missing."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.preprocess.base import EPS, Module, aggregates, nonzero, replaced
from concord.operators.stats import row_norm_value
from concord.operators.stats import exact_quantiles
from concord.types import present


class MaxAbsScaler(Module):
    def _fit(self, df: DataFrame) -> dict:
        return {"scale": {c: nonzero(v) for c, v in aggregates(df, self.columns, {"m": lambda x: F.max(F.abs(x))})["m"].items()}}

    def transform(self, df: DataFrame) -> DataFrame:
        return replaced(df, {c: present(c) / s for c, s in self.state["scale"].items()})


class MinMaxScaler(Module):
    """feature_range=(0, 1), clip=False; a constant column goes to the range's start."""

    def _fit(self, df: DataFrame) -> dict:
        low, high = self.params.get("feature_range", (0.0, 1.0))
        if low >= high:
            raise ValueError("feature_range must rise")
        a = aggregates(df, self.columns, {"min": F.min, "max": F.max})
        scale = {c: (high - low) / nonzero((a["max"][c] or 0.0) - (a["min"][c] or 0.0), EPS) for c in self.columns}
        return {"scale": scale, "min": {c: low - (a["min"][c] or 0.0) * scale[c] for c in self.columns}, "range": [low, high]}

    def transform(self, df: DataFrame) -> DataFrame:
        low, high = self.state["range"]
        out = {c: present(c) * self.state["scale"][c] + self.state["min"][c] for c in self.columns}
        if self.params.get("clip"):
            out = {c: F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))) for c, v in out.items()}
        return replaced(df, out)


class Normalizer(Module):
    """Each row divided by its norm (l1, l2 or max) over all the columns; a zero row stays."""

    def transform(self, df: DataFrame) -> DataFrame:
        norm = row_norm_value([present(c) for c in self.columns], self.params.get("norm", "l2"))
        norm = F.when(norm == 0, 1.0).otherwise(norm)
        return replaced(df, {c: present(c) / norm for c in self.columns})


class StandardScaler(Module):
    """Mean and population deviation; a near-constant column is only centred."""

    def _fit(self, df: DataFrame) -> dict:
        a = aggregates(df, self.columns, {"mean": F.avg, "std": F.stddev_pop, "n": F.count})
        near = {c: (a["std"][c] or 0.0) <= a["n"][c] * EPS * max(1.0, abs(a["mean"][c] or 0.0)) for c in self.columns}
        return {"mean": {c: a["mean"][c] or 0.0 for c in self.columns}, "scale": {c: 1.0 if near[c] else a["std"][c] for c in self.columns}}

    def transform(self, df: DataFrame) -> DataFrame:
        mean = self.state["mean"] if self.params.get("with_mean", True) else dict.fromkeys(self.columns, 0.0)
        scale = self.state["scale"] if self.params.get("with_std", True) else dict.fromkeys(self.columns, 1.0)
        return replaced(df, {c: (present(c) - mean[c]) / scale[c] for c in self.columns})


class RobustScaler(Module):
    """Median and a range of quantiles (in percent); unit_variance makes the range that of a normal variable of variance 1."""

    def _fit(self, df: DataFrame) -> dict:
        low, high = self.params.get("quantile_range", (25.0, 75.0))
        if not 0 <= low <= high <= 100:
            raise ValueError("quantile_range lies in [0, 100] and rises")
        got = exact_quantiles(df, self.columns, [low / 100, 0.5, high / 100])
        unit = NormalDist().inv_cdf(high / 100) - NormalDist().inv_cdf(low / 100) if self.params.get("unit_variance") else 1.0
        return {"center": {c: q[1] if q else 0.0 for c, q in got.items()}, "scale": {c: nonzero(q[2] - q[0] if q else None, EPS) / unit for c, q in got.items()}}

    def transform(self, df: DataFrame) -> DataFrame:
        return replaced(df, {c: (present(c) - self.state["center"][c]) / self.state["scale"][c] for c in self.columns})
