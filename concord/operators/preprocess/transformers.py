"""Power, quantile and spline transforms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.preprocess.base import Module, aggregates, nonzero, replaced
from concord.operators.stats import exact_quantiles
from concord.types import present

GOLDEN = (3 - sqrt(5)) / 2


def minimise(f: Callable[[list[float]], list[float]], n: int, low: float, high: float, rounds: int = 40, tol: float = 1e-7) -> list[float]:
    """Least points of n functions of one variable at once, each in (low, high), by Brent's method.

    f takes a point for each function and gives the values; each call is one
    pass over the data, whatever n.
    """
    a, b = np.full(n, low), np.full(n, high)
    x = a + GOLDEN * (b - a)
    w = v = x.copy()
    fx = np.array(f(x.tolist()))
    fw = fv = fx.copy()
    d = e = np.zeros(n)
    for _ in range(rounds):
        m, t = (a + b) / 2, tol * np.abs(x) + 1e-11
        done = np.abs(x - m) <= 2 * t - (b - a) / 2
        if done.all():
            break
        # A parabola through x, w, v, where it lies inside and shrinks the steps.
        r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
        p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
        p, q = np.where(q > 0, -p, p), np.abs(q)
        ok = (np.abs(e) > t) & (np.abs(p) < np.abs(q * e / 2)) & (p > q * (a - x)) & (p < q * (b - x))
        section = np.where(x < m, b - x, a - x)
        e, d = np.where(ok, d, section), np.where(ok, p / np.where(q == 0, 1, q), GOLDEN * section)
        u = x + np.where(np.abs(d) >= t, d, np.copysign(t, d))
        fu = np.array(f(u.tolist()))
        better = fu <= fx
        a, b = np.where(better & (u >= x), x, np.where(~better & (u < x), u, a)), np.where(better & (u < x), x, np.where(~better & (u >= x), u, b))
        second = ~better & ((fu <= fw) | (w == x))
        third = ~better & ~second & ((fu <= fv) | (v == x) | (v == w))
        v, fv = np.where(better | second, w, np.where(third, u, v)), np.where(better | second, fw, np.where(third, fu, fv))
        w, fw = np.where(better, x, np.where(second, u, w)), np.where(better, fx, np.where(second, fu, fw))
        x, fx = np.where(better, u, x), np.where(better, fu, fx)
    return x.tolist()


def yeo_johnson(x: Column, l: float) -> Column:  # noqa: E741
    up = F.log1p(x) if abs(l) < 1e-12 else (F.pow(x + 1, F.lit(l)) - 1) / l
    down = -F.log1p(-x) if abs(l - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - l)) - 1) / (2 - l)
    return F.when(x >= 0, up).when(x < 0, down)


def box_cox(x: Column, l: float) -> Column:  # noqa: E741
    return F.log(x) if abs(l) < 1e-12 else (F.pow(x, F.lit(l)) - 1) / l


class PowerTransformer(Module):
    """method yeo-johnson or box-cox; lambda maximises the normal likelihood; standardize=True. One aggregate for each step of the search, for all columns together."""

    def _map(self, c: Column, l: float) -> Column:  # noqa: E741
        return yeo_johnson(c, l) if self.params.get("method", "yeo-johnson") == "yeo-johnson" else box_cox(c, l)

    def _fit(self, df: DataFrame) -> dict:
        method = self.params.get("method", "yeo-johnson")
        if method not in ("yeo-johnson", "box-cox"):
            raise ValueError(f"no such method: {method}")
        view = df.select([present(c).alias(c) for c in self.columns])
        if method == "box-cox" and any((v or 1) <= 0 for v in aggregates(view, self.columns, {"m": F.min})["m"].values()):
            raise ValueError("box-cox needs positive values")
        ratio = (lambda x: F.sum(F.signum(x) * F.log1p(F.abs(x)))) if method == "yeo-johnson" else (lambda x: F.sum(F.log(x)))
        known = aggregates(view, self.columns, {"logs": ratio, "n": F.count})

        def loss(points: list[float]) -> list[float]:
            row = view.agg(*(F.var_pop(self._map(F.col(c), p)).alias(str(i)) for i, (c, p) in enumerate(zip(self.columns, points, strict=True)))).first()
            out = []
            for i, (c, p) in enumerate(zip(self.columns, points, strict=True)):
                n, v = known["n"][c] or 0, row[str(i)]
                out.append(float("inf") if not v or v < 1e-300 else n / 2 * np.log(v) - (p - 1) * (known["logs"][c] or 0.0))
            return out

        view = view.persist()
        lambdas = dict(zip(self.columns, minimise(loss, len(self.columns), *self.params.get("bounds", (-5.0, 5.0))), strict=True))
        row = view.agg(*(f(self._map(F.col(c), l)).alias(f"{i}{n}") for i, (c, l) in enumerate(lambdas.items()) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        view.unpersist()
        return {"lambda": lambdas, "mean": {c: row[f"{i}m"] or 0.0 for i, c in enumerate(self.columns)}, "scale": {c: nonzero(row[f"{i}s"]) for i, c in enumerate(self.columns)}}

    def transform(self, df: DataFrame) -> DataFrame:
        s, out = self.state, {}
        for c in self.columns:
            v = self._map(present(c), s["lambda"][c])
            out[c] = (v - s["mean"][c]) / s["scale"][c] if self.params.get("standardize", True) else v
        return replaced(df, out)


def _vector(df: DataFrame, c: str, f: Callable[[np.ndarray], np.ndarray], kind: str) -> Column:
    """A numpy function of one column, on Arrow batches."""

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        v = f(x.to_numpy(float))
        return pd.Series(list(v) if v.ndim > 1 else v)

    return run(present(c))


class QuantileTransformer(Module):
    """n_quantiles=1000, output_distribution uniform or normal, subsample; ties go to the middle of their range."""

    def _fit(self, df: DataFrame) -> dict:
        n, how = self.params.get("n_quantiles", 1000), self.params.get("output_distribution", "uniform")
        if n < 2 or how not in ("uniform", "normal"):
            raise ValueError("n_quantiles is at least 2, the output uniform or normal")
        share = self.params.get("subsample")
        if share:
            if n > share:
                raise ValueError("n_quantiles is more than subsample")
            df = df.orderBy(F.rand(self.params.get("seed", 0))).limit(int(share))
        refs = np.linspace(0, 1, n).tolist()
        return {"refs": refs, "values": exact_quantiles(df, self.columns, refs)}

    def transform(self, df: DataFrame) -> DataFrame:
        refs, normal = np.array(self.state["refs"]), self.params.get("output_distribution") == "normal"
        out = {}
        for c in self.columns:
            values = np.array(self.state["values"][c])

            def at(x: np.ndarray, values=values) -> np.ndarray:
                y = (np.interp(x, values, refs) - np.interp(-x, -values[::-1], -refs[::-1])) / 2
                y = np.where(x <= values[0], 0.0, np.where(x >= values[-1], 1.0, y))
                y = np.where(np.isnan(x), np.nan, y)
                return _normal(y) if normal else y

            out[c] = present(_vector(df, c, at, "double"))
        return replaced(df, out)


def _normal(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    edge = 1e-7
    return np.array([np.nan if np.isnan(x) else inv(min(max(x, edge), 1 - edge)) for x in p])


def basis(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """All B-splines of the knots at x, by the Cox-de Boor recursion; the last interval is closed."""
    t = knots
    last = t[-degree - 1]
    inside = np.where(x == last, np.nextafter(last, -np.inf), x)
    b = ((inside[:, None] >= t[None, :-1]) & (inside[:, None] < t[None, 1:])).astype(float)
    for k in range(1, degree + 1):
        left, right = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        a = np.divide(x[:, None] - t[: -k - 1], left, out=np.zeros((len(x), len(left))), where=left > 0)
        c = np.divide(t[k + 1 :] - x[:, None], right, out=np.zeros((len(x), len(right))), where=right > 0)
        b = a * b[:, :-1] + c * b[:, 1:]
    return b


class SplineTransformer(Module):
    """n_knots=5, degree=3, knots uniform, quantile or {column: [...]}; extrapolation constant, linear, continue, periodic or error."""

    MODES = ("constant", "linear", "continue", "periodic", "error")

    def _fit(self, df: DataFrame) -> dict:
        n, degree, how = self.params.get("n_knots", 5), self.params.get("degree", 3), self.params.get("knots", "uniform")
        if n < 2 or degree < 0 or self.params.get("extrapolation", "constant") not in self.MODES:
            raise ValueError("n_knots is at least 2, degree at least 0, extrapolation one of " + ", ".join(self.MODES))
        if isinstance(how, dict):
            base = how
        elif how == "quantile":
            base = exact_quantiles(df, self.columns, np.linspace(0, 1, n).tolist())
        else:
            a = aggregates(df, self.columns, {"min": F.min, "max": F.max})
            base = {c: np.linspace(a["min"][c], a["max"][c], n).tolist() for c in self.columns}
        out = {}
        for c, k in base.items():
            if any(y <= x for x, y in zip(k, k[1:], strict=False)):
                raise ValueError(f"the knots of {c} do not rise")
            if self.params.get("extrapolation") == "periodic":
                period = k[-1] - k[0]
                k = [x - period for x in k[-degree - 1 : -1]] + k + [x + period for x in k[1 : degree + 1]]
            else:
                first, last = k[1] - k[0], k[-1] - k[-2]
                k = [k[0] - first * i for i in range(degree, 0, -1)] + k + [k[-1] + last * i for i in range(1, degree + 1)]
            out[c] = k
        return {"knots": out}

    def splines(self, c: str) -> int:
        n = len(self.state["knots"][c]) - self.params.get("degree", 3) - 1
        return n - self.params.get("degree", 3) if self.params.get("extrapolation") == "periodic" else n

    def _at(self, c: str, x: np.ndarray) -> np.ndarray:
        t, degree = np.array(self.state["knots"][c]), self.params.get("degree", 3)
        low, high, mode = t[degree], t[-degree - 1], self.params.get("extrapolation", "constant")
        missing = np.isnan(x)
        x = np.where(missing, low, x)
        if mode == "error" and ((x < low) | (x > high)).any():
            raise ValueError(f"{c} has values beyond the knots")
        if mode == "periodic":
            b = basis(low + np.mod(x - low, high - low), t, degree)
            b = np.concatenate((b[:, :degree] + b[:, len(b[0]) - degree :], b[:, degree : len(b[0]) - degree]), 1) if degree else b
        else:
            inside = np.clip(x, low, high)
            b = basis(inside, t, degree)
            if mode == "linear":
                h = (high - low) * 1e-6
                for edge, out, step in ((low, x < low, h), (high, x > high, -h)):
                    at = basis(np.array([edge, edge + step]), t, degree)
                    b[out] = at[0] + (x[out] - edge)[:, None] * (at[1] - at[0]) / step
            elif mode == "continue":
                for edge, out, step in ((low, x < low, 1), (high, x > high, -1)):
                    if out.any():
                        near = edge + step * np.linspace(0, abs(t[degree + 1] - low) * 0.9, degree + 1)
                        values = basis(near, t, degree)
                        b[out] = np.stack([np.polyval(np.polyfit(near - edge, y, degree), x[out] - edge) for y in values.T], 1)
        b[missing] = np.nan
        return b if self.params.get("include_bias", True) else b[:, :-1]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            many = self.splines(c) - (not self.params.get("include_bias", True))
            out = out.withColumn("_b", _vector(df, c, lambda x, c=c: self._at(c, x), "array<double>"))
            out = reduce(lambda d, i, c=c: d.withColumn(f"{c}_sp_{i}", present(F.get("_b", F.lit(i)))), range(many), out).drop("_b")
        return out.drop(*self.columns)
