"""Missing values by column statistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.preprocess.base import Module, aggregates, replaced
from concord.operators.stats import exact_quantiles
from concord.types import is_numeric, present

STRATEGIES = ("mean", "median", "most_frequent", "constant")


class SimpleImputer(Module):
    """strategy, fill_value, missing_values (besides NULL and NaN), add_indicator, keep_empty_features."""

    def _value(self, df: DataFrame, c: str) -> Column:
        v = present(c) if is_numeric(df.schema[c].dataType) else F.col(c)
        also = self.params.get("missing_values")
        return v if also is None else F.when(v != F.lit(also), v)

    def _fit(self, df: DataFrame) -> dict:
        how = self.params.get("strategy", "mean")
        if how not in STRATEGIES:
            raise ValueError(f"no such strategy: {how}")
        numeric = {c: is_numeric(df.schema[c].dataType) for c in self.columns}
        if how in ("mean", "median") and not all(numeric.values()):
            raise ValueError(f"{how} needs numbers")
        if how == "constant":
            fill = {c: self.params.get("fill_value", 0.0 if numeric[c] else "missing_value") for c in self.columns}
        elif how == "most_frequent":
            # The least of the most frequent ones.
            fill = {}
            for c in self.columns:
                top = df.select(self._value(df, c).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").first()
                fill[c] = top.v if top else None
        else:
            view = df.select([self._value(df, c).alias(c) for c in self.columns])
            fill = aggregates(view, self.columns, {"v": F.avg})["v"] if how == "mean" else {c: v[0] for c, v in exact_quantiles(view, self.columns, [0.5]).items()}
        row = df.agg(*(F.count(self._value(df, c)).alias(str(i)) for i, c in enumerate(self.columns)), F.count("*").alias("n")).first()
        return {"fill": fill, "seen": {c: row[str(i)] for i, c in enumerate(self.columns)}, "rows": row.n}

    def transform(self, df: DataFrame) -> DataFrame:
        s, keep = self.state, self.params.get("keep_empty_features", False)
        empty = [c for c in self.columns if not s["seen"][c] and self.params.get("strategy") != "constant"]
        out = {c: F.coalesce(self._value(df, c), F.lit(s["fill"][c] if c not in empty else 0.0)) for c in self.columns if keep or c not in empty}
        marks = {f"missing_{c}": self._value(df, c).isNull().cast("int") for c in self.columns if self.params.get("add_indicator") and s["seen"][c] < s["rows"]}
        return replaced(df, out | marks).drop(*([] if keep else empty))
