"""Discretizer and encoders. Categories are counted by Spark; a module keeps its categories, not rows."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.preprocess.base import Module, aggregates, category, mapped, replaced
from concord.operators.stats import exact_quantiles
from concord.types import is_numeric, present


def counts(df: DataFrame, columns: list[str]) -> dict[str, list[tuple[str, int]]]:
    """Present values of each column as text with their counts; numbers in order of value, texts in order of text."""
    out: dict[str, list] = {c: [] for c in columns}
    parts = [df.select(F.lit(c).alias("c"), category(df, c).alias("v")) for c in columns]
    rows = reduce(lambda a, b: a.unionByName(b), parts).where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    for r in rows.toLocalIterator():
        out[r.c].append((r.v, r.n))
    for c in columns:
        out[c].sort(key=(lambda x: float(x[0])) if is_numeric(df.schema[c].dataType) else (lambda x: x[0]))
    return out


class KBinsDiscretizer(Module):
    """n_bins=5, strategy uniform or quantile, encode ordinal or onehot; a constant column has one bin."""

    def _fit(self, df: DataFrame) -> dict:
        n, how = self.params.get("n_bins", 5), self.params.get("strategy", "quantile")
        if n < 2:
            raise ValueError("n_bins is at least 2")
        if how not in ("uniform", "quantile"):
            raise ValueError(f"no such strategy: {how}")
        share = self.params.get("subsample")
        if share:
            df = df.orderBy(F.rand(self.params.get("seed", 0))).limit(int(share))
        if how == "uniform":
            a = aggregates(df, self.columns, {"min": F.min, "max": F.max})
            edges = {c: [a["min"][c] + (a["max"][c] - a["min"][c]) * i / n for i in range(n + 1)] for c in self.columns}
        else:
            edges = exact_quantiles(df, self.columns, [i / n for i in range(n + 1)])
            edges = {c: [e[0]] + [b for a, b in zip(e, e[1:], strict=False) if b - a > 1e-8] for c, e in edges.items()}
        return {"inner": {c: e[1:-1] if e[-1] > e[0] else [] for c, e in edges.items()}, "edges": {c: e if e[-1] > e[0] else ["-inf", "inf"] for c, e in edges.items()}}

    def _bin(self, c: str) -> Column:
        inner = self.state["inner"][c]
        at = reduce(lambda a, b: a + b, [F.when(present(c) >= e, 1).otherwise(0) for e in inner], F.lit(0))
        return F.when(present(c).isNotNull(), at.cast("double"))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.params.get("encode", "ordinal") == "ordinal":
            return replaced(df, {c: self._bin(c) for c in self.columns})
        hot = {f"{c}_{i}": F.coalesce((self._bin(c) == i).cast("int"), F.lit(0)) for c in self.columns for i in range(len(self.state["inner"][c]) + 1)}
        return df.select("*", *(v.alias(k) for k, v in hot.items())).drop(*self.columns)


class LabelEncoder(Module):
    """One column to the place of its value among all values in order; an unknown value is an error."""

    def _fit(self, df: DataFrame) -> dict:
        (c,) = self.columns
        return {"classes": [v for v, _ in counts(df, [c])[c]]}

    def transform(self, df: DataFrame) -> DataFrame:
        (c,) = self.columns
        value = category(df, c)
        unknown = F.when(value.isNotNull(), F.raise_error(F.concat(F.lit("unknown label "), value)).cast("double"))
        return replaced(df, {c: mapped(value, {v: i for i, v in enumerate(self.state["classes"])}, unknown).cast("int")})


class LabelBinarizer(LabelEncoder):
    """A 0/1 column for each class; one column if there are two classes. neg_label=0, pos_label=1."""

    def _fit(self, df: DataFrame) -> dict:
        if len(self.columns) != 1:
            raise ValueError("more than one output is not supported")
        if self.params.get("neg_label", 0) >= self.params.get("pos_label", 1):
            raise ValueError("neg_label must be less than pos_label")
        return super()._fit(df)

    def transform(self, df: DataFrame) -> DataFrame:
        (c,) = self.columns
        no, yes, classes = self.params.get("neg_label", 0), self.params.get("pos_label", 1), self.state["classes"]
        shown = classes[1:] if len(classes) == 2 else classes
        hot = [F.when(category(df, c) == v, yes).otherwise(no).alias(f"{c}_{v}") for v in shown]
        return df.select("*", *hot).drop(c)


class MultiLabelBinarizer(Module):
    """An array column to a 0/1 column for each label; classes gives them explicitly."""

    def _fit(self, df: DataFrame) -> dict:
        (c,) = self.columns
        given = self.params.get("classes")
        if given is not None and len(set(given)) != len(given):
            raise ValueError("a class is given twice")
        return {"classes": given or [v for v, _ in counts(df.select(F.explode(c).alias(c)), [c])[c]]}

    def transform(self, df: DataFrame) -> DataFrame:
        (c,) = self.columns
        hot = [F.coalesce(F.array_contains(F.col(c).cast("array<string>"), v), F.lit(False)).cast("int").alias(f"{c}_{v}") for v in self.state["classes"]]
        return df.select("*", *hot).drop(c)


INFREQUENT = "infrequent"


class OneHotEncoder(Module):
    """categories, drop (first or if_binary), handle_unknown (error, ignore, infrequent_if_exist), min_frequency (count or share), max_categories."""

    UNKNOWN = ("error", "ignore", "infrequent_if_exist")

    def _fit(self, df: DataFrame) -> dict:
        p = self.params
        if p.get("handle_unknown", "error") not in self.UNKNOWN:
            raise ValueError(f"no such handling: {p['handle_unknown']}")
        if p.get("drop") not in (None, "first", "if_binary"):
            raise ValueError(f"no such drop: {p['drop']}")
        if p.get("max_categories") is not None and p["max_categories"] < 1:
            raise ValueError("max_categories is at least 1")
        found, rows = counts(df, self.columns), df.count()
        given = dict(zip(self.columns, p.get("categories") or [], strict=False))
        kept, rare = {}, {}
        for c in self.columns:
            n = dict(found[c])
            values = [str(v) for v in given[c]] if c in given else list(n)
            if c in given and p.get("handle_unknown", "error") == "error" and set(n) - set(values):
                raise ValueError(f"{c} has values beyond the given categories")
            least = p.get("min_frequency")
            least = ceil(least * rows) if isinstance(least, float) else least or 0
            low = {v for v in values if n.get(v, 0) < least}
            most = p.get("max_categories")
            if most is not None and len(values) - len(low) + bool(low) > most:
                # One place is for the rare ones; of equal counts the earlier value stays.
                order = sorted((v for v in values if v not in low), key=lambda v: (-n.get(v, 0), values.index(v)))
                low |= set(order[most - 1 :])
            kept[c], rare[c] = [v for v in values if v not in low], [v for v in values if v in low]
        return {"kept": kept, "rare": rare}

    def codes(self, c: str) -> dict[str, int]:
        kept, rare = self.state["kept"][c], self.state["rare"][c]
        return {v: i for i, v in enumerate(kept)} | {v: len(kept) for v in rare}

    def code(self, df: DataFrame, c: str) -> Column:
        value, how = category(df, c), self.params.get("handle_unknown", "error")
        if how == "error":
            other = F.when(value.isNotNull(), F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), value)).cast("double")).otherwise(F.lit(-1.0))
        else:
            other = F.lit(float(len(self.state["kept"][c]) if how == "infrequent_if_exist" and self.state["rare"][c] else -1))
        return mapped(value, self.codes(c), other)

    def names(self, c: str) -> list[tuple[int, str]]:
        labels = [*enumerate(self.state["kept"][c])] + ([(len(self.state["kept"][c]), INFREQUENT)] if self.state["rare"][c] else [])
        drop = self.params.get("drop")
        return labels[1:] if drop == "first" or drop == "if_binary" and len(labels) == 2 else labels

    def transform(self, df: DataFrame) -> DataFrame:
        coded = df.withColumns({f"_code_{c}": self.code(df, c) for c in self.columns})
        hot = [(F.col(f"_code_{c}") == i).cast("int").alias(f"{c}_{v}") for c in self.columns for i, v in self.names(c)]
        return coded.select("*", *hot).drop(*self.columns, *(f"_code_{c}" for c in self.columns))


class OrdinalEncoder(OneHotEncoder):
    """Place of the category; handle_unknown error or use_encoded_value (unknown_value), encoded_missing_value."""

    UNKNOWN = ("error", "use_encoded_value")

    def _fit(self, df: DataFrame) -> dict:
        p = self.params
        how, other = p.get("handle_unknown", "error"), p.get("unknown_value")
        if how == "use_encoded_value" and other is None:
            raise ValueError("unknown_value is needed")
        if how == "error" and other is not None:
            raise ValueError("unknown_value goes with use_encoded_value")
        state = super()._fit(df)
        for c in self.columns:
            many = len(state["kept"][c]) + bool(state["rare"][c])
            for name in ("unknown_value", "encoded_missing_value"):
                if p.get(name) is not None and 0 <= p[name] < many:
                    raise ValueError(f"{name} is a code of {c}")
        return state

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.columns:
            value, missing = category(df, c), self.params.get("encoded_missing_value")
            if self.params.get("handle_unknown", "error") == "error":
                other = F.when(value.isNotNull(), F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), value)).cast("double"))
            else:
                other = F.when(value.isNotNull(), F.lit(float(self.params["unknown_value"])))
            out[c] = F.when(value.isNull(), F.lit(None if missing is None else float(missing)).cast("double")).otherwise(mapped(value, self.codes(c), other))
        return replaced(df, out)


class TargetEncoder(Module):
    """Category to a shrunk mean of the target. smooth: a number, or auto (empirical Bayes).

    fit_transform with a key encodes each row by a fit on the other folds; the
    fold is that of the key column, pmod(hash(key), folds), so it does not depend on how
    rows are dealt.
    """

    def __init__(self, columns: list[str], target: str, **params):
        super().__init__(columns, **params)
        self.target = target

    def _sums(self, df: DataFrame, c: str, fold: Column | None = None) -> DataFrame:
        y = present(self.target)
        by = [category(df, c).alias("v"), *([fold.alias("fold")] if fold is not None else [])]
        return df.where(y.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))

    def _encode(self, n: Column, s: Column, q: Column, N: Column, S: Column, Q: Column) -> Column:
        smooth, mean = self.params.get("smooth", "auto"), S / N
        if smooth != "auto":
            return (F.lit(float(smooth)) * mean + s) / (F.lit(float(smooth)) + n)
        variance = Q / N - mean * mean
        within = F.greatest(q - s * s / n, F.lit(0.0)) / n
        weight = F.try_divide(variance * n, variance * n + within)
        return F.when(variance <= 0, mean).otherwise(F.coalesce(weight, F.lit(1.0)) * (s / n) + (1 - F.coalesce(weight, F.lit(1.0))) * mean)

    def _fit(self, df: DataFrame) -> dict:
        out = {}
        for c in self.columns:
            sums = self._sums(df, c)
            whole = sums.agg(*(F.sum(x).alias(f"all_{x}") for x in "nsq"))
            rows = sums.crossJoin(F.broadcast(whole)).select("v", self._encode(*map(F.col, ("n", "s", "q", "all_n", "all_s", "all_q"))).alias("e"), (F.col("all_s") / F.col("all_n")).alias("mean"))  # one row is joined
            got = rows.collect()  # a row for each category
            out[c] = {"values": {r.v: r.e for r in got if r.v is not None}, "missing": next((r.e for r in got if r.v is None), None), "mean": got[0]["mean"] if got else None}
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.columns:
            s, value = self.state[c], category(df, c)
            missing = s["missing"] if s["missing"] is not None else s["mean"]
            out[c] = F.when(value.isNull(), F.lit(missing).cast("double")).otherwise(mapped(value, s["values"], F.lit(s["mean"]).cast("double")))
        return replaced(df, out)

    def fit_transform(self, df: DataFrame, key: str | None = None, folds: int = 5, fold: Column | None = None) -> DataFrame:
        """fold: the number of a row's fold, if not by the hash of the key."""
        self.fit(df)
        if key is None:
            return self.transform(df)
        of = F.pmod(F.xxhash64(key), F.lit(folds)) if fold is None else fold
        out = df.withColumn("_fold", of)
        for i, c in enumerate(self.columns):
            sums = self._sums(df, c, of)
            own = sums.select(F.col("v").alias(f"_v{i}"), F.col("fold").alias("_fold"), *(F.col(x).alias(f"_f{x}") for x in "nsq"))
            each = sums.groupBy(F.col("v").alias(f"_v{i}")).agg(*(F.sum(x).alias(f"_c{x}") for x in "nsq"))
            by_fold = sums.groupBy(F.col("fold").alias("_fold")).agg(*(F.sum(x).alias(f"_o{x}") for x in "nsq"))
            whole = sums.agg(*(F.sum(x).alias(f"_t{x}") for x in "nsq"))
            left = out.withColumn(f"_v{i}", category(df, c))
            left = left.join(each, left[f"_v{i}"].eqNullSafe(each[f"_v{i}"]), "left").drop(each[f"_v{i}"])
            left = left.join(own, left[f"_v{i}"].eqNullSafe(own[f"_v{i}"]) & (left["_fold"] == own["_fold"]), "left").drop(own[f"_v{i}"], own["_fold"])
            left = left.join(by_fold, "_fold", "left").crossJoin(F.broadcast(whole))  # one row is joined
            rest = {x: F.coalesce(F.col(f"_c{x}"), F.lit(0)) - F.coalesce(F.col(f"_f{x}"), F.lit(0)) for x in "nsq"}
            others = {x: F.col(f"_t{x}") - F.coalesce(F.col(f"_o{x}"), F.lit(0)) for x in "nsq"}
            n = F.nullif(rest["n"], F.lit(0))
            value = F.coalesce(self._encode(n, rest["s"], rest["q"], *(others[x] for x in "nsq")), others["s"] / others["n"])
            out = replaced(left, {c: value}).select(*df.columns, "_fold")
        return out.drop("_fold")
