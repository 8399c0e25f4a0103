"""Metrics as aggregates. Ranks come from counts by score, so rows with one score need not meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.files import before, ranged, scratch
from concord.operators.stats import exact_quantiles


REGRESSION = ("ev", "maxe", "mae", "mse", "rmse", "msle", "medae", "mape", "r2")


def regression(df: DataFrame, y: str = "y", p: str = "p", only: list[str] | None = None) -> DataFrame:
    """One row: ev, maxe, mae, mse, rmse, msle, medae, mape, r2, or only some of them.

    The median is found at once, by passes of its own, so that no task holds all
    errors; the rest is one aggregate.
    """
    d, e = F.col(y).cast("double"), F.col(p).cast("double")
    err = d - e
    eps = 2.220446049250313e-16
    out = df.agg(
        F.var_pop(err).alias("_ve"),
        F.var_pop(d).alias("_vy"),
        F.max(F.abs(err)).alias("maxe"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.avg(F.when((d >= 0) & (e >= 0), F.pow(F.log1p(F.greatest(d, F.lit(0.0))) - F.log1p(F.greatest(e, F.lit(0.0))), 2))).alias("msle"),
        F.avg(F.abs(err) / F.greatest(F.abs(d), F.lit(eps))).alias("mape"),
    )
    share = lambda v: F.when(F.col("_vy") == 0, F.when(v == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(v, F.col("_vy")))
    named = {n: F.col(n) for n in ("maxe", "mae", "mse", "msle", "mape")} | {"ev": share(F.col("_ve")), "rmse": F.sqrt("mse"), "r2": share(F.col("mse"))}
    if only is None or "medae" in only:
        # NaN is the largest error; ranked as an infinity.
        inf = F.lit(float("inf"))
        middle = F.lit(exact_quantiles(df.select(F.when(F.isnan(err), inf).otherwise(F.abs(err)).alias("e")), ["e"], [0.5])["e"][0]).cast("double")
        named["medae"] = F.when(F.isnan("mae") & (middle == inf), float("nan")).otherwise(middle)
    return out.select(*(named[n].alias(n) for n in only or REGRESSION))


def classification(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """One row for a binary label and a probability: acc, precision, recall, f1."""
    yes, said = F.col(y) == 1, F.col(p) > threshold
    n = df.agg(*(F.count_if(c).alias(a) for a, c in (("tp", yes & said), ("fp", ~yes & said), ("fn", yes & ~said), ("tn", ~yes & ~said))))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return n.select(ratio(tp + tn, tp + fp + fn + tn).alias("acc"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def multiclass(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row for a label and a predicted label: acc and macro precision, recall, f1."""
    cells = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    true = cells.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("of"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("said"))
    each = true.join(said, "c", "full").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, of, s = F.col("tp"), F.col("of"), F.col("said")
    return each.agg(ratio(F.sum(tp), F.sum(of)).alias("acc"), F.avg(ratio(tp, s)).alias("precision"), F.avg(ratio(tp, of)).alias("recall"), F.avg(ratio(2 * tp, s + of)).alias("f1"))


def _counted(df: DataFrame, y: str, p: str, bins: int | None) -> DataFrame:
    """A row for each distinct score, with pos, neg, tp and fp (those from that score up) and the totals P and N.

    Scores are sorted by ranges; sums over the ranges above are added to running
    sums within a range, so no task sees all scores.
    """
    s = F.col(p).cast("double") if bins is None else F.floor(F.col(p) * bins) / bins
    by = df.groupBy(s.alias("threshold")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    rows = before(ranged(by, [F.desc("threshold")], scratch(df.sparkSession, "roc")), {"pos": F.sum("pos"), "neg": F.sum("neg")})
    own = Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    total = rows.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    run = rows.select("threshold", "pos", "neg", (F.sum("pos").over(own) + F.col("_before_pos")).alias("tp"), (F.sum("neg").over(own) + F.col("_before_neg")).alias("fp"))
    return run.crossJoin(F.broadcast(total))  # one row is joined


def roc(df: DataFrame, y: str = "y", p: str = "p", bins: int | None = None) -> DataFrame:
    """threshold, fpr, tpr, of every score or, with bins, of rounded scores."""
    return _counted(df, y, p, bins).select("threshold", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))


def auc(df: DataFrame, y: str = "y", p: str = "p", bins: int | None = None) -> DataFrame:
    """One row, auc: the share of pairs of a positive and a negative that are in order, ties counted half."""
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return _counted(df, y, p, bins).agg(F.try_divide(won, F.max("P") * F.max("N")).alias("auc"))


def auc_ovr(df: DataFrame, y: str, p: str, classes: list) -> DataFrame:
    """One row, auc: the mean over classes of the auc of one class against all others; p: an array of a probability for each class."""
    each = [auc(df.select((F.col(y) == c).cast("int").alias("y"), F.get(p, F.lit(i)).alias("p"))) for i, c in enumerate(classes)]
    return reduce(lambda a, b: a.unionByName(b), each).agg(F.avg("auc").alias("auc"))


def ks(df: DataFrame, y: str = "y", p: str = "p", bins: int | None = None) -> DataFrame:
    """One row, ks: the largest tpr - fpr."""
    return roc(df, y, p, bins).agg(F.greatest(F.max(F.col("tpr") - F.col("fpr")), F.lit(0.0)).alias("ks"))


def merged_roc(curves: list[tuple[list[float], list[float], int]]) -> tuple[list[float], list[float]]:
    """Vertical average of parties' curves (fpr, tpr, examples): tpr weighted by examples at every fpr."""
    import numpy as np

    grid = sorted({x for fpr, _, _ in curves for x in fpr} | {0.0, 1.0})
    total = sum(n for *_, n in curves)
    tpr = sum(n * np.interp(grid, [0.0, *f], [0.0, *t]) for f, t, n in curves) / total
    return grid, tpr.tolist()


def averaged(metrics: list[tuple[dict[str, float], int]]) -> dict[str, float]:
    """Metrics of parties weighted by their examples."""
    total = sum(n for _, n in metrics)
    return {k: sum(m[k] * n for m, n in metrics) / total for k in metrics[0][0]}
