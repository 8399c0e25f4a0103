"""Statistics over the union of parties (horizontal), or over their columns by row (vertical).

A horizontal statistic is one aggregate over the union: Spark adds up each
partition first and combines the parts. Missing values are NULL or NaN alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.files import numbered
from concord.functions.expression import joined
from concord.functions.scalar import total
from concord.sources.tables import write_json
from concord.types import is_numeric, present, require_columns

PARTY = "_party"
KLL_K = 200


def union(parties: dict[str, DataFrame], missing: bool = False) -> DataFrame:
    """All parties' rows, with the party's name; with missing, a column that a party lacks is NULL in its rows."""
    frames = [df.withColumn(PARTY, F.lit(p)) for p, df in parties.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def column_union(parties: dict[str, DataFrame]) -> list[str]:
    """The columns that any party has, in order of first appearance."""
    return list(dict.fromkeys(c for df in parties.values() for c in df.columns if c != PARTY))


def split_parties(df: DataFrame, key: str, n: int) -> dict[str, DataFrame]:
    """df dealt to n parties by its key."""
    return {f"party{i}": df.where(F.pmod(F.col(key), F.lit(n)) == i) for i in range(n)}


def _check(df: DataFrame, columns: list[str]) -> list[str]:
    require_columns(df, columns)
    for c in columns:
        if not is_numeric(df.schema[c].dataType):
            raise TypeError(f"{c} is not a number")
    return sorted(columns)


# Joint statistics: one row of doubles, columns by name.


def joint(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """SUM, AVG, MAX or MIN of each column. AVG divides by all rows, so a missing value counts as 0; see col_mean otherwise."""
    how = {"SUM": F.sum, "MAX": F.max, "MIN": F.min, "AVG": lambda c: F.sum(F.coalesce(c, F.lit(0.0))) / F.count("*")}
    if kind.upper() not in how:
        raise ValueError(f"no such statistic: {kind}")
    columns = _check(df, columns)
    return df.agg(*(how[kind.upper()](present(c)).alias(c) for c in columns)) if columns else df.limit(0).select()


def joint_of_parts(kind: str, parts: list[list[float]], counts: list[list[int]] | None = None) -> list[float]:
    """The same from each party's own vector of sums or extremes (and, for AVG, row counts)."""
    cols = list(zip(*parts, strict=True))
    if kind.upper() == "AVG":
        return [sum(c) / sum(n) for c, n in zip(cols, zip(*counts, strict=True), strict=True)]
    return [{"SUM": sum, "MAX": max, "MIN": min}[kind.upper()](c) for c in cols]


# Column statistics: one row per column and value.


def _long(df: DataFrame, columns: list[str], of: dict) -> DataFrame:
    """One row a column from one aggregate: column and the named values."""
    columns = _check(df, columns)
    row = df.agg(*(f(present(c)).alias(f"{c}\x1f{n}") for c in columns for n, f in of.items()))
    parts = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}\x1f{n}`").alias(n) for n in of)) for c in columns))
    return row.select(F.inline(parts))


def col_sum(df: DataFrame, columns: list[str]) -> DataFrame:
    return _long(df, columns, {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))})


def col_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    return _long(df, columns, {"mean": F.avg})


def col_var(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance."""
    return _long(df, columns, {"var": F.var_pop})


def col_min(df: DataFrame, columns: list[str]) -> DataFrame:
    return _long(df, columns, {"min": F.min})


def col_max(df: DataFrame, columns: list[str]) -> DataFrame:
    return _long(df, columns, {"max": F.max})


def col_min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    return _long(df, columns, {"min": F.min, "max": F.max})


NORMS = {"l1": lambda c: F.sum(F.abs(c)), "l2": lambda c: F.sqrt(F.sum(c * c)), "max": lambda c: F.max(F.abs(c))}


def col_norm(df: DataFrame, columns: list[str], norm: str = "l2") -> DataFrame:
    if norm not in NORMS:
        raise ValueError(f"no such norm: {norm}")
    return _long(df, columns, {"norm": NORMS[norm]})


def _quantiles(q: list[float]) -> list[float]:
    if not q or any(not 0 <= x <= 1 for x in q):
        raise ValueError("quantiles lie in [0, 1]")
    return [float(x) for x in q]


HELD = 1_000_000  # values that one exact percentile may hold
FEW = 16  # quantiles that are found by brackets; more come from one sort by ranges


def exact_quantiles(df: DataFrame, columns: list[str], q: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of each column, linearly interpolated between the values beside the rank; None without values.

    A few are found by brackets: a sketch gives two values around each, one pass
    counts what lies below and between, and only what lies between is ranked
    exactly (a bracket of over HELD values is narrowed first). For many, and where
    brackets do not help, values are sorted by ranges and picked by rank. No task
    holds all values of a column.
    """
    view = df.select([present(c).alias(str(i)) for i, c in enumerate(columns)])
    if len(q) > FEW:
        return {c: _by_rank(view.select(F.col(str(i)).alias("v")).where("v IS NOT NULL"), q) for i, c in enumerate(columns)}
    accuracy = 10_000
    wide = sorted({x for p in q for x in (max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy))})
    first = view.agg(*(f for i in range(len(columns)) for f in (F.count(str(i)).alias(f"n{i}"), F.percentile_approx(str(i), wide, accuracy).alias(f"a{i}"), F.min(str(i)).alias(f"lo{i}"), F.max(str(i)).alias(f"hi{i}")))).first()
    brackets: dict[tuple[int, int], list[float]] = {}
    for i in range(len(columns)):
        if first[f"n{i}"]:
            at = dict(zip(wide, first[f"a{i}"], strict=True))
            for j, p in enumerate(q):
                lo = first[f"lo{i}"] if p - 2 / accuracy <= 0 else at[max(0.0, p - 2 / accuracy)]
                hi = first[f"hi{i}"] if p + 2 / accuracy >= 1 else at[min(1.0, p + 2 / accuracy)]
                brackets[i, j] = [lo, hi]
    found: dict[tuple[int, int], float | None] = {}
    for narrowed in range(3):
        inside = {k: F.col(str(k[0])).between(*b) for k, b in brackets.items()}
        if not inside:
            break
        row = view.agg(*(f for k, b in brackets.items() for f in (F.count_if(F.col(str(k[0])) < b[0]).alias(f"b{k[0]}_{k[1]}"), F.count_if(inside[k]).alias(f"m{k[0]}_{k[1]}")))).first()
        exact, wide_ones = {}, {}
        for k, (lo, hi) in list(brackets.items()):
            below, m, n = row[f"b{k[0]}_{k[1]}"], row[f"m{k[0]}_{k[1]}"], first[f"n{k[0]}"]
            place = q[k[1]] * (n - 1)
            if below > int(place) or below + m < min(int(place) + 2, n):
                continue  # the sketch missed: ranked below
            if lo == hi:
                found[k] = lo
            else:
                (exact if m <= HELD else wide_ones)[k] = min(1.0, max(0.0, (place - below) / max(1, m - 1)))
        if exact:
            got = view.agg(*(F.percentile(F.when(inside[k], F.col(str(k[0]))), share).alias(f"{k[0]}_{k[1]}") for k, share in exact.items())).first()
            found |= {k: got[f"{k[0]}_{k[1]}"] for k in exact}
        brackets = {}
        if wide_ones and narrowed < 2:
            near = lambda share: [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)]
            got = view.agg(*(F.percentile_approx(F.when(inside[k], F.col(str(k[0]))), near(share), accuracy).alias(f"{k[0]}_{k[1]}") for k, share in wide_ones.items())).first()
            brackets = {k: list(got[f"{k[0]}_{k[1]}"]) for k in wide_ones}
    # What no bracket could part (ties, or a sketch that missed) is ranked by a sort in ranges.
    for i in range(len(columns)):
        left = [j for j in range(len(q)) if (i, j) not in found and first[f"n{i}"]]
        if left:
            ranked = _by_rank(view.select(F.col(str(i)).alias("v")).where("v IS NOT NULL"), [q[j] for j in left])
            found |= {(i, j): v for j, v in zip(left, ranked, strict=True)}
    return {c: [found.get((i, j)) for j in range(len(q))] for i, c in enumerate(columns)}


def _by_rank(values: DataFrame, q: list[float]) -> list[float | None]:
    rows = numbered(values, ["v"], "k")
    n = rows.count()
    if not n:
        return [None] * len(q)
    places = [p * (n - 1) for p in q]
    ranks = sorted({min(n - 1, int(x) + d) for x in places for d in (0, 1)})
    at = {r.k: r.v for r in rows.where(F.col("k").isin(ranks)).collect()}  # two rows a quantile
    pairs = [(at[int(x)], at[min(n - 1, int(x) + 1)], x - int(x)) for x in places]
    return [lo if lo == hi or not share else lo + (hi - lo) * share for lo, hi, share in pairs]  # an infinity less itself, or 0 times, is no number


def col_quantile(df: DataFrame, columns: list[str], q: list[float], sketch: str | None = None, k: int = KLL_K, is_hra: bool = True) -> DataFrame:
    """column, q, value. Exact with linear interpolation, or by a sketch.

    KLL: Spark's mergeable sketch of k. REQ: an error in proportion to the ranks
    left above (is_hra) or below (not is_hra) the quantile, by percentile_approx
    with an accuracy that rises towards that end; at the end itself it is exact.
    """
    q, columns = _quantiles(q), _check(df, columns)
    if sketch not in (None, "KLL", "REQ") or k < 1 or not isinstance(is_hra, bool):
        raise ValueError("sketch is KLL, REQ or none, k is at least 1, is_hra true or false")
    if sketch == "KLL":
        row = df.agg(*(F.kll_sketch_agg_double(present(c), max(8, k)).alias(c) for c in columns))
        value = lambda c, x: F.kll_sketch_get_quantile_double(F.col(f"`{c}`"), F.lit(x))
        rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(x).alias("q"), value(c, x).alias("value")) for c in columns for x in q))
        return row.select(F.inline(rows))
    if sketch == "REQ":
        end = 1.0 if is_hra else 0.0
        fine = lambda x: min(2_000_000_000, int(k / max(abs(end - x), 1e-6)) + 1)
        edge = F.max if is_hra else F.min
        row = df.agg(*((edge(present(c)) if x == end else F.percentile_approx(present(c), x, fine(x))).alias(f"{i}_{j}") for i, c in enumerate(columns) for j, x in enumerate(q)))
        rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(x).alias("q"), F.col(f"{i}_{j}").alias("value")) for i, c in enumerate(columns) for j, x in enumerate(q)))
        return row.select(F.inline(rows))
    found = exact_quantiles(df, columns, q)
    rows = [(c, x, v) for c in columns for x, v in zip(q, found[c], strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, q double, value double")


def col_median(df: DataFrame, columns: list[str], **options) -> DataFrame:
    return col_quantile(df, columns, [0.5], **options).select("column", F.col("value").alias("median"))


def col_frequent(df: DataFrame, columns: list[str], max_item: int | None = None, min_freq: int = 1) -> DataFrame:
    """column, item, count: the most frequent values (as text) of each column; ties by value."""
    if min_freq < 1 or (max_item is not None and max_item < 1):
        raise ValueError("min_freq and max_item are at least 1")
    require_columns(df, columns)
    parts = []
    for c in sorted(columns):
        v = F.col(c) if not is_numeric(df.schema[c].dataType) else F.nullif(F.col(c), F.lit(float("nan")).cast(df.schema[c].dataType)) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c)
        n = df.select(v.alias("_v")).where("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias("count")).where(F.col("count") >= min_freq)
        n = n.orderBy(F.desc("count"), "_v")
        n = n.limit(max_item) if max_item else n
        parts.append(n.select(F.lit(c).alias("column"), F.col("_v").cast("string").alias("item"), "count"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def col_frequent_approximate(df: DataFrame, column: str, max_item: int, capacity: int = 10_000, error_type: str = "NFN", min_freq: int = 1) -> DataFrame:
    """item, count: likely most frequent values by a sketch that tracks ``capacity`` of them, for columns with very many values.

    NFN loses no item of min_freq: what may reach it by the sketch's error stays,
    with the sketch's count. NFP has no item below it: the candidates are counted
    again in a second pass. Up to max_item of either, by count, then value.
    """
    if error_type not in ("NFN", "NFP"):
        raise ValueError("error_type is NFN or NFP")
    require_columns(df, [column])
    c = f"`{column.replace('`', '``')}`"
    tracked = min(100_000, max(int(max_item), int(capacity) // 2))
    row = df.agg(F.expr(f"approx_top_k({c}, {tracked}, {max(int(capacity), tracked)})").alias("top"), F.count(column).alias("n"))
    top = row.select("n", F.explode("top").alias("x")).select("n", "x.item", "x.count").where("item IS NOT NULL")
    # The error bound of a frequent-items sketch of this size; nothing is lost where all values fit.
    some = Window.partitionBy()  # at most ``tracked`` rows
    error = F.when(F.count("*").over(some) < F.lit(int(0.75 * capacity)), F.lit(0.0)).otherwise(F.lit(3.5 / capacity) * F.col("n"))
    near = top.withColumn("error", error).where(F.col("count") + F.col("error") >= min_freq).select("item", "count")
    if error_type == "NFP":
        near = df.select(F.col(column).alias("item")).join(F.broadcast(near.select("item")), "item").groupBy("item").agg(F.count("*").alias("count")).where(F.col("count") >= min_freq)
    return near.orderBy(F.desc("count"), "item").limit(int(max_item))


def col_union(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, item: distinct present values, as text, of each column; NaN is no value, the text NaN is one."""
    require_columns(df, columns)
    real = {c: present(c).isNotNull() if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c).isNotNull() for c in columns}
    parts = [df.where(real[c]).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("item")).distinct() for c in sorted(columns)]
    return reduce(lambda a, b: a.unionByName(b), parts)


# Row statistics over columns of parties that share a key.


def _rows(parties: list[DataFrame], key: str, **named: Column) -> DataFrame:
    return joined(parties, key).select(key, *(v.alias(n) for n, v in named.items()))


def _values(parties: list[DataFrame], key: str) -> list[Column]:
    columns = [c for p in parties for c in p.columns if c != key]
    for p in parties:
        _check(p, [c for c in p.columns if c != key])
    return [present(c) for c in columns]


def _extreme(f, values: list[Column]) -> Column:
    return f(*values) if len(values) > 1 else values[0]


def row_sum(parties: list[DataFrame], key: str) -> DataFrame:
    return _rows(parties, key, sum=total(_values(parties, key)))


def row_min(parties: list[DataFrame], key: str) -> DataFrame:
    return _rows(parties, key, min=_extreme(F.least, _values(parties, key)))


def row_max(parties: list[DataFrame], key: str) -> DataFrame:
    return _rows(parties, key, max=_extreme(F.greatest, _values(parties, key)))


def row_min_max(parties: list[DataFrame], key: str) -> DataFrame:
    v = _values(parties, key)
    return _rows(parties, key, min=_extreme(F.least, v), max=_extreme(F.greatest, v))


def row_norm_value(values: list[Column], norm: str) -> Column:
    if norm == "l1":
        return total(F.abs(v) for v in values)
    if norm == "l2":
        return F.sqrt(total(v * v for v in values))
    if norm == "max":
        return _extreme(F.greatest, [F.abs(v) for v in values])
    raise ValueError(f"no such norm: {norm}")


def row_norm(parties: list[DataFrame], key: str, norm: str = "l2") -> DataFrame:
    return _rows(parties, key, norm=row_norm_value(_values(parties, key), norm))


COLUMN_STATS = {
    "sum": col_sum, "mean": col_mean, "var": col_var, "min": col_min, "max": col_max, "min_max": col_min_max, "norm": col_norm, "quantile": col_quantile,
    "median": col_median, "frequent": col_frequent, "union": col_union,
}
ROW_STATS = {"sum": row_sum, "min": row_min, "max": row_max, "min_max": row_min_max, "norm": row_norm}


def statistic(name: str, axis: str = "col"):
    """The function of a statistic by name and axis."""
    table = {"col": COLUMN_STATS, "row": ROW_STATS}.get(axis)
    if table is None or name not in table:
        raise ValueError(f"no statistic {name} over {axis}")
    return table[name]


class StatsPipeline:
    """Several statistics, {name: options}, over parties.

    Horizontal (H): over the rows of all, for the columns that all have.
    Vertical (V): by column for each party's own columns, and by row (names with
    row_) over the columns of all parties that share a key.
    """

    def __init__(self, stats: dict[str, dict], mode: str = "H"):
        if mode not in ("H", "V"):
            raise ValueError("a pipeline is H or V")
        self.stats, self.mode = stats, mode

    def _columns(self, df: DataFrame, name: str, own: dict, columns: list[str] | None, given: list[str]) -> DataFrame:
        numbers = [c for c in given if is_numeric(df.schema[c].dataType)]
        chosen = own.pop("columns", None) or columns or (given if name in ("frequent", "union") else numbers)
        return statistic(name)(df, [c for c in chosen if c in given], **own)

    def frames(self, parties: dict[str, DataFrame], columns: list[str] | None = None, key: str | None = None) -> dict[str, DataFrame]:
        """A frame for each statistic; vertical ones by column have the party's name (party)."""
        out = {}
        if self.mode == "H":
            shared = [c for c in column_union(parties) if all(c in df.columns for df in parties.values())]
            df = union({p: x.select(*shared) for p, x in parties.items()})
            for name, options in self.stats.items():
                out[name] = self._columns(df, name.removeprefix("col_"), dict(options), columns, shared)
            return out
        for name, options in self.stats.items():
            if name.startswith("row_"):
                # Numbers only, as text has no sum or order of numbers.
                numbers = [df.select(key, *(c for c in df.columns if c != key and is_numeric(df.schema[c].dataType))) for df in parties.values()]
                out[name] = statistic(name.removeprefix("row_"), "row")(numbers, key, **options)
            else:
                parts = [
                    self._columns(df, name.removeprefix("col_"), dict(options), columns, [c for c in df.columns if c != key]).withColumn("party", F.lit(p))
                    for p, df in parties.items()
                ]
                out[name] = reduce(lambda a, b: a.unionByName(b), parts)
        return out

    def run(self, parties: dict[str, DataFrame], columns: list[str] | None = None, key: str | None = None, path: str | None = None) -> dict[str, list[dict]]:
        """Column statistics as lists of rows; with path they are written there as JSON too. Statistics by row are frames' work."""
        out = {n: [r.asDict() for r in f.collect()] for n, f in self.frames(parties, columns, key).items() if not n.startswith("row_")}
        if path:
            write_json(out, path)
        return out
