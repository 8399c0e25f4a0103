"""Registered queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import expression, scalar
from concord.operators import clean, lookup, psi, stats
from concord.operators.ml import boosting, linear, metrics
from concord.operators.preprocess import encoders, imputer, scalers, transformers
from concord.streaming import stats as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with the SQL it must agree with."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Doubles rounded, or left as they are; + 0.0 turns -0.0 into 0.0."""
    cut = (lambda c: F.col(c)) if digits is None else (lambda c: F.round(c, digits))
    return df.select([(cut(c) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# Sets and lookups.

URGENT = "o_orderstatus = 'F' AND o_orderpriority LIKE '1%'"


def urgent(spark, sf):
    return t(spark, sf, "orders").where(URGENT).select(F.col("o_custkey").alias("c_custkey"))


@query(f"SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {URGENT}) GROUP BY 1")
def flagship(spark, sf):
    both = psi.intersection(t(spark, sf, "customer"), urgent(spark, sf), ["c_custkey"])
    return both.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {URGENT})")
def psi_intersection(spark, sf):
    return psi.intersection(t(spark, sf, "customer"), urgent(spark, sf), ["c_custkey"]).select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {URGENT})")
def psi_difference(spark, sf):
    return psi.difference(t(spark, sf, "customer"), urgent(spark, sf), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def psi_unique(spark, sf):
    return psi.intersection(t(spark, sf, "lineitem").select("l_partkey"), t(spark, sf, "part").where("p_size <= 10"), ["l_partkey"], ["p_partkey"], unique=True)


@query("SELECT l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def psi_duplicates(spark, sf):
    return psi.intersection(t(spark, sf, "lineitem").select("l_partkey"), t(spark, sf, "part").where("p_size <= 10"), ["l_partkey"], ["p_partkey"], "KKRT")


@query(f"SELECT count(*) AS cardinality FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {URGENT})")
def psi_cardinality(spark, sf):
    return psi.cardinality(t(spark, sf, "customer"), urgent(spark, sf), ["c_custkey"])


@query("""SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'R' AND EXISTS
    (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'A' AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)""")
def psi_composite(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    return psi.intersection(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"]).drop("l_returnflag")


@query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {URGENT})")
def psi_masked(spark, sf):
    return psi.intersection(t(spark, sf, "customer"), urgent(spark, sf), ["c_custkey"], protocol="TEE").select("c_custkey", "c_mktsegment")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)
    SELECT c_custkey, seg FROM c WHERE coalesce(seg, '') IN ('', 'BUILDING')""")
def psi_missing_keys(spark, sf):
    client = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("seg"))
    server = spark.createDataFrame([(None,), ("BUILDING",)], "seg string")
    return psi.intersection(client, server, ["seg"])


@query(f"SELECT DISTINCT o_custkey AS id FROM orders WHERE {URGENT} AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def psi_two_party(spark, sf):
    a = urgent(spark, sf).select(F.col("c_custkey").alias("id")).distinct()
    b = t(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return psi.two_party({"a": a, "b": b}, "a", True)["b"]


@query("""SELECT o_custkey AS id, sum(o_totalprice) AS spent, any_value(c_acctbal) AS balance FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000 GROUP BY 1""")
def sample_alignment(spark, sf):
    host = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("spent"))
    guest = t(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    host, guest = psi.align_samples(host, guest, "id")
    return psi.aligned_join(host, guest, "id")


ORACLES["sample_alignment"] = """SELECT id, round(spent, 2) AS spent, balance FROM (SELECT o_custkey AS id, sum(o_totalprice) AS spent FROM orders GROUP BY 1) o
    JOIN (SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000) c USING (id)"""
QUERIES["sample_alignment"] = lambda spark, sf: rounded(sample_alignment(spark, sf), 2)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (1, 5, 77, 100)")
def keyword_pir(spark, sf):
    return lookup.keyword_lookup(lookup.query_frame(spark, [1, 5, 77, 100, 100, 99_999_999]), t(spark, sf, "part"), labels=["p_partkey", "p_name", "p_brand"])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey <= 20)""")
def pir_composite(spark, sf):
    li = t(spark, sf, "lineitem")
    asked = li.where("l_orderkey <= 20").select("l_partkey", "l_suppkey")
    return lookup.keyword_lookup(asked, li, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"])


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_index, p_partkey, p_name FROM part QUALIFY row_index IN (0, 7, 99)")
def id_pir(spark, sf):
    return lookup.row_lookup(t(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"], [0, 7, 99])


@query("SELECT 1000000 - p_partkey AS position, p_partkey, p_name FROM part WHERE p_size > 40")
def data_align(spark, sf):
    part = t(spark, sf, "part")
    result = part.where("p_size > 40").select((1_000_000 - F.col("p_partkey")).alias("pos"), F.col("p_partkey").alias("k"))
    return lookup.align(part.select("p_partkey", "p_name"), ["p_partkey"], result, ["k"], "pos")


# Joint statistics.

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _joint(kind: str, n: int):
    digits = {"SUM": 2, "AVG": 4}.get(kind, 6)
    values = ", ".join(f"round({kind.lower()}({c}), {digits}) + 0.0 AS {c}" for c in LI)

    def run(spark, sf):
        parties = stats.split_parties(t(spark, sf, "lineitem").select("l_orderkey", *LI), "l_orderkey", n)
        return rounded(stats.joint(stats.union(parties), kind, LI), digits)

    query(f"SELECT {values} FROM lineitem", f"mpc_{kind.lower()}" + ("" if n == 3 else "_two_party"))(run)


for _kind in ("SUM", "AVG", "MAX", "MIN"):
    _joint(_kind, 3)
    _joint(_kind, 2)


# Expressions over columns of two parties.

HOST = "SELECT o_orderkey, o_totalprice AS A FROM orders"
GUEST = "SELECT o_orderkey, o_custkey AS B, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS C FROM orders"


def _expression(name: str, text: str, sql: str | None = None):
    def run(spark, sf):
        orders = t(spark, sf, "orders")
        host = orders.select("o_orderkey", F.col("o_totalprice").alias("A"))
        guest = orders.select("o_orderkey", F.col("o_custkey").alias("B"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("C"))
        return rounded(expression.evaluate(text, [host, guest], "o_orderkey"), None)

    query(f"SELECT o_orderkey, CAST({sql or text} AS DOUBLE) + 0.0::DOUBLE AS result FROM ({HOST}) JOIN ({GUEST}) USING (o_orderkey)", f"mpc_expr_{name}")(run)


for _name, _text, _sql in (
    ("add", "A+B", None), ("sub", "A-C-9", None), ("mul", "A*C", None), ("div", "A/B", "A / B"), ("recip", "8/C", "8.0::DOUBLE / C"), ("mixed", "C*A+B-3.75", "C*A+B-3.75::DOUBLE"),
    ("paren", "(7.5-(B*C+A-1.25))*4.0", "(7.5::DOUBLE-(B*C+A-1.25::DOUBLE))*4.0::DOUBLE"), ("neg", "-64/A", "-64::DOUBLE/A"), ("int", "B*C-(B-7)*2", None),
    ("half", "(A-(B*C-A+3-2)*3)/4", "(A-(B*C-A+3-2)*3)/4::DOUBLE"),
):
    _expression(_name, _text, _sql)


@query("SELECT o_orderkey, A / (B - C) + 0.0::DOUBLE AS result FROM (SELECT o_orderkey, o_totalprice AS A, CAST(o_custkey % 5 + 10 AS DOUBLE) AS B, 1.0::DOUBLE AS C FROM orders)")
def mpc_expr_declared(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("A"), (F.col("o_custkey") % 5 + 10).alias("B"), F.lit(1).alias("C"))
    return rounded(df.select("o_orderkey", expression.expression("A/(B-C)", df.schema, {"A": "double", "B": "bigint", "C": "bigint"}).alias("result")), None)


@query("SELECT o_orderkey, o_totalprice < o_custkey * 50 AS result FROM orders")
def mpc_cmp(spark, sf):
    o = t(spark, sf, "orders")
    return expression.compare(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", (F.col("o_custkey") * 50).alias("v")), "o_orderkey", "o_totalprice", "v")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS sign, CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS step, abs(c_acctbal) AS magnitude, greatest(c_acctbal, 0.0) AS relu,
    round(CASE WHEN c_acctbal / 10000 < -0.5 THEN 0 WHEN c_acctbal / 10000 >= 0.5 THEN 1 ELSE c_acctbal / 10000 + 0.5 END, 6) AS logistic FROM customer""")
def scalar_functions(spark, sf):
    x = F.col("c_acctbal")
    return t(spark, sf, "customer").select(
        "c_custkey", scalar.sign(x).alias("sign"), scalar.step(x).alias("step"), F.abs(x).alias("magnitude"), scalar.relu(x).alias("relu"),
        F.round(scalar.piecewise_sigmoid(x / 10000), 6).alias("logistic"),
    )


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS dot FROM embeddings")
def dot_product(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return t(spark, sf, "embeddings").select("vec_id", F.round(scalar.dot(v, v), 4).alias("dot"))


# Statistics by column: rows of (column, value). lineitem with missing quantities, events.

MISSING = "SELECT l_orderkey, CASE WHEN l_quantity >= 5 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount FROM lineitem"


def missing(spark, sf):
    """Small quantities are missing, as NULL or NaN."""
    q = F.when(F.col("l_quantity") >= 5, F.col("l_quantity")).when(F.col("l_quantity") < 3, F.lit(float("nan")))
    return t(spark, sf, "lineitem").select("l_orderkey", q.alias("l_quantity"), "l_extendedprice", "l_discount")


COLS = ["l_discount", "l_extendedprice", "l_quantity"]


def _by_column(value: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(f"round({v.replace('?', c)}, {digits}) + 0.0 AS {n}" for v, n in (x.rsplit(' AS ', 1) for x in value.split(';'))) + " FROM m" for c in COLS)


def _col(name: str, value: str, run: Callable[[DataFrame], DataFrame], digits: int = 4):
    query(f"WITH m AS ({MISSING}) " + _by_column(value, digits), name)(lambda spark, sf: rounded(run(missing(spark, sf)), digits))


_col("col_sum", "sum(?) AS sum", lambda d: stats.col_sum(d, COLS), 2)
_col("col_mean", "avg(?) AS mean", lambda d: stats.col_mean(d, COLS))
_col("col_var", "var_pop(?) AS var", lambda d: stats.col_var(d, COLS), 2)
_col("col_min", "min(?) AS min", lambda d: stats.col_min(d, COLS))
_col("col_max", "max(?) AS max", lambda d: stats.col_max(d, COLS))
_col("col_min_max", "min(?) AS min;max(?) AS max", lambda d: stats.col_min_max(d, COLS))
_col("col_norm_l1", "sum(abs(?)) AS norm", lambda d: stats.col_norm(d, COLS, "l1"), 2)
_col("col_norm_l2", "sqrt(sum(? * ?)) AS norm", lambda d: stats.col_norm(d, COLS, "l2"), 2)
_col("col_norm_max", "max(abs(?)) AS norm", lambda d: stats.col_norm(d, COLS, "max"))
_col("col_median", "quantile_cont(?, 0.5) AS median", lambda d: stats.col_median(d, COLS))

QS = [0.0, 0.25, 0.5, 0.9, 1.0]


@query(f"WITH m AS ({MISSING}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS q, round(quantile_cont({c}, {q}), 4) + 0.0 AS value FROM m" for c in COLS for q in QS))
def col_quantile_exact(spark, sf):
    return rounded(stats.col_quantile(missing(spark, sf), COLS, QS), 4)


_TOP = """SELECT * FROM (SELECT 'event_type' AS "column", event_type AS item, count(*) AS "count" FROM events GROUP BY 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 2 LIMIT 3)
    UNION ALL SELECT * FROM (SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY user_id HAVING count(*) >= 2 ORDER BY 3 DESC, user_id LIMIT 3)"""


@query(_TOP)
def col_frequent(spark, sf):
    return stats.col_frequent(t(spark, sf, "events"), ["event_type", "user_id"], 3, 2)


@query("SELECT DISTINCT 'event_type' AS \"column\", event_type AS item FROM events UNION ALL SELECT DISTINCT 'user_id', CAST(user_id AS VARCHAR) FROM events")
def col_union(spark, sf):
    return stats.col_union(t(spark, sf, "events"), ["event_type", "user_id"])


# Statistics by row over two parties' columns of part.

ROWS = "SELECT p_partkey, CASE WHEN p_size > 5 THEN -p_size::DOUBLE END AS s, p_retailprice AS r FROM part"


def vertical(spark, sf):
    part = t(spark, sf, "part")
    return [part.select("p_partkey", F.when(F.col("p_size") > 5, -F.col("p_size")).alias("s")), part.select("p_partkey", F.col("p_retailprice").alias("r"))]


for _name, _f, _sql in (
    ("row_sum", stats.row_sum, "coalesce(s, 0) + r AS sum"), ("row_min", stats.row_min, "least(s, r) AS min"), ("row_max", stats.row_max, "greatest(s, r) AS max"),
    ("row_min_max", stats.row_min_max, "least(s, r) AS min, greatest(s, r) AS max"),
    ("row_norm_l1", lambda p, k: stats.row_norm(p, k, "l1"), "coalesce(abs(s), 0) + abs(r) AS norm"),
    ("row_norm_l2", lambda p, k: stats.row_norm(p, k, "l2"), "sqrt(coalesce(s * s, 0) + r * r) AS norm"),
    ("row_norm_max", lambda p, k: stats.row_norm(p, k, "max"), "greatest(abs(s), abs(r)) AS norm"),
):
    _rounded = ", ".join(f"round({x.rsplit(' AS ', 1)[0]}, 4) AS {x.rsplit(' AS ', 1)[1]}" for x in _sql.replace(", greatest(s, r) AS max", "|greatest(s, r) AS max").split("|"))
    query(f"SELECT p_partkey, {_rounded} FROM ({ROWS})", _name)(lambda spark, sf, f=_f: rounded(f(vertical(spark, sf), "p_partkey"), 4))


# Missing and abnormal values: text columns with 'bad', 'NA' and missing values.

DIRTY = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN 'NA' WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS u,
    CASE WHEN event_id % 5 = 0 THEN '1x' WHEN event_id % 17 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS v FROM events"""


def dirty(spark, sf):
    e, i = t(spark, sf, "events"), F.col("event_id")
    u = F.when(i % 11 == 0, "bad").when(i % 7 == 0, "NA").when(i % 13 == 0, F.lit(None)).otherwise(F.col("user_id").cast("string"))
    v = F.when(i % 5 == 0, "1x").when(i % 17 == 0, F.lit(None)).otherwise(F.floor("value").cast("string"))
    return e.select("event_id", u.alias("u"), v.alias("v"))


KIND = {"u": "bigint", "v": "double"}


def _impute(name: str, how: str, u: str, v: str):
    sql = f"""WITH d AS ({DIRTY}), n AS (SELECT event_id, TRY_CAST(u AS BIGINT) AS u, TRY_CAST(v AS DOUBLE) AS v FROM d), f AS (SELECT {u} AS fu, {v} AS fv FROM n)
        SELECT event_id, coalesce(u, fu) AS u, round(coalesce(v, fv), 6) AS v FROM n, f"""
    query(sql, name)(lambda spark, sf: rounded(clean.impute(dirty(spark, sf), KIND, how)))


_impute("impute_max", "MAX", "max(u)", "max(v)")
_impute("impute_min", "MIN", "min(u)", "min(v)")
_impute("impute_avg", "AVG", "CAST(sum(u) // count(u) AS BIGINT)", "avg(v)")


@query(f"""WITH d AS ({DIRTY}), n AS (SELECT event_id, u, v, TRY_CAST(u AS BIGINT) AS nu, TRY_CAST(v AS DOUBLE) AS nv FROM d), f AS (SELECT CAST(floor(sum(nu) / count(nu)) AS BIGINT) AS fu, avg(nv) AS fv FROM n)
    SELECT event_id, CAST(CASE WHEN u = 'bad' THEN fu ELSE nu END AS DOUBLE) AS u, round(CASE WHEN v = '1x' THEN fv ELSE nv END, 6) AS v FROM n, f""")
def abnormal_fix(spark, sf):
    return rounded(clean.repair_mixed(dirty(spark, sf), KIND).withColumn("u", F.col("u").cast("double")))


@query(f"SELECT count(*) FILTER (u IS NULL OR u = 'NA') AS missing_u, count(*) FILTER (u = 'bad') AS abnormal_u, count(*) FILTER (v = '1x') AS abnormal_v FROM ({DIRTY})")
def abnormal_count(spark, sf):
    n = lambda c: F.count_if(c)
    return dirty(spark, sf).agg(n(clean.is_missing("u")).alias("missing_u"), n(clean.is_abnormal("u", "bigint")).alias("abnormal_u"), n(clean.is_abnormal("v", "double")).alias("abnormal_v"))


# Preprocessing on customer (unique key), or on part.


def customers(spark, sf):
    b = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))
    return t(spark, sf, "customer").select("c_custkey", b.alias("b"), "c_nationkey", "c_mktsegment")


CUST = "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS b, c_nationkey, c_mktsegment FROM customer"


def _module(name: str, make: Callable, sql: str, columns: str = "b", digits: int = 6, keep: list[str] | None = None):
    def run(spark, sf):
        out = make().fit_transform(customers(spark, sf))
        return rounded(out.select("c_custkey", *(keep or [c for c in out.columns if c not in ("c_custkey", "c_nationkey", "c_mktsegment")])), digits)

    query(f"WITH c AS ({CUST}) {sql}", name)(run)


_module("max_abs_scaler", lambda: scalers.MaxAbsScaler(["b"]), "SELECT c_custkey, round(b / (SELECT max(abs(b)) FROM c), 6) + 0.0 AS b FROM c")
_module("min_max_scaler", lambda: scalers.MinMaxScaler(["b"], feature_range=(-1, 2), clip=True), "SELECT c_custkey, round((b - lo) / (hi - lo) * 3 - 1, 6) + 0.0 AS b FROM c, (SELECT min(b) AS lo, max(b) AS hi FROM c)")
_module("standard_scaler", lambda: scalers.StandardScaler(["b"]), "SELECT c_custkey, round((b - m) / s, 6) + 0.0 AS b FROM c, (SELECT avg(b) AS m, stddev_pop(b) AS s FROM c)")
_module("robust_scaler", lambda: scalers.RobustScaler(["b"]), "SELECT c_custkey, round((b - m) / (h - l), 6) + 0.0 AS b FROM c, (SELECT quantile_cont(b, 0.5) AS m, quantile_cont(b, 0.25) AS l, quantile_cont(b, 0.75) AS h FROM c)")
_module(
    "normalizer", lambda: scalers.Normalizer(["b", "c_nationkey"], norm="l1"),
    "SELECT c_custkey, round(b / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0.0 AS b, round(c_nationkey / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0.0 AS c_nationkey FROM (SELECT *, coalesce(abs(b), 0) + abs(c_nationkey) AS n FROM c)",
    keep=["b", "c_nationkey"],
)
_module("imputer_mean", lambda: imputer.SimpleImputer(["b"], add_indicator=True), "SELECT c_custkey, round(coalesce(b, (SELECT avg(b) FROM c)), 4) AS b, CAST(b IS NULL AS INT) AS missing_b FROM c", digits=4)
_module("imputer_median", lambda: imputer.SimpleImputer(["b"], strategy="median"), "SELECT c_custkey, round(coalesce(b, (SELECT median(b) FROM c)), 4) AS b FROM c", digits=4)
_module("imputer_constant", lambda: imputer.SimpleImputer(["b"], strategy="constant", fill_value=-1.5), "SELECT c_custkey, coalesce(b, -1.5) AS b FROM c")
_module(
    "imputer_most_frequent", lambda: imputer.SimpleImputer(["c_mktsegment"], strategy="most_frequent", missing_values="BUILDING"),
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN (SELECT c_mktsegment FROM c WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ELSE c_mktsegment END AS c_mktsegment FROM c",
    keep=["c_mktsegment"],
)
_module("kbins_uniform", lambda: encoders.KBinsDiscretizer(["b"], n_bins=4, strategy="uniform"), "SELECT c_custkey, CASE WHEN b IS NOT NULL THEN least(floor((b - lo) / (hi - lo) * 4), 3) END::DOUBLE AS b FROM c, (SELECT min(b) AS lo, max(b) AS hi FROM c)")
_module(
    "kbins_quantile", lambda: encoders.KBinsDiscretizer(["b"], n_bins=4),
    "SELECT c_custkey, CASE WHEN b IS NOT NULL THEN CAST(b >= q1 AS INT) + CAST(b >= q2 AS INT) + CAST(b >= q3 AS INT) END::DOUBLE AS b FROM c, (SELECT quantile_cont(b, 0.25) AS q1, quantile_cont(b, 0.5) AS q2, quantile_cont(b, 0.75) AS q3 FROM c)",
)
_module(
    "kbins_onehot", lambda: encoders.KBinsDiscretizer(["b"], n_bins=2, strategy="uniform", encode="onehot"),
    "SELECT c_custkey, CAST(coalesce(b < (lo + hi) / 2, false) AS INT) AS b_0, CAST(coalesce(b >= (lo + hi) / 2, false) AS INT) AS b_1 FROM c, (SELECT min(b) AS lo, max(b) AS hi FROM c)",
)
SEG = "c_mktsegment"
_module("label_encoder", lambda: encoders.LabelEncoder([SEG]), "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS c_mktsegment FROM c", keep=[SEG])
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_hot = lambda names: ", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS c_mktsegment_{s}" for s in names)
_module("label_binarizer", lambda: encoders.LabelBinarizer([SEG]), f"SELECT c_custkey, {_hot(SEGMENTS)} FROM c", keep=[f"{SEG}_{s}" for s in SEGMENTS])
_module("one_hot", lambda: encoders.OneHotEncoder([SEG], drop="first"), f"SELECT c_custkey, {_hot(SEGMENTS[1:])} FROM c", keep=[f"{SEG}_{s}" for s in SEGMENTS[1:]])
_module("ordinal", lambda: encoders.OrdinalEncoder([SEG]), "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c_mktsegment FROM c", keep=[SEG])


@query(f"""WITH c AS ({CUST}), g AS (SELECT c_nationkey, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS r FROM c GROUP BY 1)
    SELECT c_custkey, coalesce(code, 4)::DOUBLE AS c_nationkey FROM c LEFT JOIN (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS code FROM g WHERE r <= 4) USING (c_nationkey)""")
def infrequent(spark, sf):
    return encoders.OrdinalEncoder(["c_nationkey"], max_categories=5).fit_transform(customers(spark, sf)).select("c_custkey", "c_nationkey")


@query("SELECT doc_id, CAST(quality = 1 AS INT) AS labels_quality, CAST(toxic = 1 AS INT) AS labels_toxic FROM labels")
def multi_label_binarizer(spark, sf):
    df = t(spark, sf, "labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))).alias("labels"))
    return encoders.MultiLabelBinarizer(["labels"], classes=["quality", "toxic"]).fit_transform(df)


_module(
    "target_encoder", lambda: encoders.TargetEncoder([SEG], "b", smooth=10),
    "SELECT c_custkey, round((10 * m + s) / (10 + n), 6) AS c_mktsegment FROM c JOIN (SELECT c_mktsegment, sum(b) AS s, count(b) AS n FROM c GROUP BY 1) USING (c_mktsegment), (SELECT avg(b) AS m FROM c)", keep=[SEG],
)
_module(
    "target_encoder_auto", lambda: encoders.TargetEncoder([SEG], "b"),
    """SELECT c_custkey, round(v * n / (v * n + w) * a + (1 - v * n / (v * n + w)) * m, 4) AS c_mktsegment FROM c JOIN (SELECT c_mktsegment, avg(b) AS a, count(b) AS n, var_pop(b) AS w FROM c GROUP BY 1) USING (c_mktsegment),
    (SELECT avg(b) AS m, var_pop(b) AS v FROM c)""", digits=4, keep=[SEG],
)


# Metrics and models.

SCORED = "SELECT l.quality AS y, (d.doc_id * 37 % 101) / 100.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id)"


def scored(spark, sf):
    d = t(spark, sf, "documents").select("doc_id")
    return t(spark, sf, "labels").join(d, "doc_id").select(F.col("quality").alias("y"), ((F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("p"))


@query("""SELECT round(1 - var_pop(y - p) / var_pop(y), 6) AS ev, round(max(abs(y - p)), 6) AS maxe, round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 6) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
    round(avg((ln(1 + y) - ln(1 + p)) * (ln(1 + y) - ln(1 + p))), 6) AS msle, round(median(abs(y - p)), 6) AS medae, round(avg(abs(y - p) / y), 6) AS mape, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2
    FROM (SELECT l_quantity AS y, l_extendedprice / 2000 AS p FROM lineitem)""")
def regression_metrics(spark, sf):
    return rounded(metrics.regression(t(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000).alias("p"))))


@query(f"""SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS acc, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM
    (SELECT count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y = 0 AND p > 0.5) AS fp, count(*) FILTER (y = 1 AND p <= 0.5) AS fn, count(*) FILTER (y = 0 AND p <= 0.5) AS tn FROM ({SCORED}))""")
def classification_metrics(spark, sf):
    return rounded(metrics.classification(scored(spark, sf)))


@query("""WITH c AS (SELECT l_linestatus AS y, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS p FROM lineitem), k AS (SELECT DISTINCT y AS c FROM c),
    e AS (SELECT c, (SELECT count(*) FROM c WHERE y = k.c AND p = k.c) AS tp, (SELECT count(*) FROM c WHERE y = k.c) AS o, (SELECT count(*) FROM c WHERE p = k.c) AS s FROM k)
    SELECT round(sum(tp) / sum(o), 6) AS acc, round(avg(tp / s), 6) AS "precision", round(avg(tp / o), 6) AS recall, round(avg(2 * tp / (s + o)), 6) AS f1 FROM e""")
def multiclass_metrics(spark, sf):
    return rounded(metrics.multiclass(t(spark, sf, "lineitem").select(F.col("l_linestatus").alias("y"), F.when(F.col("l_quantity") > 25, "F").otherwise("O").alias("p"))))


_ROC = f"""WITH s AS ({SCORED}), b AS (SELECT p AS threshold, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM s GROUP BY 1),
    r AS (SELECT threshold, sum(neg) OVER w / (SELECT sum(neg) FROM b) AS fpr, sum(pos) OVER w / (SELECT sum(pos) FROM b) AS tpr FROM b WINDOW w AS (ORDER BY threshold DESC))"""


@query(f"{_ROC} SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM r")
def roc_curve(spark, sf):
    return rounded(metrics.roc(scored(spark, sf)))


@query(f"{_ROC} SELECT round(greatest(max(tpr - fpr), 0), 6) AS ks FROM r")
def ks_statistic(spark, sf):
    return rounded(metrics.ks(scored(spark, sf)))


@query(f"WITH s AS ({SCORED}) SELECT round(avg(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END), 6) AS auc FROM s a, s b WHERE a.y = 1 AND b.y = 0")
def auc(spark, sf):
    return rounded(metrics.auc(scored(spark, sf)))


def priced(spark, sf):
    li = t(spark, sf, "lineitem").where("l_quantity IS NOT NULL")
    return li.select("l_orderkey", (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_extendedprice") / 100000).alias("y"), (F.col("l_quantity") > 25).cast("int").alias("big"))


# What gradient descent converges to: the least-squares solution, in closed form.
@query("""WITH p AS (SELECT (l_quantity - 25.5) / 14.4 AS q, l_extendedprice / 100000 AS y FROM lineitem) SELECT 'q' AS feature, round(regr_slope(y, q), 3) AS weight FROM p UNION ALL SELECT 'bias', round(regr_intercept(y, q), 3) FROM p""")
def linear_regression(spark, sf):
    centred = priced(spark, sf).withColumn("q", (F.col("q") * 50 - 25.5) / 14.4)
    m = linear.fit(centred, ["q"], "y", epochs=15, rate=0.95)
    return rounded(spark.createDataFrame(list(zip(["q", "bias"], m.weights, strict=True)), "feature string, weight double"), 3)


@query("""SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS "rows", round(sum(value), 9) AS value_sum, round(avg(value), 9) AS value_mean,
    min(value) AS value_min, max(value) AS value_max, round(var_pop(value), 6) AS value_var FROM events GROUP BY ALL""")
def windowed_statistics(spark, sf):
    out = streaming.windowed(t(spark, sf, "events"), "ts", ["value"], "1 day", by=["event_type"])
    return rounded(out.withColumn("value_var", F.round("value_var", 6)), 9)
