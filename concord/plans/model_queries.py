"""Registered queries over models, metrics and fitted transforms, each beside the SQL that must give the same rows.

The SQL of a model is its own steps written out: each step of gradient descent, and each level
of a tree, is a common table expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from concord.operators import stats
from concord.operators.ml import boosting, linear, metrics, mlp
from concord.operators.preprocess import encoders, transformers
from concord.operators.preprocess.pipeline import PreprocessPipeline, check_sketch
from concord.plans.queries import CUST, SCORED, SEG, customers, priced, query, rounded, scored, t
from concord.plans.source_queries import refused, said

# Gradient descent, written out.

PRICED = "SELECT l_orderkey % 3 AS party, l_quantity / 50 AS q, l_discount * 10 AS d, l_extendedprice / 100000 AS y, CAST(l_quantity > 25 AS DOUBLE) AS big FROM lineitem"
LINK = {"linear": "({z})", "logistic": "(1 / (1 + exp(-({z}))))", "piecewise": "(CASE WHEN ({z}) < -0.5 THEN 0 WHEN ({z}) >= 0.5 THEN 1 ELSE ({z}) + 0.5 END)", "taylor": "(0.5 + ({z}) / 4)"}


def descent(x: list[str], y: str, kind: str, epochs: int, rate: float, l2: float = 0.0, clip: float | None = None, source: str = "p") -> list[str]:
    """Common table expressions w0 to w<epochs>, of one row each: a weight for each of x, then the bias."""
    n, out = len(x), ["w0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS a{i}" for i in range(len(x) + 1)) + ")"]
    z = " + ".join([*(f"a{i} * {c}" for i, c in enumerate(x)), f"a{n}"])
    err = f"({LINK[kind].format(z=z)} - {y})"
    if clip is not None:
        err = f"({err} / greatest(1.0, sqrt({' + '.join(f'{c} * {c}' for c in x)} + 1) * abs({err}) / {clip}))"
    for k in range(epochs):
        steps = [f"any_value(a{i}) - {rate} * (avg({err} * {c})" + (f" + {l2} * any_value(a{i}))" if i < n else ")") + f" AS a{i}" for i, c in enumerate([*x, "1"])]
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT {', '.join(steps)} FROM {source}, w{k})")
    return out


def weights_sql(x: list[str], y: str, kind: str, epochs: int, rate: float, digits: int = 5, source: str = PRICED, **options) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(a{i}, {digits}) + 0.0 AS weight FROM w{epochs}" for i, c in enumerate([*x, "bias"]))
    return f"WITH p AS ({source}), {', '.join(descent(x, y, kind, epochs, rate, **options))} {rows}"


def weights(spark, m, digits: int = 5):
    return rounded(said(spark, list(zip([*m.features, "bias"], map(float, m.weights), strict=True)), "feature string, weight double"), digits)


for _name, _kind, _label, _sql, _rate in (
    ("logistic_regression", "logistic", "big", "big", 2.0), ("logistic_piecewise", "piecewise", "big", "big", 1.0), ("logistic_taylor", "taylor", "big", "big", 1.0), ("linear_l2", "linear", "y", "y", 0.3),
):
    _l2 = 0.01 if _name == "linear_l2" else 0.0
    query(weights_sql(["q", "d"], _sql, _kind, 8, _rate, l2=_l2), _name)(
        lambda spark, sf, kind=_kind, label=_label, rate=_rate, l2=_l2: weights(spark, linear.fit(priced(spark, sf), ["q", "d"], label, kind, epochs=8, rate=rate, l2=l2))
    )


@query(weights_sql(["q", "d"], "y", "linear", 6, 0.5, clip=0.5))
def private_linear(spark, sf):
    """Gradients clipped row by row, as a private fit has them, without its noise."""
    return weights(spark, linear.fit(priced(spark, sf), ["q", "d"], "y", epochs=6, rate=0.5, clip=0.5))


@query("SELECT * FROM (VALUES ('noise adds up to a finite epsilon', true), ('more steps cost more', true), ('a share of the rows costs less', true), ('weights differ by noise', true)) x(claim, holds)")
def private_budget(spark, sf):
    m = linear.fit(priced(spark, sf), ["q"], "y", epochs=5, clip=1.0, noise=1.0)
    plain = linear.fit(priced(spark, sf), ["q"], "y", epochs=5, clip=1.0)
    e = linear.private_epsilon
    claims = {
        "noise adds up to a finite epsilon": 0 < m.epsilon < float("inf"), "more steps cost more": e(1.0, 1.0, 10, 1e-5) > m.epsilon, "a share of the rows costs less": e(0.1, 1.0, 5, 1e-5) < m.epsilon,
        "weights differ by noise": m.weights != plain.weights,
    }
    return said(spark, list(claims.items()), "claim string, holds boolean")


def fedavg_sql(kind: str, y: str, rounds: int, local: int, rate: float, weighted: bool) -> str:
    x = ["q", "d"]
    names = [f"a{i}" for i in range(3)]
    err = f"({LINK[kind].format(z='a0 * q + a1 * d + a2')} - {y})"
    out = ["g0 AS (SELECT 0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2)"]
    for r in range(rounds):
        last = f"l{r}_0 AS (SELECT party, count(*) AS n, any_value(a0) AS a0, any_value(a1) AS a1, any_value(a2) AS a2 FROM p, g{r} GROUP BY party)"
        out.append(last)
        for k in range(local):
            steps = ", ".join(f"any_value({a}) - {rate} * avg({err} * {c}) AS {a}" for a, c in zip(names, [*x, "1"], strict=True))
            out.append(f"l{r}_{k + 1} AS MATERIALIZED (SELECT party, count(*) AS n, {steps} FROM p JOIN l{r}_{k} USING (party) GROUP BY party)")
        share = "n" if weighted else "1"
        out.append(f"g{r + 1} AS MATERIALIZED (SELECT " + ", ".join(f"sum({a} * {share}) / sum({share}) AS {a}" for a in names) + f" FROM l{r}_{local})")
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, round({a}, 5) + 0.0 AS weight FROM g{rounds}" for a, c in zip(names, ["q", "d", "bias"], strict=True))
    # Parties of different sizes, so that examples weigh.
    return f"WITH p AS (SELECT * REPLACE (CAST(l_part AS BIGINT) AS party) FROM (SELECT *, CASE WHEN party = 0 THEN 0 ELSE 1 END AS l_part FROM ({PRICED}))), {', '.join(out)} {rows}"


def two_parties(spark, sf):
    p = priced(spark, sf)
    return stats.union({"p0": p.where("l_orderkey % 3 = 0"), "p1": p.where("l_orderkey % 3 <> 0")})


for _name, _kind, _label, _rate, _weighted in (
    ("federated_average", "linear", "y", 0.3, True), ("federated_unweighted", "linear", "y", 0.3, False), ("federated_logistic", "logistic", "big", 2.0, True), ("federated_taylor", "taylor", "big", 1.0, False),
):
    query(fedavg_sql(_kind, _label, 3, 2, _rate, _weighted), _name)(
        lambda spark, sf, kind=_kind, label=_label, rate=_rate, weighted=_weighted: weights(
            spark, linear.fedavg(two_parties(spark, sf), ["q", "d"], label, kind, rounds=3, local_epochs=2, rate=rate, weighted=weighted)
        )
    )

_VERTICAL = "SELECT o_totalprice / 100000 AS x, CAST(o_orderstatus = 'F' AS DOUBLE) AS y, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS z FROM orders"


def vertical_parties(spark, sf):
    o = t(spark, sf, "orders")
    host = o.select("o_orderkey", (F.col("o_totalprice") / 100000).alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return [host, o.select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("double").alias("z"))]


@query(weights_sql(["x", "z"], "y", "logistic", 5, 0.1, source=_VERTICAL))
def vertical_logistic(spark, sf):
    return weights(spark, linear.fit_vertical(vertical_parties(spark, sf), "o_orderkey", ["x", "z"], "y", kind="logistic", epochs=5))


@query(weights_sql(["x", "z"], "y", "linear", 5, 0.05, source=_VERTICAL))
def vertical_linear(spark, sf):
    return weights(spark, linear.fit_vertical(vertical_parties(spark, sf), "o_orderkey", ["x", "z"], "y", epochs=5, rate=0.05))


@query(f"WITH p AS ({PRICED}), {', '.join(descent(['q'], 'y', 'linear', 4, 0.5))} SELECT round(q, 6) AS q, round(a0 * q + a1, 5) AS p FROM p, w4")
def predicted_column(spark, sf):
    """A model's predictions beside its input."""
    p = priced(spark, sf)
    return rounded(linear.fit(p, ["q"], "y", epochs=4, rate=0.5).predict(p).select(F.round("q", 6).alias("q"), F.round("p", 5).alias("p")), None)


def mpc_task(name: str, label: str, kind: str):
    def run(spark, sf):
        from concord.catalog import Catalog
        from concord.plans.task import Runner

        c = Catalog(spark)
        for p, df in stats.split_parties(priced(spark, sf), "l_orderkey", 3).items():
            c.put(p, df)
        r = Runner(spark, c)
        job = r.submit({"algorithm": name, "parties": {f"P{i}": f"party{i}" for i in range(3)}, "params": {"features": ["q"], "label": label, "NumIters": 5, "options": {"rate": 0.5}}})
        return rounded(r.result(job, "P0").agg(F.count("*").alias("n"), F.sum("p").alias("total")), 3)

    link = LINK[kind].format(z="a0 * q + a1")
    query(f"WITH p AS ({PRICED}), {', '.join(descent(['q'], label, kind, 5, 0.5))} SELECT count(*) AS n, round(sum({link}), 3) AS total FROM p, w5", name)(run)


mpc_task("mpc_logistic", "big", "piecewise")
mpc_task("mpc_linear", "y", "linear")


def softmax_sql(epochs: int, rate: float) -> str:
    x, out = ["q", "d", "1"], ["w0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS a{k}{i}" for k in range(3) for i in range(3)) + ")"]
    e = [f"exp(a{k}0 * q + a{k}1 * d + a{k}2)" for k in range(3)]
    for n in range(epochs):
        err = [f"({e[k]} / ({' + '.join(e)}) - CAST(c = {k} AS DOUBLE))" for k in range(3)]
        out.append(f"w{n + 1} AS MATERIALIZED (SELECT " + ", ".join(f"any_value(a{k}{i}) - {rate} * avg({err[k]} * {x[i]}) AS a{k}{i}" for k in range(3) for i in range(3)) + f" FROM p, w{n})")
    rows = " UNION ALL ".join(f"SELECT {k} AS class, '{c}' AS feature, round(a{k}{i}, 5) + 0.0 AS weight FROM w{epochs}" for k in range(3) for i, c in enumerate(["q", "d", "bias"]))
    return f"WITH p AS (SELECT *, CASE WHEN y < 0.2 THEN 0 WHEN y < 0.4 THEN 1 ELSE 2 END AS c FROM ({PRICED})), {', '.join(out)} {rows}"


@query(softmax_sql(4, 1.0))
def softmax_regression(spark, sf):
    p = priced(spark, sf).withColumn("c", F.when(F.col("y") < 0.2, 0).when(F.col("y") < 0.4, 1).otherwise(2))
    m = linear.fit_softmax(p, ["q", "d"], "c", 3, epochs=4, rate=1.0)
    return rounded(said(spark, [(k, c, float(v)) for k, w in enumerate(m.weights) for c, v in zip(["q", "d", "bias"], w, strict=True)], "class int, feature string, weight double"), 5)


def mlp_sql(rounds: int, local: int, rate: float, seed: int) -> str:
    """Two inputs, two ReLU units, a sigmoid; weights in order: u0v0 u0v1 u1v0 u1v1, b0 b1, o0 o1, c."""
    first = mlp.first_weights([2, 2, 1], seed)
    names = [f"k{i}" for i in range(9)]
    z = ["(k0 * q + k2 * d + k4)", "(k1 * q + k3 * d + k5)"]
    h = [f"greatest({v}, 0)" for v in z]
    err = f"(1 / (1 + exp(-(k6 * {h[0]} + k7 * {h[1]} + k8))) - big)"
    on = [f"CAST({v} > 0 AS DOUBLE)" for v in z]
    d = [f"({err} * k{6 + i} * {on[i]})" for i in range(2)]
    grads = [f"{d[0]} * q", f"{d[1]} * q", f"{d[0]} * d", f"{d[1]} * d", d[0], d[1], f"{err} * {h[0]}", f"{err} * {h[1]}", err]
    out = ["g0 AS (SELECT " + ", ".join(f"{v!r}::DOUBLE AS {n}" for v, n in zip(first, names, strict=True)) + ")"]
    for r in range(rounds):
        out.append(f"l{r}_0 AS (SELECT party, count(*) AS n, " + ", ".join(f"any_value({k}) AS {k}" for k in names) + f" FROM p, g{r} GROUP BY party)")
        for s in range(local):
            out.append(f"l{r}_{s + 1} AS MATERIALIZED (SELECT party, count(*) AS n, " + ", ".join(f"any_value({k}) - {rate} * avg({g}) AS {k}" for k, g in zip(names, grads, strict=True)) + f" FROM p JOIN l{r}_{s} USING (party) GROUP BY party)")
        out.append(f"g{r + 1} AS MATERIALIZED (SELECT " + ", ".join(f"sum({k} * n) / sum(n) AS {k}" for k in names) + f" FROM l{r}_{local})")
    rows = " UNION ALL ".join(f"SELECT {i} AS place, round({k}, 5) + 0.0 AS weight FROM g{rounds}" for i, k in enumerate(names))
    return f"WITH p AS (SELECT * REPLACE (CASE WHEN party = 0 THEN 0 ELSE 1 END AS party) FROM ({PRICED})), {', '.join(out)} {rows}"


@query(mlp_sql(2, 2, 0.5, 3))
def perceptron(spark, sf):
    """Learned by two parties, averaged layer by layer."""
    m = mlp.fit_mlp(two_parties(spark, sf), ["q", "d"], "big", [2], rounds=2, local_epochs=2, rate=0.5, seed=3)
    return rounded(said(spark, [(i, float(v)) for i, v in enumerate(m.weights)], "place int, weight double"), 5)


# A reference in plain numpy, over rows that a generator makes.


def generated(n: int, weights: list[float], noise: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows x in [-1, 1) and y = x . weights[:-1] + weights[-1] + noise."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, len(weights) - 1))
    return x, x @ np.array(weights[:-1]) + weights[-1] + noise * rng.normal(size=n)


def plain_logistic(x: np.ndarray, y: np.ndarray, epochs: int, rate: float) -> np.ndarray:
    """Logistic regression without Spark."""
    x, w = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1)
    for _ in range(epochs):
        w -= rate * x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y)
    return w


@query("SELECT * FROM (VALUES ('linear weights are found', true), ('logistic weights are those without Spark', true)) x(claim, holds)")
def generated_models(spark, sf):
    x, y = generated(500, [2.0, -1.0, 0.5])
    df = said(spark, [(float(a), float(b), float(v), int(v > 0.5)) for (a, b), v in zip(x, y, strict=True)], "a double, b double, y double, c int")
    m = linear.fit(df, ["a", "b"], "y", epochs=60, rate=0.9)
    n = linear.fit(df, ["a", "b"], "c", "logistic", epochs=12, rate=1.5)
    return said(spark, [
        ("linear weights are found", bool(np.allclose(m.weights, [2, -1, 0.5], atol=1e-3))), ("logistic weights are those without Spark", bool(np.allclose(n.weights, plain_logistic(x, y > 0.5, 12, 1.5)))),
    ], "claim string, holds boolean")


# Boosted trees, written out: two trees of two levels, cut points at equal steps.

BINS, TREES, RATE = 8, 2, 0.3


def trees_sql() -> str:
    feats = ["q", "d"]
    out = [
        "r0 AS (SELECT row_number() OVER () AS id, q, d, CAST(y > 0.3 AS DOUBLE) AS y, 0.0::DOUBLE AS m FROM (" + PRICED + "))",
        "e AS (" + " UNION ALL ".join(f"SELECT {i} AS f, k AS b, (SELECT min({c}) + (max({c}) - min({c})) * k / {BINS} FROM r0) AS cut FROM range(1, {BINS}) x(k)" for i, c in enumerate(feats)) + ")",
        "b0 AS MATERIALIZED (SELECT r0.id, " + ", ".join(f"(SELECT count(*) FROM e WHERE f = {i} AND r0.{c} > cut) AS b{i}" for i, c in enumerate(feats)) + " FROM r0)",
    ]
    for k in range(TREES):
        out.append(f"h{k}_0 AS MATERIALIZED (SELECT r{k}.id, b0, b1, 1 / (1 + exp(-m)) - y AS g, (1 / (1 + exp(-m))) * (1 - 1 / (1 + exp(-m))) AS h, 1 AS node FROM r{k} JOIN b0 USING (id))")
        for level in range(2):
            src = f"h{k}_{level}"
            out += [
                f"t{src} AS MATERIALIZED (SELECT node, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {src} GROUP BY 1)",
                f"c{src} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT node, {i} AS f, b{i} AS b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {src} GROUP BY 1, 3" for i in range(2)) + ")",
                f"s{src} AS MATERIALIZED (SELECT node, f, b, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl FROM c{src} WINDOW w AS (PARTITION BY node, f ORDER BY b))",
                f"v{src} AS MATERIALIZED (SELECT x.node, f, b, gl * gl / (hl + 1) / 2 + (g - gl) * (g - gl) / (h - hl + 1) / 2 - g * g / (h + 1) / 2 AS gain FROM s{src} x JOIN t{src} y ON x.node = y.node WHERE least(hl, h - hl) >= 1 AND least(nl, n - nl) >= 1)",
                f"w{src} AS MATERIALIZED (SELECT node, f, b FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, b) AS k FROM v{src} WHERE gain > 1e-12) WHERE k = 1)",
                f"h{k}_{level + 1} AS MATERIALIZED (SELECT id, b0, b1, g, h, CASE WHEN f IS NULL THEN -abs(x.node) WHEN (CASE WHEN f = 0 THEN b0 ELSE b1 END) > b THEN 2 * x.node + 1 ELSE 2 * x.node END AS node FROM {src} x LEFT JOIN w{src} y ON x.node = y.node AND x.node > 0)",
            ]
        out.append(f"f{k} AS MATERIALIZED (SELECT node, -sum(g) / (sum(h) + 1) AS leaf FROM h{k}_2 GROUP BY 1)")
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT r{k}.id, q, d, y, m + {RATE} * leaf AS m FROM r{k} JOIN h{k}_2 x ON x.id = r{k}.id JOIN f{k} USING (node))")
    return f"WITH {', '.join(out)} SELECT round(q, 4) AS q, round(d, 4) AS d, round(1 / (1 + exp(-m)), 5) AS p, CAST(m >= 0 AS INT) AS p_label, count(*) AS n FROM r{TREES} GROUP BY ALL"


def dear(spark, sf):
    return priced(spark, sf).withColumn("dear", (F.col("y") > 0.3).cast("int"))


@query(trees_sql())
def boosted_trees(spark, sf):
    rows = dear(spark, sf)
    m = boosting.train(rows, ["q", "d"], "dear", trees=TREES, depth=2, rate=RATE, bins=BINS, uniform=True)
    out = m.predict(rows).select(F.round("q", 4).alias("q"), F.round("d", 4).alias("d"), F.round("p", 5).alias("p"), "p_label")
    return out.groupBy("q", "d", "p", "p_label").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT q, d, CAST(y > 0.3 AS DOUBLE) - 0.5 AS g FROM ({PRICED})), l AS (SELECT min(q) AS ql, max(q) AS qh, min(d) AS dl, max(d) AS dh FROM r),
    b AS (SELECT -g AS g, {" + ".join(f"CAST(q > ql + (qh - ql) * {k} / 4 AS INT)" for k in (1, 2, 3))} AS bq, {" + ".join(f"CAST(d > dl + (dh - dl) * {k} / 4 AS INT)" for k in (1, 2, 3))} AS bd FROM r, l)
    SELECT 0 AS node, 0 AS f, bq AS b, round(sum(g), 4) AS g, round(sum(0.25), 4) + 0.0 AS h, count(*) AS n FROM b GROUP BY bq UNION ALL SELECT 0, 1, bd, round(sum(g), 4), round(sum(0.25), 4) + 0.0, count(*) FROM b GROUP BY bd""")
def gradient_sums(spark, sf):
    """Gradients, hessians and counts by node, feature and bucket, in one aggregate."""
    rows = dear(spark, sf)
    cuts = boosting.cut_points(rows, ["q", "d"], 4, uniform=True)
    rows = rows.select(F.lit(0).alias("node"), (0.5 - F.col("dear")).alias("g"), F.lit(0.25).alias("h"), *(b.alias(f"_b_{c}") for c, b in boosting.bucketed(rows, cuts).items()))
    return rounded(boosting.gradient_sums(rows, ["q", "d"]), 4)


@query("SELECT * FROM (VALUES ('rows by gradient', true), ('a share of rows', true), ('a share of columns', true), ('least rows of a leaf', true)) x(sampling, learns)")
def boosted_sampling(spark, sf):
    """Whether the ways to sample leave a model that is better than the share of its label."""
    rows = dear(spark, sf).select("q", "d", "dear").persist()
    share = rows.agg(F.avg("dear")).first()[0]
    base, cuts = max(share, 1 - share), boosting.cut_points(rows, ["q", "d"], 32)
    ways = {"rows by gradient": {"goss": (0.3, 0.3)}, "a share of rows": {"row_share": 0.5}, "a share of columns": {"column_share": 0.5, "trees": 4}, "least rows of a leaf": {"min_child_sample": 50}}
    out = []
    for name, options in ways.items():
        m = boosting.train(rows, ["q", "d"], "dear", depth=2, cuts=cuts, **({"trees": 2} | options))
        out.append((name, bool(metrics.classification(m.predict(rows), "dear").first().acc >= base)))
    rows.unpersist()
    return said(spark, out, "sampling string, learns boolean")


# Metrics.


@query(f"""WITH s AS ({SCORED}), k AS (SELECT *, CASE WHEN p < 0.3 THEN 0 WHEN p < 0.6 THEN 1 ELSE 2 END AS c FROM s), o AS (SELECT c, [1 - p, p * (1 - p), p] AS a FROM k)
    SELECT round(avg(auc), 6) AS auc FROM (SELECT i, avg(CASE WHEN x.a[i + 1] > y.a[i + 1] THEN 1 WHEN x.a[i + 1] = y.a[i + 1] THEN 0.5 ELSE 0 END) AS auc FROM o x, o y, range(3) t(i) WHERE x.c = i AND y.c <> i GROUP BY i)""")
def auc_one_vs_rest(spark, sf):
    s = scored(spark, sf)
    p = F.col("p")
    s = s.select(F.when(p < 0.3, 0).when(p < 0.6, 1).otherwise(2).alias("y"), F.array(1 - p, p * (1 - p), p).alias("p"))
    return rounded(metrics.auc_ovr(s, "y", "p", [0, 1, 2]))


@query("SELECT * FROM (VALUES (0.0, 0.25), (0.5, 0.725), (1.0, 1.0)) x(fpr, tpr)")
def roc_merging(spark, sf):
    """Parties' curves averaged at each false-positive rate, by examples."""
    grid, tpr = metrics.merged_roc([([0.0, 0.5, 1.0], [0.0, 0.7, 1.0], 300), ([0.0, 0.5, 1.0], [1.0, 0.8, 1.0], 100)])
    return rounded(said(spark, [(float(a), float(b)) for a, b in zip(grid, tpr, strict=True)], "fpr double, tpr double"))


@query("SELECT round(sum(m * n) / sum(n), 6) AS mae FROM (SELECT l_orderkey % 3 AS k, avg(abs(l_quantity - 25)) AS m, count(*) AS n FROM lineitem WHERE l_orderkey % 7 > 2 OR l_orderkey % 3 > 0 GROUP BY 1)")
def metric_averaging(spark, sf):
    li = t(spark, sf, "lineitem").where("l_orderkey % 7 > 2 OR l_orderkey % 3 > 0").select("l_orderkey", F.col("l_quantity").alias("y"), F.lit(25.0).alias("p"))
    parts = [(metrics.regression(df, only=["mae"]).first().asDict(), df.count()) for df in stats.split_parties(li, "l_orderkey", 3).values()]
    return rounded(said(spark, [(metrics.averaged(parts)["mae"],)], "mae double"))


# Fitted transforms.


def _yeo(l: str) -> str:  # noqa: E741
    return f"(CASE WHEN b >= 0 THEN (power(b + 1, {l}) - 1) / {l} ELSE -(power(1 - b, 2 - {l}) - 1) / (2 - {l}) END)"


# The exponent of the largest likelihood, by a grid that is refined around its best point.
_GRID = "SELECT g, -n / 2 * ln(v) + (g - 1) * s AS fit FROM (SELECT g, count(b) AS n, var_pop(" + _yeo("g") + ") AS v, sum(sign(b) * ln(1 + abs(b))) AS s FROM c, {grid} WHERE b IS NOT NULL GROUP BY g)"


@query(
    f"WITH c AS ({CUST}), g1 AS ({_GRID.format(grid='(SELECT -1.02 + i * 0.1 AS g FROM range(41) t(i))')}), m1 AS (SELECT arg_max(g, fit) AS g FROM g1), "
    f"g2 AS ({_GRID.format(grid='(SELECT m1.g + (i - 20) * 0.0101 AS g FROM m1, range(41) t(i))')}), m2 AS (SELECT arg_max(g, fit) AS g FROM g2), "
    f"g3 AS ({_GRID.format(grid='(SELECT m2.g + (i - 20) * 0.00101 AS g FROM m2, range(41) t(i))')}), m3 AS (SELECT arg_max(g, fit) AS g FROM g3), "
    f"y AS (SELECT c_custkey, {_yeo('g')} AS v FROM c, m3), "
    "z AS (SELECT (v - (SELECT avg(v) FROM y)) / (SELECT stddev_pop(v) FROM y) AS b FROM y) "
    "SELECT count(b) AS n, round(min(b), 2) AS least, round(max(b), 2) AS most, round(avg(b * b * b), 2) + 0.0 AS third, round(avg(b * b * b * b), 2) AS fourth FROM z"
)
def power_transformer(spark, sf):
    """What the transform makes of the distribution, to two places, for the search has an error of its own."""
    b = F.col("b")
    out = transformers.PowerTransformer(["b"]).fit_transform(customers(spark, sf))
    return rounded(out.agg(F.count(b).alias("n"), F.min(b).alias("least"), F.max(b).alias("most"), F.avg(b * b * b).alias("third"), F.avg(b * b * b * b).alias("fourth")), 2)


@query(f"""WITH c AS ({CUST}), v AS (SELECT i, quantile_cont(b, i / 99.0) AS x FROM c, range(100) t(i) GROUP BY i) SELECT c_custkey,
    CASE WHEN b IS NULL THEN NULL WHEN b <= (SELECT min(x) FROM v) THEN 0 WHEN b >= (SELECT max(x) FROM v) THEN 1 ELSE round((lo.i + (b - lo.x) / (hi.x - lo.x)) / 99, 6) END + 0.0 AS b
    FROM c LEFT JOIN LATERAL (SELECT i, x FROM v WHERE x <= c.b ORDER BY i DESC LIMIT 1) lo ON true LEFT JOIN v hi ON hi.i = lo.i + 1""".replace("quantile_cont(b, i / 99.0)", "any_value(list_extract(q, CAST(i AS INT) + 1))").replace("FROM c, range(100) t(i)", "FROM (SELECT quantile_cont(b, [" + ", ".join(f"{i} / 99.0" for i in range(100)) + "]) AS q FROM c), range(100) t(i)"))
def quantile_transformer(spark, sf):
    return rounded(transformers.QuantileTransformer(["b"], n_quantiles=100).fit_transform(customers(spark, sf)).select("c_custkey", "b"))


@query(f"WITH c AS ({CUST}), m AS (SELECT min(b) AS lo, (max(b) - min(b)) / 3 AS h FROM c), k AS (SELECT c_custkey, (b - lo) / h AS x FROM c, m) SELECT c_custkey, " + ", ".join(f"round(greatest(0, 1 - abs(x - {i})), 6) + 0.0 AS b_sp_{i}" for i in range(4)) + " FROM k WHERE x IS NOT NULL")
def spline_linear(spark, sf):
    """Splines of degree 1: hats at the knots."""
    out = transformers.SplineTransformer(["b"], n_knots=4, degree=1).fit_transform(customers(spark, sf)).drop("c_nationkey", "c_mktsegment")
    return rounded(out.where("b_sp_0 IS NOT NULL"))


def _cubic(x: str) -> str:
    """The cubic B-spline of unit knots around 0."""
    a = f"abs({x})"
    return f"(CASE WHEN {a} < 1 THEN 2 / 3.0 - {a} * {a} + {a} * {a} * {a} / 2 WHEN {a} < 2 THEN (2 - {a}) * (2 - {a}) * (2 - {a}) / 6 ELSE 0 END)"


@query(f"WITH c AS ({CUST}), m AS (SELECT min(b) AS lo, (max(b) - min(b)) / 3 AS h FROM c), k AS (SELECT c_custkey, (b - lo) / h AS x FROM c, m) SELECT c_custkey, " + ", ".join(f"round({_cubic(f'(x - ({i - 1}))')}, 6) + 0.0 AS b_sp_{i}" for i in range(6)) + " FROM k WHERE x IS NOT NULL")
def spline_transformer(spark, sf):
    out = transformers.SplineTransformer(["b"], n_knots=4).fit_transform(customers(spark, sf)).drop("c_nationkey", "c_mktsegment")
    return rounded(out.where("b_sp_0 IS NOT NULL"))


@query(f"""WITH c AS ({CUST}), f AS (SELECT *, c_custkey % 4 AS fold FROM c), a AS (SELECT sum(b) AS s, count(b) AS n FROM f), o AS (SELECT fold, sum(b) AS s, count(b) AS n FROM f GROUP BY 1),
    v AS (SELECT c_mktsegment, sum(b) AS s, count(b) AS n FROM f GROUP BY 1), w AS (SELECT c_mktsegment, fold, sum(b) AS s, count(b) AS n FROM f GROUP BY ALL)
    SELECT c_custkey, round((10 * (a.s - o.s) / (a.n - o.n) + v.s - w.s) / (10 + v.n - w.n), 6) AS c_mktsegment FROM f JOIN o USING (fold) JOIN v USING (c_mktsegment) JOIN w USING (c_mktsegment, fold), a""")
def target_encoder_cross(spark, sf):
    """Each row by a fit on the other folds; the fold is a column's."""
    out = encoders.TargetEncoder([SEG], "b", smooth=10).fit_transform(customers(spark, sf), key="c_custkey", folds=4, fold=F.col("c_custkey") % 4)
    return rounded(out.select("c_custkey", SEG))


_STEPS = [("StandardScaler", {"column": "b"}), ("MinMaxScaler", {"column": ["c_nationkey"]}), ("OrdinalEncoder", {})]
_PIPED = f"""WITH c AS ({CUST}), m AS (SELECT avg(b) AS m, stddev_pop(b) AS s, min(c_nationkey) AS lo, max(c_nationkey) AS hi FROM c{{fit}}), k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM c{{fit}}))
    SELECT c_custkey, round((b - m) / s, 6) + 0.0 AS b, round((c_nationkey - lo) / (hi - lo), 6) + 0.0 AS c_nationkey, code::DOUBLE AS c_mktsegment FROM c JOIN k USING (c_mktsegment), m{{shown}}"""


@query(_PIPED.format(fit="", shown=""))
def preprocess_pipeline(spark, sf):
    """Modules by name, in order; columns by type where none are given."""
    return rounded(PreprocessPipeline(_STEPS, id="c_custkey").fit_transform(customers(spark, sf)))


@query(_PIPED.format(fit=" WHERE c_custkey % 2 = 0", shown=" WHERE c_custkey % 2 = 1"))
def preprocess_transform(spark, sf):
    """Fitted on some rows, saved, loaded, and applied to others without being fitted again."""
    from concord.plans.source_queries import there

    pipe = PreprocessPipeline(_STEPS, id="c_custkey")
    pipe.fit_transform(customers(spark, sf).where("c_custkey % 2 = 0"))
    path = f"{there(spark, 'pipeline')}/p.json"
    pipe.save(path)
    return rounded(PreprocessPipeline.load(path).transform(customers(spark, sf).where("c_custkey % 2 = 1")))


@query("SELECT * FROM (VALUES ('unknown module', false), ('unknown sketch', false), ('k of 0', false), ('is_hra of text', false), ('unknown error type', false), ('role of the other type', false), ('REQ', true)) x(asked, accepted)")
def preprocess_check(spark, sf):
    calls = {
        "unknown module": lambda: PreprocessPipeline([("KMeans", {})]), "unknown sketch": lambda: check_sketch({"sketch_name": "GK"}), "k of 0": lambda: check_sketch({"k": 0}),
        "is_hra of text": lambda: check_sketch({"is_hra": "yes"}), "unknown error type": lambda: check_sketch({"error_type": "X"}), "role of the other type": lambda: PreprocessPipeline([], fl_type="H", role="guest"),
        "REQ": lambda: check_sketch({"sketch_name": "REQ", "k": 12, "is_hra": True}),
    }
    return said(spark, [(k, not refused(f)) for k, f in calls.items()], "asked string, accepted boolean")
