"""Plans and shapes that must hold at any size: ranges, native keys, offline tables, exact quantiles, tasks."""

import glob
import json
import os
import subprocess
import time

import numpy as np
import pyspark
import pytest
from pyspark.sql import functions as F

from concord.catalog import Catalog, Dataset
from concord.files import before, numbered, ranged, scratch
from concord.functions import scalar, udf
from concord.operators import lookup, psi, stats
from concord.operators.ml import boosting, linear, metrics, mlp
from concord.operators.preprocess import imputer
from concord.plans import source_queries, task
from concord.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g")).repartition(7)
    rows = numbered(df, ["v"])
    assert [r.row_index for r in rows.orderBy("v").collect()] == list(range(1000)) and rows.columns == ["v", "g", "row_index"]
    parts = ranged(df, ["v"], scratch(spark, "t"))
    assert parts.select("_part").distinct().count() > 1
    assert before(parts, {"s": F.sum("v")}).groupBy("_part").agg(F.min("v").alias("lo"), F.min("_before_s").alias("b")).where("b <> lo * (lo - 1) / 2").count() == 0
    assert numbered(df.limit(0), ["v"]).count() == 0
    got = lookup.row_lookup(df, ["v"], [0, 999]).orderBy("v").collect()
    assert [(r.v, r.row_index) for r in got] == [(0, 0), (999, 999)]
    assert "SinglePartition" not in plan(lookup.row_lookup(df, ["v"], [5])).split("Window")[0]


def test_offline_table(spark, tmp_path):
    """A lookup reads the server's table as it is dealt: no exchange on its side."""
    server = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    table = lookup.build_lookup_table(server, "k", "offline_test", buckets=4, rebuild=True, path=str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = lookup.keyword_lookup(lookup.query_frame(spark, [3, 7, 900]), table, ["k"])
        text = plan(got)
        assert "Bucketed: true" in text
        side = [x for x in text.split("\n") if "FileScan" in x and "offline_test" in x]
        assert len(side) == 1 and sorted(r.v for r in got.collect()) == [6, 14]
        assert got.columns == ["k", "v"]
        # Used again as it is; built anew only when asked for.
        assert lookup.build_lookup_table(server.limit(0), "k", "offline_test").count() == 500
        assert lookup.build_lookup_table(server.limit(9), "k", "offline_test", rebuild=True, path=str(tmp_path / "u")).count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE offline_test")


def test_native_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, s string")
    b = spark.createDataFrame([(2,), (None,)], "k long")
    assert sorted(r.s for r in psi.intersection(a, b, ["k"]).collect()) == ["y", "z"]
    assert [r.s for r in psi.difference(a, b, ["k"]).collect()] == ["x"]
    assert sorted(r.s for r in psi.intersection(a, b, ["k"], protocol="TEE").collect()) == ["y", "z"]
    host, guest = psi.align_samples(a, b.withColumn("w", F.lit(1)), "k")
    assert host.count() == guest.count() == psi.aligned_join(host, guest, "k").count() == 2


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_exact_quantiles(spark, n, monkeypatch):
    monkeypatch.setattr(stats, "HELD", 50)
    rng = np.random.default_rng(n)
    v = np.where(rng.random(n) < 0.3, 4.0, rng.normal(size=n).round(2))
    df = spark.createDataFrame([(float(x), None if x == 4.0 else float(x), float("nan")) for x in v] or [(None, None, None)], "a double, b double, c double")
    for q in ([0.0, 0.1, 0.5, 0.973, 1.0], np.linspace(0, 1, 40).tolist()):
        got = stats.exact_quantiles(df, ["a", "b", "c"], q)
        for c, x in (("a", v), ("b", v[v != 4.0])):
            assert got[c] == (pytest.approx(np.quantile(x, q).tolist()) if len(x) else [None] * len(q))
        assert got["c"] == [None] * len(q)


def test_union_of_text(spark):
    df = spark.createDataFrame([("NaN", float("nan")), ("x", 1.0), (None, None)], "s string, d double")
    assert {tuple(r) for r in stats.col_union(df, ["s", "d"]).collect()} == {("s", "NaN"), ("s", "x"), ("d", "1.0")}


def test_roc_in_ranges(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 3000), rng.random(3000).round(3)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist(), strict=True)), "y int, p double").repartition(5)
    curve = metrics.roc(df).orderBy(F.desc("threshold")).collect()
    assert [r.tpr for r in curve] == pytest.approx([(p[y == 1] >= r.threshold).mean() for r in curve])
    pos, neg = p[y == 1], p[y == 0]
    assert metrics.auc(df).first().auc == pytest.approx((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)


def test_median_error(spark):
    """No aggregate holds all errors, and the median is that of all."""
    rng = np.random.default_rng(2)
    y, p = rng.normal(size=3001).round(3), rng.normal(size=3001)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist(), strict=True)), "y double, p double")
    got = metrics.regression(df)
    assert "median" not in plan(got) and "percentile" not in plan(got)
    assert got.columns == list(metrics.REGRESSION) and got.first().medae == pytest.approx(np.median(np.abs(y - p)))
    assert metrics.regression(df, only=["mae", "r2"]).columns == ["mae", "r2"]
    missing = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (float("nan"), 1.0), (None, 1.0)], "y double, p double")
    assert metrics.regression(missing).first().medae == 3.0
    assert np.isnan(metrics.regression(missing.where("isnan(y)")).first().medae) and metrics.regression(missing.limit(0)).first().medae is None
    held = imputer.SimpleImputer(["y"], strategy="median")
    assert held.fit_transform(df).count() == 3001 and held.state["fill"]["y"] == pytest.approx(np.median(y))


def test_federated_steps(spark):
    """The result does not depend on how rows are dealt to partitions and batches."""
    rng = np.random.default_rng(3)
    rows = [(f"p{i % 3}", float(a), float(2 * a - 0.5)) for i, a in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, f"{stats.PARTY} string, a double, y double")
    once = linear.fedavg(df.repartition(1), ["a"], "y", rounds=2, local_epochs=3, batches=4).weights
    assert linear.fedavg(df.repartition(7), ["a"], "y", rounds=2, local_epochs=3, batches=4).weights == pytest.approx(once)
    m = mlp.fit_mlp(df.withColumn("c", (F.col("y") > 0).cast("int")), ["a"], "c", [4], rounds=20, local_epochs=3, rate=1.0)
    assert metrics.classification(m.predict(df.withColumn("c", (F.col("y") > 0).cast("int"))), "c").first().acc > 0.9
    assert mlp.Mlp.from_json(m.to_json()).weights == m.weights
    three = df.withColumn("c", F.when(F.col("a") < -0.4, 0).when(F.col("a") < 0.4, 1).otherwise(2))
    m = mlp.fit_mlp(three.drop(stats.PARTY), ["a"], "c", [6], "multiclass", 3, rounds=60, rate=1.0)
    assert metrics.multiclass(m.predict(three), "c").first().acc > 0.7
    with pytest.raises(ValueError):
        mlp.fit_mlp(df, ["a"], "y", [2], "ranking")


def test_softmax_steps(spark):
    """Steps over plain columns that are compiled, not functions over arrays; weights and probabilities are those without Spark."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 2)) * 300, rng.integers(0, 3, 200)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, c int")
    m, w, xs = linear.fit_softmax(df, ["a", "b"], "c", 3, epochs=3, rate=0.5), np.zeros((3, 3)), np.column_stack((x, np.ones(200)))

    def shares(w):
        e = np.exp((z := xs @ w.T) - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(3):
        w -= 0.5 * (shares(w) - np.eye(3)[y]).T @ xs / 200
    assert np.array(m.weights) == pytest.approx(w)
    got = m.predict(df)
    assert got.columns == ["a", "b", "c", "p_all", "p"] and "transform(" not in plan(got) and "aggregate(" not in plan(got)
    rows = got.toPandas()
    assert np.array(rows["p_all"].tolist()) == pytest.approx(shares(w)) and rows["p"].tolist() == shares(w).argmax(axis=1).tolist()


def test_boosting_passes(spark, monkeypatch):
    """One pass over the rows a level; leaves are those of the rows that reach them."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=400), np.where(rng.random(400) < 0.1, np.nan, rng.normal(size=400))
    y = ((a > 0.2) ^ (np.nan_to_num(b) > 0)).astype(int)
    df = spark.createDataFrame([(float(u), None if i % 20 == 0 else float(v), int(w)) for i, (u, v, w) in enumerate(zip(a, b, y, strict=True))], "a double, b double, y int").persist()
    b[::20] = np.nan
    cuts = {"a": [-1.0, 0.2, 0.9], "b": [-0.5, 0.0]}
    got = df.select(*(c.alias(n) for n, c in boosting.bucketed(df, cuts).items())).toPandas()
    assert got["a"].tolist() == [sum(u > c for c in cuts["a"]) for u in a] and got["b"].tolist() == [sum(v > c for c in cuts["b"]) for v in b]
    passes, sums = [], boosting.gradient_sums
    monkeypatch.setattr(boosting, "gradient_sums", lambda *x, **o: passes.append(0) or sums(*x, **o))
    (tree,) = boosting.train(df, ["a", "b"], "y", trees=1, depth=2, cuts=cuts).trees
    assert len(passes) == 2
    at = np.zeros(400, int)
    while any("feature" in tree[k] for k in at):
        at = np.array([(tree[k]["right"] if {"a": a, "b": b}[tree[k]["feature"]][i] > tree[k]["cut"] else tree[k]["left"]) if "feature" in tree[k] else k for i, k in enumerate(at)])
    assert len(set(at)) == 4
    for k in set(at):
        assert tree[k]["leaf"] == pytest.approx(-(0.5 - y[at == k]).sum() / (0.25 * (at == k).sum() + 1))


def test_gradient():
    """Against differences of the loss."""
    rng = np.random.default_rng(0)
    for name, out in (("regression", 1), ("binary", 1), ("multiclass", 3)):
        sizes = [3, 4, 2, out]
        w = np.array(mlp.first_weights(sizes, 1))
        x = rng.normal(size=(20, 3))
        y = rng.integers(0, 3, 20).astype(float) if name == "multiclass" else rng.integers(0, 2, 20).astype(float)

        def loss(w, x=x, y=y, sizes=sizes, name=name):
            p = mlp.forward(x, w, sizes, name)[-1]
            if name == "regression":
                return ((p[:, 0] - y) ** 2).sum() / 2
            return -np.log(p[np.arange(20), y.astype(int)] if name == "multiclass" else np.where(y > 0, p[:, 0], 1 - p[:, 0])).sum()

        g = mlp.gradient(x, y, w, sizes, name)
        step = np.eye(len(w)) * 1e-6
        assert g == pytest.approx([(loss(w + s) - loss(w - s)) / 2e-6 for s in step], abs=1e-4)


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿\"a,b\",c\r\n1,2\r\n".encode())
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a,b", "c"] and tuple(df.first()) == (1, 2)


def test_step_batches(spark):
    df = spark.range(400)
    steps = [{r.id for r in tables.step_batch(df, k, 4).collect()} for k in range(8)]
    assert set().union(*steps[:4]) == set().union(*steps[4:]) == set(range(400)) and sum(map(len, steps)) == 800 and steps[0] != steps[4]


def test_task_order_and_kill(spark):
    assert task.in_order(["P10", "P2", "A", "P1"]) == ["A", "P1", "P2", "P10"]
    c = Catalog(spark)
    c.put("n", spark.range(5))
    r = task.Runner(spark, c)
    assert r.wait(r.start({"job_id": "x", "algorithm": "psi", "parties": {"CLIENT": "n", "SERVER": "n"}, "params": {"keys": ["id"]}})) is task.Status.SUCCESS
    assert r.start({"job_id": "x", "algorithm": "psi", "parties": {}}) == "x" and r.result("x", "CLIENT").count() == 5
    r.wait(r.start({"job_id": "y", "algorithm": "psi", "parties": {"CLIENT": "no"}}))
    assert r.fetch_status("y") is task.Status.FAIL and isinstance(r.errors["y"], KeyError)

    @task.function("slow")
    def slow(party, df, args):
        def run(frames):
            time.sleep(30)
            yield from frames

        return df.mapInPandas(run, df.schema).persist().count() and df

    began = time.time()
    job = r.start({"algorithm": "python", "parties": {"A": "n"}, "params": {"function": "slow"}})
    time.sleep(1)
    r.kill(job)
    assert r.wait(job, 20) is task.Status.FAIL and time.time() - began < 20


def test_documents(spark, tmp_path):
    c = Catalog(spark)
    c.put("d", spark.createDataFrame([(1, 2.0), (3, 4.0)], "x int, y double"))
    doc = {"TaskDetail": json.dumps({"type": 3, "features": [{"resourceId": "d", "checked": ["y", "x"]}]}), "ColumnInfo": {"value": {"d": {"columns": {"x": 1, "y": 2}, "newDataSetId": "e", "outputFilePath": str(tmp_path / "e")}}}}
    r = task.Runner(spark, c)
    job = r.submit({"algorithm": "mpc_statistics", "parties": {"p": "d"}, "params": doc})
    assert tuple(r.result(job, "p").first()) == (3.0, 4.0) and c.read("e").columns == ["x", "y"]


def test_stores(spark, tmp_path):
    for backend in ("json", "kv"):
        path = str(tmp_path / backend)
        c = Catalog(spark, path, backend)
        c.register(Dataset("a", "parquet", str(tmp_path / "p")))
        c.upload("b", spark.range(3), str(tmp_path / f"b-{backend}"))
        assert [e.id for e in Catalog(spark, path, backend).list()] == ["a", "b"]
        c.drop("b", data=True)
        assert not (tmp_path / f"b-{backend}").exists() and [e.id for e in Catalog(spark, path, backend).list()] == ["a"]
    with pytest.raises(ValueError):
        Catalog(spark, path, "level")


def test_sketches(spark):
    df = spark.range(5000).select((F.col("id") % 50).alias("v"), F.col("id").cast("double").alias("x"))
    got = stats.col_frequent_approximate(df.union(df.where("v = 7")), "v", 2, 200, "NFP", 150).collect()
    assert [tuple(r) for r in got] == [(7, 200)]
    assert stats.col_frequent_approximate(df, "v", 60, 200, "NFN", 101).count() == 0
    for hra, q in ((True, 0.999), (False, 0.001)):
        value = stats.col_quantile(df, ["x"], [q], "REQ", 20, hra).first().value
        assert abs(value - q * 4999) <= 5
    with pytest.raises(ValueError):
        stats.col_frequent_approximate(df, "v", 2, error_type="BOTH")


def test_user_code(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", 3.0), (None, 4.0)], "k string, v double").repartition(3)
    got = udf.custom_aggregate(df, ["k"], lambda x: {"most": float(x["v"].max())}, lambda a, b: {"most": max(a["most"], b["most"])}, "k string, most double")
    assert {tuple(r) for r in got.collect()} == {("a", 3.0), (None, 4.0)}
    assert udf.batch_map(df, lambda x: x.assign(v=x["v"] * 2), "k string, v double").agg(F.sum("v")).first()[0] == 20.0


def test_scalars(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (-6.0,), (0.0,), (None,)], "x double")
    assert [r[0] for r in df.select(scalar.power_of_two_rank(F.col("x"))).collect()] == [0, 1, 3, None, None]
    assert [r[0] for r in df.select(scalar.histogram_bucket(F.col("x"), 0, 1, 4)).collect()] == [2, 3, None, 0, None]
    assert spark.sql("SELECT 'a####b##' AS s").select(scalar.parts(F.col("s"))).first()[0] == ["a", "b##"]


def test_database_of_other_processes(spark, small, tmp_path):
    """What jdbc queries read can be opened by executors, which are other processes, while the driver has it open."""
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "K int, N string")
    url = source_queries.jdbc_url(spark, df, "SHARED")
    assert tables.read_jdbc(spark, url, options={"table": "SHARED", **source_queries.DERBY}).count() == 3
    java = spark.sparkContext._jvm.java.lang.System.getProperty("java.home") + "/bin/java"
    jars = ":".join(glob.glob(f"{os.path.dirname(pyspark.__file__)}/jars/derby*.jar"))
    (tmp_path / "x.sql").write_text("SELECT count(*) + 40 AS n FROM SHARED WHERE N IS NOT NULL;\n")
    run = subprocess.run([java, "-cp", jars, f"-Dij.database={url}", "org.apache.derby.tools.ij", "x.sql"], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert "42" in run.stdout.split(), run.stdout
