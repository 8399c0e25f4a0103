import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.catalog import PRIVATE, Catalog, Dataset
from concord.operators import stats
from concord.operators.ml import boosting, linear, metrics
from concord.plans.task import Runner, Status
from concord.sources import tables
from concord.streaming import stats as streaming


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = x @ [2.0, -1.0] + 0.5
    return spark.createDataFrame([(i, float(a), float(b), float(t), int(t > 0.5)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y double, c int"), x, y


def test_linear(data):
    df, x, y = data
    assert linear.fit(df, ["a", "b"], "y", epochs=60, rate=0.5).weights == pytest.approx([2, -1, 0.5], abs=1e-3)
    w = np.zeros(3)
    xs = np.column_stack((x, np.ones(len(x))))
    for _ in range(3):
        w -= 0.1 * (xs.T @ (xs @ w - y) / len(y) + 0.01 * np.append(w[:2], 0))
    assert linear.fit(df, ["a", "b"], "y", epochs=3, l2=0.01).weights == pytest.approx(w.tolist())
    m = linear.fit(df, ["a", "b"], "c", "logistic", epochs=20, rate=2.0)
    assert linear.LinearModel.from_json(m.to_json()).weights == m.weights
    assert metrics.classification(m.predict(df), "c").first().acc > 0.97
    private = linear.fit(df, ["a", "b"], "y", epochs=5, clip=1.0, noise=2.0, batch=0.5)
    assert 0 < private.epsilon < linear.private_epsilon(1.0, 2.0, 5, 1e-5)
    parties = stats.union(stats.split_parties(df, "id", 2))
    assert linear.fedavg(parties, ["a", "b"], "y", rounds=15, local_epochs=4, rate=0.2, batches=2).weights == pytest.approx([2, -1, 0.5], abs=0.05)
    soft = linear.fit_softmax(df.withColumn("k", F.when(F.col("a") < -0.5, 0).when(F.col("a") < 0.5, 1).otherwise(2)), ["a", "b"], "k", 3, epochs=15, rate=2.0)
    assert len(soft.weights) == 3
    host, guest = df.select("id", "a", "y"), df.select("id", "b")
    assert linear.fit_vertical([host, guest], "id", ["a", "b"], "y", epochs=3).weights == pytest.approx(linear.fit(df, ["a", "b"], "y", epochs=3).weights)
    with pytest.raises(ValueError):
        linear.fit(df, ["a"], "y", "cubic")


def test_boosting(data):
    df, *_ = data
    m = boosting.train(df, ["a", "b"], "c", trees=4, depth=3)
    assert metrics.classification(m.predict(df), "c").first().acc > 0.9
    r = boosting.train(df, ["a", "b"], "y", "linear", trees=4, depth=3, goss=(0.3, 0.3))
    assert metrics.regression(r.predict(df)).first().r2 > 0.5
    assert boosting.Boosted.from_json(m.to_json()).trees == m.trees
    assert boosting.gain(1, 2, 3, 4, 1, 0.5) == pytest.approx((1 / 3 + 4 / 3 - 9 / 5) / 2 - 0.5)
    first = boosting.train(df, ["a"], "c", trees=1, depth=0)
    g, h = sum(0.5 - r.c for r in df.collect()), 0.25 * 400
    assert first.trees[0][0]["leaf"] == pytest.approx(-g / (h + 1))
    with pytest.raises(ValueError):
        boosting.train(df, ["a"], "", trees=1)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, p double")
    assert metrics.auc(df).first()[0] == 0.625 and metrics.ks(df).first()[0] == 0.5
    x, y = metrics.merged_roc([([0.0, 1.0], [1.0, 1.0], 1), ([0.0, 1.0], [0.0, 1.0], 1)])
    assert y[-1] == 1 and metrics.averaged([({"a": 1.0}, 1), ({"a": 0.0}, 3)]) == {"a": 0.25}


def test_catalog(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_bytes("﻿\"id\",x y\r\n1,2.5\r\n2,3.5\r\n".encode())
    c = Catalog(spark, str(tmp_path / "cat.json"))
    c.register(Dataset("t", "csv", str(csv), "p"))
    assert c.read("t").columns == ["id", "x y"] and c.read("t").agg(F.sum("x y")).first()[0] == 6.0
    c.register(Dataset("secret", "csv", str(csv), "p", visibility=PRIVATE))
    with pytest.raises(KeyError):
        c.find("secret", "q")
    assert [d.id for d in c.list(party="q")] == ["t"] and len(Catalog(spark, str(tmp_path / "cat.json")).list()) == 2
    c.unregister("t")
    with pytest.raises(KeyError):
        c.read("t")
    with pytest.raises(ValueError):
        c.register(Dataset("x", "ftp", "y"))
    c.put("v/1", spark.range(3))
    assert c.read("v/1").count() == 3
    c.drop("v/1")


def test_sources(spark, tmp_path):
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE t (id BIGINT, name VARCHAR(9), v DOUBLE)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"n{i}" if i % 3 else None, i / 4) for i in range(250)])
    df = tables.read_sqlite(spark, db, options={"table": "t"}, rows=60)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("v", "double")]
    assert df.agg(F.count("*"), F.count("name"), F.sum("v")).first() == (250, 166, sum(range(250)) / 4)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"123")
    (tmp_path / "n.csv").write_text("file_name,y\na.png,1\nb.png,0\n")
    assert [(r.file_name, r.length) for r in tables.read_images(spark, str(tmp_path / "img"), options={"annotations": str(tmp_path / "n.csv")}).collect()] == [("a.png", 3)]
    assert tables.project(df, [2, 0]).columns == ["v", "id"]
    with pytest.raises(IndexError):
        tables.project(df, [3])
    assert [r.id for r in tables.page(df, ["id"], 10, 2).collect()] == [10, 11]
    bad = tmp_path / "bad.csv"
    bad.write_text("a\n" + "1\n" * 150 + "x\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED"):
        tables.read_csv(spark, str(bad)).collect()


def test_tasks(spark, tmp_path):
    c = Catalog(spark)
    c.put("a", spark.createDataFrame([(1, 2.0), (2, 4.0)], "id int, x double"))
    c.put("b", spark.createDataFrame([(2, 5.0), (3, 6.0)], "id int, z double"))
    r = Runner(spark, c)
    job = r.submit(json.dumps({"job_id": "j", "algorithm": "psi", "parties": {"CLIENT": "a", "SERVER": "b"}, "params": {"keys": ["id"]}, "reveal_to": ["CLIENT"], "output": {"CLIENT": str(tmp_path / "o")}}))
    assert r.fetch_status(job) is Status.SUCCESS and [x.id for x in r.result(job, "CLIENT").collect()] == [2]
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 1 and r.fetch_status("none") is Status.NONEXIST
    with pytest.raises(PermissionError):
        r.result(job, "SERVER")
    sums = r.submit({"algorithm": "mpc_statistics", "parties": {"p": "a", "q": "a"}, "params": {"type": "SUM", "columns": ["x"]}})
    assert r.result(sums, "p").first().x == 12.0
    e = r.submit({"algorithm": "arithmetic", "parties": {"p": "a", "q": "b"}, "params": {"expression": "x*z", "id": "id"}})
    assert r.result(e, "p").first().result == 20.0
    with pytest.raises(ValueError):
        r.submit({"algorithm": "lenet", "parties": {}})
    with pytest.raises(KeyError):
        r.submit({"job_id": "f", "algorithm": "psi", "parties": {"CLIENT": "zz"}})
    assert r.fetch_status("f") is Status.FAIL


def test_streaming(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = streaming.run_once(spark, streaming.windowed(stream, "ts", ["value"], "1 day", by=["event_type"]), "w", "complete")
    want = streaming.windowed(events, "ts", ["value"], "1 day", by=["event_type"])
    key = lambda d: sorted((r.window_start, r.event_type, r["rows"], round(r.value_sum, 4)) for r in d.collect())
    assert key(got) == key(want)
