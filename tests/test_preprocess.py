import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators.preprocess import encoders, imputer, scalers, transformers
from concord.operators.preprocess.pipeline import PreprocessPipeline

X = [1.0, 2.0, None, 4.0, 10.0, float("nan"), -3.0]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, x, 7.0, c) for i, (x, c) in enumerate(zip(X, "abacab", strict=False))] + [(6, X[6], 7.0, None)], "i int, x double, k double, c string")


def column(out, c="x"):
    return [None if r[c] is None or r[c] != r[c] else r[c] for r in out.orderBy("i").collect()]


V = np.array([x for x in X if x is not None and x == x])


def want(f):
    return [None if x is None or x != x else pytest.approx(f(x)) for x in X]


def test_scalers(df):
    assert column(scalers.MaxAbsScaler(["x", "k"]).fit_transform(df)) == want(lambda x: x / 10)
    assert column(scalers.MinMaxScaler(["x"]).fit_transform(df)) == want(lambda x: (x + 3) / 13)
    assert column(scalers.StandardScaler(["x", "k"]).fit_transform(df)) == want(lambda x: (x - V.mean()) / V.std())
    assert column(scalers.StandardScaler(["k"]).fit_transform(df), "k") == [0.0] * 7
    q = np.percentile(V, [25, 50, 75])
    assert column(scalers.RobustScaler(["x"]).fit_transform(df)) == want(lambda x: (x - q[1]) / (q[2] - q[0]))
    assert column(scalers.Normalizer(["x", "k"]).fit_transform(df))[0] == pytest.approx(1 / math.sqrt(50))
    with pytest.raises(ValueError):
        scalers.MinMaxScaler(["x"], feature_range=(1, 1)).fit(df)


def test_imputer(df):
    out = imputer.SimpleImputer(["x"], add_indicator=True).fit_transform(df)
    assert column(out) == [pytest.approx(V.mean()) if x is None or x != x else x for x in X]
    assert column(out, "missing_x") == [0, 0, 1, 0, 0, 1, 0]
    assert column(imputer.SimpleImputer(["c"], strategy="most_frequent").fit_transform(df), "c")[6] == "a"
    empty = df.withColumn("e", F.lit(None).cast("double"))
    assert "e" not in imputer.SimpleImputer(["e"]).fit_transform(empty).columns
    assert column(imputer.SimpleImputer(["e"], keep_empty_features=True).fit_transform(empty), "e") == [0.0] * 7
    with pytest.raises(ValueError):
        imputer.SimpleImputer(["c"]).fit(df)


def test_bins(df):
    m = encoders.KBinsDiscretizer(["x", "k"], n_bins=2, strategy="uniform").fit(df)
    assert column(m.transform(df)) == [0.0, 0.0, None, 1.0, 1.0, None, 0.0] and m.state["edges"]["k"] == ["-inf", "inf"]
    with pytest.raises(ValueError):
        encoders.KBinsDiscretizer(["x"], strategy="kmeans").fit(df)


def test_encoders(df, spark):
    assert column(encoders.OrdinalEncoder(["c"], encoded_missing_value=-5).fit_transform(df), "c") == [0, 1, 0, 2, 0, 1, -5]
    hot = encoders.OneHotEncoder(["c"], min_frequency=2).fit_transform(df)
    assert [c for c in hot.columns if c.startswith("c_")] == ["c_a", "c_b", "c_infrequent"]
    m = encoders.OneHotEncoder(["c"], max_categories=2, handle_unknown="infrequent_if_exist").fit(df)
    other = spark.createDataFrame([(0, "zz")], "i int, c string")
    assert m.transform(other).first()["c_infrequent"] == 1
    with pytest.raises(Exception, match="unknown category"):
        encoders.OneHotEncoder(["c"]).fit(df).transform(other).collect()
    assert encoders.OrdinalEncoder(["c"], handle_unknown="use_encoded_value", unknown_value=-1).fit(df).transform(other).first().c == -1
    for bad in ({"handle_unknown": "use_encoded_value"}, {"unknown_value": 3}, {"handle_unknown": "use_encoded_value", "unknown_value": 1}):
        with pytest.raises(ValueError):
            encoders.OrdinalEncoder(["c"], **bad).fit(df)
    lab = spark.createDataFrame([(0, 10), (1, 9), (2, 100)], "i int, y int")
    assert column(encoders.LabelEncoder(["y"]).fit_transform(lab), "y") == [1, 0, 2]
    assert [c for c in encoders.LabelBinarizer(["y"]).fit_transform(lab).columns if c != "i"] == ["y_9", "y_10", "y_100"]
    with pytest.raises(ValueError):
        encoders.MultiLabelBinarizer(["y"], classes=["a", "a"]).fit(lab)


def test_target_encoder(spark):
    rng = np.random.default_rng(1)
    data = [(i, "ab"[i % 2], float(rng.normal(i % 2))) for i in range(200)]
    df = spark.createDataFrame(data, "i int, c string, y double")
    y = np.array([r[2] for r in data])
    a = y[::2]
    v, n, w = y.var(), len(a), ((a - a.mean()) ** 2).sum() / len(a)
    lam = v * n / (v * n + w)
    assert column(encoders.TargetEncoder(["c"], "y").fit_transform(df), "c")[0] == pytest.approx(lam * a.mean() + (1 - lam) * y.mean())
    got = column(encoders.TargetEncoder(["c"], "y", smooth=2).fit_transform(df, key="i"), "c")
    fold = [r.f for r in df.orderBy("i").select(F.pmod(F.xxhash64("i"), F.lit(5)).alias("f")).collect()]
    rest = [(c, t) for (_, c, t), f in zip(data, fold, strict=True) if f != fold[0]]
    mine, mean = [t for c, t in rest if c == "a"], np.mean([t for _, t in rest])
    assert got[0] == pytest.approx((2 * mean + sum(mine)) / (2 + len(mine)))


def test_minimise():
    f = lambda p: [(p[0] - 1.3) ** 2, math.cosh(p[1] + 2), abs(p[2])]
    assert transformers.minimise(f, 3, -5, 5) == pytest.approx([1.3, -2, 0], abs=1e-3)


def test_power(spark):
    x = np.random.default_rng(2).lognormal(0, 0.7, 500)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "i int, x double")
    box = transformers.PowerTransformer(["x"], method="box-cox").fit(df)
    grid = np.linspace(-1, 1, 401)

    def loss(lam):
        z = np.log(x) if abs(lam) < 1e-12 else (x**lam - 1) / lam
        return len(x) / 2 * np.log(z.var()) - (lam - 1) * np.log(x).sum()

    assert box.state["lambda"]["x"] == pytest.approx(grid[np.argmin([loss(v) for v in grid])], abs=0.01)
    z = np.array(column(transformers.PowerTransformer(["x"]).fit_transform(df)))
    assert abs(z.mean()) < 1e-6 and z.std() == pytest.approx(1)


def test_quantile_and_spline(spark):
    x = np.random.default_rng(3).normal(size=300)
    df = spark.createDataFrame(list(enumerate(x.tolist())) + [(300, None)], "i int, x double")
    u = column(transformers.QuantileTransformer(["x"], n_quantiles=300).fit_transform(df))
    assert u[-1] is None and np.allclose(u[:-1], np.argsort(np.argsort(x)) / 299)
    g = column(transformers.QuantileTransformer(["x"], n_quantiles=300, output_distribution="normal").fit_transform(df))
    assert abs(np.median(g[:-1])) < 0.02
    for mode in ("constant", "linear", "continue", "periodic"):
        m = transformers.SplineTransformer(["x"], n_knots=5, extrapolation=mode).fit(df)
        b = m._at("x", np.append(x, [-9.0, 9.0]))
        assert b.shape[1] == m.splines("x") and np.allclose(b.sum(1), 1), mode
    out = transformers.SplineTransformer(["x"], n_knots=5).fit_transform(df)
    assert len([c for c in out.columns if "_sp_" in c]) == 7


def test_pipeline(df, tmp_path):
    steps = [("SimpleImputer", {"columns": ["x"]}), ("StandardScaler", {}), ("OneHotEncoder", {"columns": ["c"], "handle_unknown": "ignore"})]
    p = PreprocessPipeline(steps, id="i")
    out = p.fit_transform(df)
    p.save(str(tmp_path / "m.json"))
    again = PreprocessPipeline.load(str(tmp_path / "m.json")).transform(df)
    assert out.orderBy("i").collect() == again.orderBy("i").collect()
    for bad in ([("Nope", {})], [("KBinsDiscretizer", {"sketch_name": "XX"})]):
        with pytest.raises(ValueError):
            PreprocessPipeline(bad).fit_transform(df)
    with pytest.raises(ValueError):
        PreprocessPipeline([], role="host")
