import math

import pytest
from pyspark.sql import functions as F

from concord.functions import expression as ex
from concord.functions import scalar
from concord.operators import clean, lookup, psi, stats
from concord.operators.keys import check_keys
from concord.types import arrow_type, declared, sql_type


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# Sets


def test_psi(spark):
    a = spark.createDataFrame([("a#", "#b"), ("a##", "b"), (None, "x"), ("", "x"), ("k", "v"), ("k", "v")], "x string, y string")
    b = spark.createDataFrame([("a#", "#b"), ("", "x"), ("k", "w")], "x string, y string")
    both, rest = psi.intersection(a, b, ["x", "y"]), psi.difference(a, b, ["x", "y"])
    assert both.count() + rest.count() == a.count() and both.count() == 3
    assert psi.intersection(a, b, ["x", "y"], protocol="TEE").count() == 3
    assert psi.cardinality(a, b, ["x"]).first()[0] == 5
    assert psi.intersection(a, b, ["x"], unique=True).count() == 3
    none = b.limit(0)
    assert psi.intersection(a, none, ["x"]).count() == 0 and psi.difference(a, none, ["x"]).count() == 6
    with pytest.raises(ValueError):
        psi.intersection(a, none, ["x"], protocol="KKRT")
    with pytest.raises(ValueError):
        psi.protocol("RSA")
    with pytest.raises(TypeError):
        check_keys(spark.createDataFrame([(1.5,)], "x double"), ["x"])
    for bad in ([], ["nope"]):
        with pytest.raises(ValueError):
            check_keys(a, bad)
    with pytest.raises(ValueError):
        psi.two_party({"a": a}, "a")


def test_key_types_meet(spark):
    a, b = spark.range(5), spark.createDataFrame([("3",), ("x",)], "id string")
    assert rows(psi.intersection(a, b, ["id"])) == [(3,)]


def test_lookup(spark):
    server = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("b", 3, "r")], "k string, n int, s string")
    asked = lookup.query_frame(spark, ["a", "a", "zz"])
    assert rows(lookup.keyword_lookup(asked, server)) == [("a", 1, "p"), ("a", 2, "q")]
    assert rows(lookup.keyword_lookup(lookup.query_frame(spark, [("a", 2)]), server, ["k", "n"], ["s"])) == [("q",)]
    with pytest.raises(ValueError):
        lookup.keyword_lookup(asked, server.select("k"))
    assert rows(lookup.row_lookup(server, ["n"], [0, 2]).select("n", "row_index")) == [(1, 0), (3, 2)]
    result = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "none")], "pos int, k string")
    got = lookup.align(server, ["k"], result, ["k"], "pos")
    assert rows(got.select("position", "n")) == [(0, 3), (1, 1), (2, 3)]
    with pytest.raises(ValueError):
        lookup.check_aligned(got, result)


# Expressions

CASES = ["A+B-9", "C*A+B-3.75", "(7.5-(B*C+A-1.25))*4.0", "8/C", "(A-(B*C-A+3-2)*3)/4", "-64/A", "A/(B-B)", "(A-A)/(B-B)", "-A*-B", "A-B-C", "A/B/C", "2*(-(A))", "+A", ".5*A", "A*(B+(C-(A)))"]


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("row", [{"A": 3, "B": 7, "C": -2}, {"A": 1.5, "B": -4.0, "C": 3.25}, {"A": -8, "B": 2.5, "C": 1}])
def test_expression(spark, text, row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint'}" for k, v in row.items()))
    got, want = df.select(ex.expression(text, df.schema)).first()[0], ex.value_of(text, row)
    assert got == pytest.approx(want, nan_ok=True) and isinstance(got, float)


@pytest.mark.parametrize("text", ["", "A+", "(A", "A)", "A B", "A**B", "A%B", "*A", "A+(", "1..2", "Z+1", "A;drop", "()"])
def test_expression_errors(spark, text):
    with pytest.raises(ValueError):
        ex.expression(text, spark.createDataFrame([(1, 2)], "A bigint, B bigint").schema)


def test_parties(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 5)], "id int, A bigint"), spark.createDataFrame([(1, 4), (2, 0)], "id int, B bigint")
    assert rows(ex.evaluate("A/B", [a, b], "id")) == [(1, 0.5), (2, math.inf)]
    assert rows(ex.compare(a, b, "id", "A", "B")) == [(1, True), (2, False)]
    assert rows(ex.evaluate("A/3", [a, b], "id", accuracy="D16"))[0][1] == round(2 / 3 * 65536) / 65536
    with pytest.raises(ValueError):
        ex.evaluate("A", [a, a], "id")
    with pytest.raises(ValueError):
        ex.same_length([a, b.limit(1)])
    with pytest.raises(ValueError):
        ex.expression("A+B", a.join(b, "id").schema, {"A": "bigint"})
    with pytest.raises(TypeError):
        ex.expression("s", spark.createDataFrame([("x",)], "s string").schema)


def test_compare_fixture(spark):
    low, high = spark.range(100).withColumn("v", F.lit(0.75)), spark.range(100).withColumn("v", F.lit(-42.5))
    assert {r.result for r in ex.compare(low, high, "id", "v", "v").collect()} == {False}


def test_scalar(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (0.25,), (3.0,), (None,)], "x double")
    x = F.col("x")
    assert [tuple(r) for r in df.select(scalar.sign(x), scalar.step(x), scalar.piecewise_sigmoid(x)).collect()][:4] == [(-1, 0, 0.0), (1, 1, 0.5), (1, 1, 0.75), (1, 1, 1.0)]
    one = spark.createDataFrame([([float(i) for i in range(16)],)], "m array<double>")
    assert one.select(scalar.max_pool(F.col("m"), 4, 2, 2)).first()[0] == [5.0, 7.0, 13.0, 15.0]
    assert one.select(scalar.matrix_product(F.slice("m", 1, 2), [[1, 2], [3, 4]])).first()[0] == [3.0, 4.0]


# Statistics


def test_statistics(spark):
    rows_in = [(1, -5.0, float("nan"), None), (2, -1.0, 2.0, None), (3, -3.0, None, None)]
    df = spark.createDataFrame(rows_in, "id int, a double, b double, c double")
    by = lambda d: {r[0]: tuple(r)[1:] for r in d.collect()}
    cols = ["a", "b", "c"]
    assert by(stats.col_max(df, cols)) == {"a": (-1.0,), "b": (2.0,), "c": (None,)}
    assert by(stats.col_sum(df, cols)) == {"a": (-9.0,), "b": (2.0,), "c": (0.0,)}
    assert by(stats.col_mean(df, cols))["a"] == (-3.0,)
    assert by(stats.col_var(df, ["a"]))["a"] == (pytest.approx(8 / 3),)
    assert tuple(stats.joint(df, "AVG", ["b", "a"]).first()) == (-3.0, pytest.approx(2 / 3))
    parts = stats.split_parties(df, "id", 2)
    for kind in ("SUM", "AVG", "MAX", "MIN"):
        assert stats.joint(stats.union(parts), kind, ["a", "b"]).first() == stats.joint(df, kind, ["a", "b"]).first()
    assert stats.joint_of_parts("AVG", [[4.0], [2.0]], [[1], [2]]) == [2.0]
    with pytest.raises(ValueError):
        stats.col_quantile(df, ["a"], [1.5])
    with pytest.raises(ValueError):
        stats.statistic("var", "row")
    with pytest.raises(TypeError):
        stats.joint(spark.createDataFrame([("x",)], "s string"), "SUM", ["s"])
    got = stats.StatsPipeline({"mean": {}, "frequent": {"columns": ["id"], "max_item": 1}}).run(parts)
    assert {r["column"] for r in got["mean"]} == {"id", "a", "b", "c"} and len(got["frequent"]) == 1


def test_sketches(spark):
    df = spark.range(20_001).select(F.col("id").cast("double").alias("x"))
    for sketch in ("KLL", "REQ"):
        for r in stats.col_quantile(df, ["x"], [0.1, 0.5, 0.99], sketch=sketch).collect():
            assert abs(r.value - r.q * 20_000) <= 0.03 * 20_000


# Cleaning

NUMBERS = [("1", 1, 1.0), (" 7", 7, 7.0), ("+3", 3, 3.0), ("7 ", None, None), ("1.5", None, 1.5), ("1e3", None, 1000.0), ("0x1", None, None), ("inf", None, None), ("nan", None, None), ("", None, None), ("NA", None, None), ("abc", None, None), ("-.5", None, -0.5), ("9" * 30, None, 1e30), (None, None, None)]


def test_strict(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(NUMBERS)], "i int, s string")
    got = rows(df.select("i", clean.strict("s", "bigint"), clean.strict("s", "double")), "i")
    assert [(a, b) for _, a, b in got] == [(a, None if b is None else pytest.approx(b)) for _, a, b in NUMBERS]


def test_impute(spark):
    df = spark.createDataFrame([("-7", "x"), ("2", "1.5"), (None, "NA"), ("bad", "2.5"), ("-2", None)], "a string, b string")
    kinds = {"a": "bigint", "b": "double"}
    assert [r.a for r in clean.impute(df, kinds, "AVG").collect()] == [-7, 2, -2, -2, -2]
    assert [r.a for r in clean.impute(df, kinds, "MAX").collect()] == [-7, 2, 2, 2, -2]
    assert [r.b for r in clean.impute(df, kinds, "AVG").collect()] == [2.0, 1.5, 2.0, 2.5, 2.0]
    parts = clean.impute_parties({"p": df.limit(2), "q": df.limit(0)}, kinds, "MIN")
    assert parts["p"].count() == 2 and parts["q"].count() == 0
    with pytest.raises(ValueError):
        clean.impute_parties({"p": df, "q": df.select("a")}, kinds)
    assert [r.a for r in clean.repair_mixed(df, kinds).collect()] == [-7, 2, None, -3, -2]


def test_types():
    assert arrow_type(9).simpleString() == "bigint" and arrow_type(23, 12, 3).simpleString() == "decimal(12,3)" and arrow_type(99).simpleString() == "string"
    assert sql_type("VARCHAR(20)").simpleString() == "string" and sql_type("BigInt").simpleString() == "bigint"
    assert declared([{"a": 9}, {"b": 13}]).simpleString() == "struct<a:bigint,b:string>"
