"""Registered queries over sources, sinks, the catalog and tasks, each beside the SQL that must give the same rows."""

from __future__ import annotations

import contextlib
import os
import sqlite3
import tempfile
import zipfile
from contextlib import closing
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.catalog import Catalog, Dataset
from concord.files import opened, scratch
from concord.functions import expression, scalar, udf
from concord.operators import clean, keys, lookup, psi, stats
from concord.plans import task
from concord.plans.queries import CUST, DIRTY, KIND, LI, customers, dirty, missing, query, rounded, t, vertical
from concord.sources import tables
from concord.types import declared, numeric_columns, other_columns, present, sql_type


def there(spark, name: str) -> str:
    """A path of the driver below the shared folder, made; for files that the driver writes itself."""
    fs, at = opened(scratch(spark, name))
    fs.create_dir(at, recursive=True)
    return at


def said(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


def refused(f) -> bool:
    """Whether a call is refused, with an error of the value or type that it was given."""
    try:
        f()
    except (ValueError, TypeError, KeyError, IndexError, PermissionError):
        return True
    return False


# CSV.

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(CUSTOMER)
def csv_scan(spark, sf):
    path = scratch(spark, "csv")
    tables.write_csv(t(spark, sf, "customer"), path)
    return tables.read_csv(spark, path, t(spark, sf, "customer").schema)


@query('SELECT c_custkey AS id, c_name AS "name, full", c_acctbal AS bal FROM customer WHERE c_custkey <= 500')
def csv_header(spark, sf):
    """A byte-order mark, quoted names with the separator in them, carriage returns."""
    path = there(spark, "csv-header")
    rows = t(spark, sf, "customer").where("c_custkey <= 500").select("c_custkey", "c_name", "c_acctbal").collect()  # a fixture of at most 500 rows
    with open(f"{path}/c.csv", "wb") as f:
        f.write('﻿"id","name, full",bal\r\n'.encode())
        f.writelines(f'{r.c_custkey},"{r.c_name}",{r.c_acctbal!r}\r\n'.encode() for r in rows)
    return tables.read_csv(spark, f"file://{path}/c.csv")


@query("SELECT n_nationkey, n_name, n_regionkey, true AS marked FROM nation")
def csv_sink(spark, sf):
    """Written with a byte-order mark and unquoted names, read as any CSV."""
    path = scratch(spark, "csv-sink")
    tables.write_csv(t(spark, sf, "nation"), path, one_file=True, bom=True)
    # Readers of text take the mark away; the file's bytes show it.
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    marked = raw.where(F.col("content").cast("string").startswith("﻿n_nationkey,n_name,n_regionkey\n")).count() == 1
    return tables.read_csv(spark, path, t(spark, sf, "nation").schema).withColumn("marked", F.lit(marked))


@query("SELECT c_acctbal, c_custkey FROM customer")
def csv_projection(spark, sf):
    path = scratch(spark, "csv")
    tables.write_csv(t(spark, sf, "customer"), path)
    return tables.read_csv(spark, path, t(spark, sf, "customer").schema, {"columns": [3, 0]})


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_as_strings(spark, sf):
    path = scratch(spark, "csv")
    tables.write_csv(t(spark, sf, "nation"), path)
    return tables.as_strings(tables.read_csv(spark, path))


@query("SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem")
def schema_cast(spark, sf):
    return tables.read_parquet(spark, f"{sf}/lineitem.parquet", T.StructType([T.StructField("l_orderkey", T.DoubleType()), T.StructField("l_linenumber", T.LongType())]))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_rows(spark, sf):
    return tables.page(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 50)


@query("SELECT count(*) AS rows_seen FROM (SELECT * FROM orders LIMIT 100)")
def preview_rows(spark, sf):
    return tables.preview(t(spark, sf, "orders")).agg(F.count("*").alias("rows_seen"))


@query("SELECT r_regionkey, r_name FROM region")
def hadoop_path(spark, sf):
    """A path as any Hadoop file system has it."""
    return tables.read_parquet(spark, f"file://{sf}/region.parquet" if sf.startswith("/") else f"{sf}/region.parquet")


@query(f"SELECT event_id, coalesce(TRY_CAST(u AS BIGINT), 0) AS u, coalesce(TRY_CAST(v AS DOUBLE), 0) AS v FROM ({DIRTY})")
def string_conversion(spark, sf):
    return dirty(spark, sf).select("event_id", tables.lenient_number("u", "bigint").alias("u"), tables.lenient_number("v", "double").alias("v"))


@query("SELECT c_name, c_mktsegment FROM customer")
def selected_columns(spark, sf):
    return tables.selected(t(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment"], ["c_custkey"])


@query("SELECT o_orderkey, 1 AS times FROM orders")
def mini_batches(spark, sf):
    """All steps of an epoch together have each row once, for random parts and for steps by hash."""
    o = t(spark, sf, "orders").select("o_orderkey")
    steps = [tables.step_batch(o, k, 4) for k in range(8, 12)] + tables.mini_batches(o, 3)
    every = reduce(lambda a, b: a.unionByName(b), steps)
    return every.groupBy("o_orderkey").agg((F.count("*") / 2).cast("int").alias("times"))


# Databases and images.


def sqlite_file(spark, sf) -> str:
    path = f"{there(spark, 'sqlite')}/x.db"
    rows = [tuple(r) for r in t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").toLocalIterator()]  # a fixture
    with closing(sqlite3.connect(path)) as db, db:
        db.execute("CREATE TABLE supplier (s_suppkey BIGINT, s_name VARCHAR(40), s_nationkey INT, s_acctbal DOUBLE)")
        db.executemany("INSERT INTO supplier VALUES (?, ?, ?, ?)", rows)
    return path


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def sqlite_scan(spark, sf):
    return tables.read_sqlite(spark, sqlite_file(spark, sf), options={"table": "supplier"}, rows=7)


@query("SELECT s_name, CAST(s_suppkey AS VARCHAR) AS s_suppkey FROM supplier")
def sqlite_cast(spark, sf):
    return tables.read_sqlite(spark, sqlite_file(spark, sf), T.StructType([T.StructField(c, T.StringType()) for c in ("s_name", "s_suppkey")]), {"table": "supplier"})


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_acctbal ELSE (SELECT max(s_acctbal) FROM supplier) END AS s_acctbal FROM supplier")
def sqlite_impute(spark, sf):
    """Missing values of a database table."""
    df = tables.read_sqlite(spark, sqlite_file(spark, sf), options={"table": "supplier"}).select("s_suppkey", F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal")).alias("s_acctbal"))
    return clean.impute(df, {"s_acctbal": "double"}, "MAX")


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def jdbc_url(spark, df, table: str) -> str:
    """A database of one table of few rows that every executor can open, by the JDBC driver that Spark brings along.

    One process at a time may open a database for writing, so the driver makes it
    in a folder of its own and packs it; what is packed is read-only, and any
    number of processes read it.
    """
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)  # or it leaves a log in the working folder
    connect = lambda url: jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{url}")
    path = f"{there(spark, 'jdbc')}/x.jar"
    names = ", ".join(f'"{f.name}"' for f in df.schema)
    kinds = ", ".join(f'"{f.name}" {"VARCHAR(255)" if isinstance(f.dataType, T.StringType) else f.dataType.simpleString()}' for f in df.schema)
    with tempfile.TemporaryDirectory() as own:
        own = os.path.realpath(own)  # the JVM takes no path that is relative to a process
        db = connect(f"{own}/db;create=true")
        with closing(db):
            db.createStatement().execute(f'CREATE TABLE "{table}" ({kinds})')
            add = db.prepareStatement(f'INSERT INTO "{table}" ({names}) VALUES ({", ".join("?" * len(df.columns))})')
            for r in df.collect():  # a fixture
                for i, v in enumerate(r):
                    add.setObject(i + 1, v)
                add.executeUpdate()
        with contextlib.suppress(Py4JJavaError):  # a database says by an error that it is closed
            connect(f"{own}/db;shutdown=true")
        with zipfile.ZipFile(path, "w") as packed:
            for at, _, files in os.walk(own):
                for f in files:
                    packed.write(f"{at}/{f}", os.path.relpath(f"{at}/{f}", own))
    return f"jdbc:derby:jar:({path})db"


@query("SELECT n_nationkey, n_name FROM nation")
def jdbc_scan(spark, sf):
    """Read in ranges of a column, by several tasks."""
    url = jdbc_url(spark, t(spark, sf, "nation").select(F.col("n_nationkey").alias("N_NATIONKEY"), F.col("n_name").alias("N_NAME")), "SCANNED")
    parts = {"partitionColumn": "N_NATIONKEY", "lowerBound": 0, "upperBound": 25, "numPartitions": 3}
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])
    return tables.read_jdbc(spark, url, schema, {"table": "SCANNED", **parts, **DERBY})


@query("SELECT 1000 - n_nationkey AS position, n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def data_align_jdbc(spark, sf):
    nation = t(spark, sf, "nation")
    url = jdbc_url(spark, nation.select(F.col("n_nationkey").alias("N_NATIONKEY"), F.col("n_name").alias("N_NAME")), "ALIGNED")
    table = tables.read_jdbc(spark, url, T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())]), {"table": "ALIGNED", **DERBY})
    result = nation.where("n_regionkey = 1").select((1000 - F.col("n_nationkey")).alias("pos"), F.col("n_nationkey").alias("k"))
    out = lookup.align(table, ["n_nationkey"], result, ["k"], "pos")
    lookup.check_aligned(out, result)
    return out


@query("SELECT 'n' || n_nationkey || '.pgm' AS file_name, n_regionkey AS y, CAST(length(n_name) + 15 AS BIGINT) AS length FROM nation WHERE n_nationkey < 20")
def image_annotations(spark, sf):
    """Files of a folder beside their annotations; files without one stay out."""
    path = there(spark, "images")
    rows = t(spark, sf, "nation").collect()  # 25 rows
    for r in rows:
        with open(f"{path}/n{r.n_nationkey}.pgm", "wb") as f:
            f.write(f"P5 {len(r.n_name):03d} 001 255\n".encode()[:15] + r.n_name.encode())
    notes = scratch(spark, "annotations")
    tables.write_csv(t(spark, sf, "nation").where("n_nationkey < 20").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".pgm")).alias("file_name"), F.col("n_regionkey").alias("y")), notes)
    return tables.read_images(spark, f"file://{path}", options={"annotations": notes}).drop("content")


# The catalog.


@query("SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1")
def catalog_put_get(spark, sf):
    c = Catalog(spark)
    c.put("nations/all", t(spark, sf, "nation"), party="p", description="all nations")
    assert [e.id for e in c.list()] == ["nations/all"] and c.find("nations/all").driver == "view"
    out = c.read("nations/all", ["n_regionkey"])
    c.drop("nations/all")
    return out.groupBy("n_regionkey").agg(F.count("*").alias("nations"))


_LISTED = "SELECT * FROM (VALUES ('a', 'PRIVATE', 'first'), ('c', 'PUBLIC', 'third')) x(id, visibility, description)"


def _catalog(backend: str):
    def run(spark, sf):
        """Registered, updated, unregistered; then restored from the store by a second catalog."""
        path = f"{there(spark, 'catalog')}/meta"
        c = Catalog(spark, path, backend)
        for i in "abc":
            c.register(Dataset(i, "parquet", f"{sf}/region.parquet", "p"))
        c.update(Dataset("a", "parquet", f"{sf}/nation.parquet", "p", "first", "PRIVATE"))
        c.update(Dataset("c", "parquet", f"{sf}/nation.parquet", "p", "third"))
        c.unregister("b")
        again = Catalog(spark, path, backend)
        return said(spark, [(e.id, e.visibility, e.description) for e in again.list()], "id string, visibility string, description string")

    return run


for _backend in ("json", "kv"):
    query(_LISTED, f"catalog_{_backend}")(_catalog(_backend))


@query("SELECT * FROM (VALUES ('all', 2), ('by id', 1), ('of another', 1), ('own', 2)) x(asked, found)")
def catalog_list(spark, sf):
    """All, by id, and what a party may see."""
    c = Catalog(spark)
    c.register(Dataset("open", "parquet", f"{sf}/region.parquet", "p"))
    c.register(Dataset("own", "parquet", f"{sf}/region.parquet", "p", visibility="PRIVATE"))
    found = {"all": c.list(), "by id": c.list(["own"]), "of another": c.list(party="q"), "own": c.list(party="p")}
    return said(spark, [(k, len(v)) for k, v in found.items()], "asked string, found int")


@query("SELECT 'regions' AS dataset, count(*) AS n FROM region UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def catalog_defaults(spark, sf):
    """Datasets listed in a file, one of them a table of a SQLite file."""
    path = there(spark, "defaults")
    tables.write_json({"datasets": [{"description": "regions", "model": "parquet", "source": f"{sf}/region.parquet"}, {"description": "suppliers", "model": "sqlite", "source": sqlite_file(spark, sf), "table_name": "supplier"}]}, f"{path}/d.json")
    c = Catalog(spark)
    listed = c.load_defaults(f"{path}/d.json")
    return reduce(lambda a, b: a.unionByName(b), [c.read(e.id).agg(F.lit(e.id).alias("dataset"), F.count("*").alias("n")) for e in listed])


@query("SELECT r_regionkey, r_name, true AS gone FROM region")
def catalog_transfer(spark, sf):
    """Uploaded, downloaded as CSV, and deleted with its files."""
    c, up, down = Catalog(spark), scratch(spark, "up"), scratch(spark, "down")
    c.upload("r", t(spark, sf, "region"), up)
    c.download("r", down)
    c.drop("r", data=True)
    fs, at = opened(up)
    gone = not c.list() and fs.get_file_info(at).type.name == "NotFound"
    return tables.read_csv(spark, down, t(spark, sf, "region").schema).withColumn("gone", F.lit(gone))


@query("SELECT 'l_tax' AS \"column\", round(avg(l_tax), 4) AS mean FROM lineitem")
def json_sink(spark, sf):
    """Statistics written as JSON and read again."""
    path = f"{there(spark, 'json')}/stats.json"
    stats.StatsPipeline({"mean": {"columns": ["l_tax"]}}).run(stats.split_parties(t(spark, sf, "lineitem").select("l_orderkey", "l_tax"), "l_orderkey", 2), path=path)
    return rounded(said(spark, [(r["column"], r["mean"]) for r in tables.read_json(path)["mean"]], "column string, mean double"), 4)


# Expressions, keys, lookups.

TEXTS = [("A+B", True), ("A+", False), ("(A", False), ("A)", False), ("A B", False), ("A**B", False), ("-A*(B-2)", True), ("", False), ("A%B", False), ("1..2", False), ("2.5*A", True), ("()", False)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {str(b).lower()})" for a, b in TEXTS) + ") x(text, valid)")
def expr_check(spark, sf):
    schema = T.StructType([T.StructField(c, T.LongType()) for c in "AB"])
    return said(spark, [(a, not refused(lambda a=a: expression.expression(a, schema))) for a, _ in TEXTS], "text string, valid boolean")


@query("SELECT * FROM (VALUES ('same', true), ('shorter', false), ('undeclared', false), ('text', false)) x(parties, accepted)")
def expr_parties(spark, sf):
    """Parties need as many rows each, and numbers of a declared type."""
    n = t(spark, sf, "nation").select("n_nationkey")
    schema = t(spark, sf, "nation").schema
    calls = {
        "same": lambda: expression.same_length([n, n]), "shorter": lambda: expression.same_length([n, n.where("n_nationkey > 3")]),
        "undeclared": lambda: expression.expression("n_nationkey+n_regionkey", schema, {"n_nationkey": "bigint"}), "text": lambda: expression.expression("n_name+1", schema),
    }
    return said(spark, [(k, not refused(f)) for k, f in calls.items()], "parties string, accepted boolean")


@query("SELECT o_orderkey, round((o_totalprice / o_custkey) * 65536) / 65536 AS d16, round((o_totalprice / o_custkey) * 4294967296) / 4294967296 AS d32 FROM orders")
def mpc_expr_accuracy(spark, sf):
    o = t(spark, sf, "orders")
    host, guest = o.select("o_orderkey", F.col("o_totalprice").alias("A")), o.select("o_orderkey", F.col("o_custkey").alias("B"))
    both = [expression.evaluate("A/B", [host, guest], "o_orderkey", f"d{d}", accuracy=f"D{d}") for d in (16, 32)]
    return both[0].join(both[1], "o_orderkey")


@query("SELECT n_nationkey, (n_nationkey * 3.0::DOUBLE - 7) / (n_regionkey + 1) AS result FROM nation")
def expr_local(spark, sf):
    """The evaluator without Spark's columns, over rows of the driver."""
    rows = t(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect()  # 25 rows
    return said(spark, [(r.n_nationkey, expression.value_of("(A*3.0-7)/(B+1)", {"A": r.n_nationkey, "B": r.n_regionkey})) for r in rows], "n_nationkey int, result double")


@query("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) * 100 < o_totalprice AS result FROM orders")
def mpc_cmp_mixed(spark, sf):
    """An integer column against a double one, by a task: the party with the lower number is compared with the other."""
    c, o = Catalog(spark), t(spark, sf, "orders")
    c.put("low", o.select("o_orderkey", (F.col("o_custkey") * 100).alias("x")))
    c.put("high", o.select("o_orderkey", F.col("o_totalprice").alias("y")))
    r = task.Runner(spark, c)
    return r.result(r.submit({"algorithm": "arithmetic", "parties": {"P10": "high", "P2": "low"}, "params": {"id": "o_orderkey", "compare": ["x", "y"]}}), "P2")


@query("SELECT p_partkey, CAST(floor(log2(p_retailprice)) + 1 AS INT) AS rank, CAST(floor(log2(p_retailprice / 4096)) + 1 AS INT) AS low FROM part")
def power_of_two_rank(spark, sf):
    x = F.col("p_retailprice")
    return t(spark, sf, "part").select("p_partkey", scalar.power_of_two_rank(x).alias("rank"), scalar.power_of_two_rank(x / 4096).alias("low"))


@query("SELECT p_partkey, 2 * p_size + 3 * p_retailprice AS a, p_size * -1 + 0.5 * p_retailprice AS b FROM part")
def matrix_product(spark, sf):
    row = F.array(F.col("p_size").cast("double"), "p_retailprice")
    m = scalar.matrix_product(row, [[2, -1], [3, 0.5]])
    return t(spark, sf, "part").select("p_partkey", F.get(m, F.lit(0)).alias("a"), F.get(m, F.lit(1)).alias("b"))


@query("SELECT vec_id, round(greatest(e[1], e[2], e[5], e[6], 0), 5) AS pooled_0, round(greatest(e[11], e[12], e[15], e[16], 0), 5) AS pooled_3 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def max_pool(spark, sf):
    """The first 16 values as a 4 x 4 image: ReLU, then the largest of each 2 x 2 window."""
    image = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 16), scalar.relu)
    p = scalar.max_pool(image, 4, 2, 2)
    return t(spark, sf, "embeddings").select("vec_id", F.round(F.get(p, F.lit(0)), 5).alias("pooled_0"), F.round(F.get(p, F.lit(3)), 5).alias("pooled_3"))


@query("SELECT * FROM (VALUES ('c_custkey', 'number'), ('c_name', 'other'), ('c_nationkey', 'number'), ('c_acctbal', 'number'), ('c_mktsegment', 'other')) x(\"column\", kind)")
def select_by_type(spark, sf):
    c = t(spark, sf, "customer")
    return said(spark, [(x, "number") for x in numeric_columns(c)] + [(x, "other") for x in other_columns(c)], "column string, kind string")


@query("SELECT * FROM (VALUES ('bigint', true), ('int', true), ('string', true), ('binary', true), ('double', false), ('boolean', false), ('none', false)) x(kind, accepted)")
def key_types(spark, sf):
    def ok(kind):
        df = t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").cast(kind).alias("k") if kind != "none" else F.lit(1).alias("j"))
        return not refused(lambda: keys.check_keys(df, ["k"]))

    return said(spark, [(k, ok(k)) for k in ("bigint", "int", "string", "binary", "double", "boolean", "none")], "kind string, accepted boolean")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey IN (3, 8, 150)")
def pir_table(spark, sf):
    """The server's table is built once, bucketed by its key, and used again."""
    name = "lookup_" + "".join(x if x.isalnum() else "_" for x in sf)
    part = t(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    lookup.build_lookup_table(part, "p_partkey", name, buckets=4, rebuild=True, path=scratch(spark, "lookup"))
    again = lookup.build_lookup_table(part.limit(0), "p_partkey", name)
    return lookup.keyword_lookup(lookup.query_frame(spark, [3, 8, 150, -1]), again, ["p_partkey"])


@query("SELECT * FROM (VALUES ('one column', false), ('too few keys', false), ('no such label', false), ('fine', true)) x(server, accepted)")
def pir_check(spark, sf):
    n, asked = t(spark, sf, "nation"), lookup.query_frame(spark, [1])
    calls = {
        "one column": lambda: lookup.keyword_lookup(asked, n.select("n_name")), "too few keys": lambda: lookup.keyword_lookup(asked, n, ["n_nationkey", "n_name"]),
        "no such label": lambda: lookup.keyword_lookup(asked, n, labels=["nope"]), "fine": lambda: lookup.keyword_lookup(asked, n),
    }
    return said(spark, [(k, not refused(f)) for k, f in calls.items()], "server string, accepted boolean")


@query("SELECT 100 - n_nationkey AS position, n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def data_align_registered(spark, sf):
    """The aligned rows are a dataset of their own."""
    c, n = Catalog(spark), t(spark, sf, "nation")
    c.put("table", n.select("n_nationkey", "n_name"))
    c.put("result", n.where("n_nationkey % 2 = 0").select((100 - F.col("n_nationkey")).alias("pos"), "n_nationkey"))
    task.Runner(spark, c).submit({"algorithm": "data_align", "parties": {"TABLE": "table", "RESULT": "result"}, "params": {"keys": ["n_nationkey"], "result_keys": ["n_nationkey"], "position": "pos", "new_dataset": "aligned"}})
    return c.read("aligned")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC LIMIT 3")
def sorted_batch(spark, sf):
    """In the order of the last column."""
    rows = lookup.sorted_by_last(t(spark, sf, "nation").select("n_nationkey", "n_name"))
    return said(spark, [tuple(r) for r in rows.collect()[-3:]], "n_nationkey int, n_name string")  # of 25 rows


@query("SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS masked, md5(c_name) AS digest, upper(trim('  ' || c_mktsegment || ' ')) AS segment, split_part(c_name || '####' || c_nationkey, '####', 2) AS part FROM customer")
def text_helpers(spark, sf):
    return t(spark, sf, "customer").select(
        "c_custkey", keys.key_value("c_custkey", True).alias("masked"), F.md5(F.col("c_name").cast("binary")).alias("digest"),
        F.upper(F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))).alias("segment"), F.get(scalar.parts(F.concat("c_name", F.lit("####"), "c_nationkey")), F.lit(1)).alias("part"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_parsing(spark, sf):
    return t(spark, sf, "events").select("event_id", scalar.json_value(F.col("props"), "k", "bigint").alias("k"))


@query("SELECT CAST(least(floor((l_discount - 0.0) / 0.02), 4) AS INT) AS bucket, count(*) AS n FROM (SELECT round(l_discount, 2) + 0.001 AS l_discount FROM lineitem) GROUP BY 1")
def histogram(spark, sf):
    b = scalar.histogram_bucket(F.round("l_discount", 2) + 0.001, 0.0, 0.1, 5)
    return t(spark, sf, "lineitem").select(F.coalesce(b, F.lit(4)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('VARCHAR(20)', 'string'), ('BigInt', 'bigint'), ('double', 'double'), ('Int', 'int'), ('NUMBER', 'string')) x(name, kind)")
def type_names(spark, sf):
    return said(spark, [(n, sql_type(n).simpleString()) for n in ("VARCHAR(20)", "BigInt", "double", "Int", "NUMBER")], "name string, kind string")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def declared_schema(spark, sf):
    """A dataset's schema given as Arrow's type ids."""
    path = scratch(spark, "declared")
    tables.write_csv(t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path)
    c = Catalog(spark)
    c.register(Dataset("d", "csv", path, schema=[{"id": 7}, {"name": 13}]))
    assert c.read("d").schema == declared([{"id": 7}, {"name": 13}])
    return c.read("d")


# Joint statistics as tasks.


@query("SELECT round(avg(l_discount), 4) AS l_discount, round(avg(l_quantity), 4) AS l_quantity FROM lineitem")
def mpc_task_document(spark, sf):
    """TaskDetail and ColumnInfo as written: the result is registered and written for each dataset."""
    c, li = Catalog(spark), t(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    for p, df in stats.split_parties(li, "l_orderkey", 3).items():
        c.put(p, df)
    out = scratch(spark, "document")
    detail = {"type": "1", "features": [{"resourceId": f"party{i}", "checked": ["l_quantity", "l_discount"]} for i in range(3)]}
    about = {f"party{i}": {"columns": {"l_quantity": 2, "l_discount": 2}, "newDataSetId": f"new{i}", "outputFilePath": f"{out}/{i}.csv"} for i in range(3)}
    r = task.Runner(spark, c)
    job = r.submit({"task_type": "ACTOR_TASK", "algorithm": "mpc_statistics", "parties": {f"P{i}": f"party{i}" for i in range(3)}, "params": {"TaskDetail": {"type": "OBJECT", "value": detail}, "ColumnInfo": {"type": "OBJECT", "value": about}}})
    assert r.fetch_status(job) is task.Status.SUCCESS
    return rounded(c.read("new2"), 4)


@query("SELECT * FROM (VALUES ('text column', false), ('no such statistic', false), ('numbers', true)) x(document, accepted)")
def mpc_type_gate(spark, sf):
    doc = lambda kind, code: {"TaskDetail": {"type": kind, "features": [{"resourceId": "d", "checked": ["x"]}]}, "ColumnInfo": {"d": {"columns": {"x": code}}}}
    calls = {"text column": doc(2, 0), "no such statistic": doc(7, 2), "numbers": doc(2, 3)}
    return said(spark, [(k, not refused(lambda d=d: task.statistics_document(d))) for k, d in calls.items()], "document string, accepted boolean")


@query("SELECT 0 AS columns_of_result")
def mpc_no_columns(spark, sf):
    """Nothing checked, nothing computed."""
    return said(spark, [(len(stats.joint(t(spark, sf, "lineitem"), "SUM", []).columns),)], "columns_of_result int")


@query("SELECT " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in LI) + " FROM lineitem")
def joint_of_parts(spark, sf):
    """From each party's own sums and counts."""
    parties = stats.split_parties(t(spark, sf, "lineitem").select("l_orderkey", *LI), "l_orderkey", 3)
    parts = [df.agg(*(F.sum(c) for c in LI), F.count("*")).first() for df in parties.values()]
    mean = stats.joint_of_parts("AVG", [list(p)[:-1] for p in parts], [[p[-1]] * len(LI) for p in parts])
    return rounded(said(spark, [tuple(mean)], ", ".join(f"{c} double" for c in LI)), 4)


@query("SELECT * FROM (VALUES ('col', 'var', true), ('row', 'var', false), ('row', 'norm', true), ('col', 'mode', false), ('diagonal', 'sum', false), ('col', 'quantile', true)) x(axis, name, known)")
def stats_dispatch(spark, sf):
    asked = [("col", "var"), ("row", "var"), ("row", "norm"), ("col", "mode"), ("diagonal", "sum"), ("col", "quantile")]
    return said(spark, [(a, n, not refused(lambda a=a, n=n: stats.statistic(n, a))) for a, n in asked], "axis string, name string, known boolean")


@query("SELECT * FROM (VALUES (-0.1, false), (0.0, true), (1.0, true), (1.5, false)) x(q, accepted)")
def quantile_range(spark, sf):
    d = t(spark, sf, "part")
    return said(spark, [(q, not refused(lambda q=q: stats.col_quantile(d, ["p_size"], [q], "KLL"))) for q in (-0.1, 0.0, 1.0, 1.5)], "q double, accepted boolean")


@query("SELECT 'l_discount' AS \"column\", round(avg(l_discount), 4) AS mean, round(var_pop(l_discount), 4) AS var FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 4), round(var_pop(l_tax), 4) FROM lineitem")
def stats_pipeline(spark, sf):
    """Horizontal: the columns that all parties have."""
    parties = stats.split_parties(t(spark, sf, "lineitem").select("l_orderkey", "l_discount", "l_tax", "l_quantity"), "l_orderkey", 3)
    parties["party1"] = parties["party1"].drop("l_quantity")
    f = stats.StatsPipeline({"mean": {}, "var": {}}).frames(parties)
    return rounded(f["mean"].join(f["var"], "column").where("column <> 'l_orderkey'"), 4)


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN -p_size::DOUBLE END AS s, p_retailprice AS r FROM part)
    SELECT 'guest' AS party, 'r' AS "column", round(avg(r), 4) AS value FROM p UNION ALL SELECT 'host', 's', round(avg(s), 4) FROM p UNION ALL SELECT 'both', 'sum', round(sum(coalesce(s, 0) + r), 4) FROM p""")
def stats_pipeline_vertical(spark, sf):
    """Vertical: each party's own columns, and rows over all of them."""
    host, guest = vertical(spark, sf)
    f = stats.StatsPipeline({"col_mean": {}, "row_sum": {}}, "V").frames({"host": host, "guest": guest}, key="p_partkey")
    rows = f["row_sum"].agg(F.lit("both").alias("party"), F.lit("sum").alias("column"), F.sum("sum").alias("value"))
    return rounded(f["col_mean"].select("party", "column", F.col("mean").alias("value")).unionByName(rows), 4)


@query("SELECT count(*) AS n, count(l_tax) AS taxes, count(l_discount) AS discounts FROM (SELECT l_orderkey, l_tax, NULL AS l_discount FROM lineitem WHERE l_orderkey % 2 = 0 UNION ALL SELECT l_orderkey, NULL, l_discount FROM lineitem WHERE l_orderkey % 2 = 1)")
def column_list_union(spark, sf):
    """Parties with different columns: the union of them, missing where a party has none."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_tax", "l_discount")
    parties = stats.split_parties(li, "l_orderkey", 2)
    parties = {"party0": parties["party0"].drop("l_discount"), "party1": parties["party1"].drop("l_tax")}
    assert stats.column_union(parties) == ["l_orderkey", "l_tax", "l_discount"]
    return stats.union(parties, missing=True).agg(F.count("*").alias("n"), F.count("l_tax").alias("taxes"), F.count("l_discount").alias("discounts"))


# Sketches: not their values, which no SQL can give, but that each is within the error that it promises.

_QS = [0.01, 0.25, 0.5, 0.9, 0.99]
_COLS = ["l_discount", "l_extendedprice", "l_quantity"]


def _ranks(name: str, error, **options):
    """Whether each value's ranks (below, and up to it) lie within the error of the rank asked for."""

    def run(spark, sf):
        df = missing(spark, sf)
        got = stats.col_quantile(df, _COLS, _QS, **options).collect()  # a row a column and quantile
        rank = df.agg(*(f for i, r in enumerate(got) for f in (F.avg((present(r.column) < r.value).cast("double")).alias(f"lo{i}"), F.avg((present(r.column) <= r.value).cast("double")).alias(f"hi{i}")))).first()
        out = []
        for i, r in enumerate(got):
            e = error(r.q)
            out.append((r.column, r.q, bool(rank[f"lo{i}"] <= r.q + e and rank[f"hi{i}"] >= r.q - e)))
        return said(spark, out, "column string, q double, within boolean")

    query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS q, true AS within" for c in _COLS for q in _QS), name)(run)


_ranks("col_quantile_kll", lambda q: 0.02, sketch="KLL")
_ranks("col_quantile_req", lambda q: 0.05 * (1 - q) + 0.001, sketch="REQ")
_ranks("col_quantile_req_low", lambda q: 0.05 * q + 0.001, sketch="REQ", is_hra=False)


@query("SELECT user_id AS item, count(*) AS \"count\" FROM events GROUP BY 1 HAVING count(*) >= 8 ORDER BY 2 DESC, 1 LIMIT 20")
def col_frequent_sketch(spark, sf):
    """No false positives: candidates of the sketch, counted again."""
    return stats.col_frequent_approximate(t(spark, sf, "events"), "user_id", 20, 100_000, "NFP", 8)


@query("SELECT event_type AS item, count(*) AS \"count\" FROM events GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 3")
def col_frequent_sketch_nfn(spark, sf):
    """No false negatives; all values fit, so the counts are exact."""
    return stats.col_frequent_approximate(t(spark, sf, "events"), "event_type", 3, error_type="NFN", min_freq=2)


# Cleaning.


@query(f"SELECT event_id, CASE WHEN u IS NULL OR u = 'NA' THEN NULL ELSE u END AS u, v FROM ({DIRTY})")
def missing_load(spark, sf):
    """As text, with the texts that stand for a missing value turned into NULL."""
    path = scratch(spark, "dirty")
    tables.write_csv(dirty(spark, sf), path)
    return clean.load_texts(spark, path, {"u": "bigint", "v": "double"}).withColumn("event_id", F.col("event_id").cast("bigint"))


@query("SELECT * FROM (VALUES ('same', true), ('other column', false), ('other type', false)) x(tables_of, accepted)")
def schema_check(spark, sf):
    n = t(spark, sf, "nation")
    calls = {"same": [n, n], "other column": [n, n.drop("n_name")], "other type": [n, n.withColumn("n_nationkey", F.col("n_nationkey").cast("string"))]}
    return said(spark, [(k, not refused(lambda v=v: clean.same_schema(v))) for k, v in calls.items()], "tables_of string, accepted boolean")


@query(f"""WITH n AS (SELECT event_id, TRY_CAST(u AS BIGINT) AS u, TRY_CAST(v AS DOUBLE) AS v FROM ({DIRTY}))
    SELECT event_id, coalesce(u, (SELECT CAST(sum(u) // count(u) AS BIGINT) FROM n)) AS u, round(coalesce(v, (SELECT avg(v) FROM n)), 6) AS v FROM n WHERE event_id % 2 = 0""")
def impute_registered(spark, sf):
    """By a task: replacements from all parties, doubles to six places, each party's table registered."""
    c = Catalog(spark)
    for p, df in stats.split_parties(dirty(spark, sf), "event_id", 2).items():
        c.put(p, df)
    params = {"columns": KIND, "replace": "AVG", "places": 6, "new_datasets": {"A": "clean0", "B": "clean1"}}
    task.Runner(spark, c).submit({"algorithm": "AbnormalProcessTask", "parties": {"A": "party0", "B": "party1"}, "params": params})
    return c.read("clean0")


@query(f"""WITH d AS ({DIRTY}), n AS (SELECT event_id, u, v, TRY_CAST(u AS BIGINT) AS nu, TRY_CAST(v AS DOUBLE) AS nv FROM d), f AS (SELECT CAST(floor(sum(nu) / count(nu)) AS BIGINT) AS fu, avg(nv) AS fv FROM n)
    SELECT event_id, CAST(CASE WHEN u = 'bad' THEN fu ELSE nu END AS DOUBLE) AS u, round(CASE WHEN v = '1x' THEN fv ELSE nv END, 6) AS v, CASE WHEN event_id % 3 = 0 THEN 'NA' ELSE 'x' END AS note FROM n, f""")
def abnormal_table(spark, sf):
    """A table's repair, written as CSV and registered; missing texts become NA."""
    c = Catalog(spark)
    c.put("d", dirty(spark, sf).withColumn("note", F.when(F.col("event_id") % 3 != 0, "x")))
    task.Runner(spark, c).submit({"algorithm": "abnormal", "parties": {"P": "d"}, "params": {"columns": KIND, "new_datasets": {"P": "d_abnormal"}}})
    return c.read("d_abnormal").withColumn("u", F.col("u").cast("double"))


# User code and tasks.


@task.function("spent_by_customer")
def _spent(party, df, args):
    return df.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice") * args["scale"], 2).alias("spent"))


@query("SELECT o_custkey, round(sum(o_totalprice) * 2, 2) AS spent FROM orders GROUP BY 1")
def python_task(spark, sf):
    """A registered function, by its name in a task."""
    c = Catalog(spark)
    c.put("o", t(spark, sf, "orders"))
    r = task.Runner(spark, c)
    job = r.submit({"algorithm": "python", "parties": {"A": "o"}, "params": {"function": "spent_by_customer", "args": {"scale": 2}}})
    return r.result(job, "A")


@task.plugin("counter", "host")
class _Host:
    def __init__(self, role, df, params):
        self.role, self.df, self.params = role, df, params

    def run(self):
        return self.df.agg(F.lit(self.role).alias("role"), F.count("*").alias("n"))


@task.plugin("counter", "guest")
class _Guest(_Host):
    def run(self):
        return self.df.where(F.col("n_regionkey") == self.params["region"]).agg(F.lit(self.role).alias("role"), F.count("*").alias("n"))


@query("SELECT 'host' AS role, count(*) AS n FROM nation UNION ALL SELECT 'guest', count(*) FROM nation WHERE n_regionkey = 2")
def model_plugin(spark, sf):
    """A class for each role of a model."""
    c = Catalog(spark)
    c.put("n", t(spark, sf, "nation"))
    r = task.Runner(spark, c)
    job = r.submit({"algorithm": "model", "parties": {"A": "n", "B": "n"}, "params": {"model": "counter", "roles": {"A": "host", "B": "guest"}, "options": {"region": 2}}})
    return r.result(job, "A").unionByName(r.result(job, "B"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_tax * l_tax), 4) AS squares FROM lineitem GROUP BY 1")
def custom_aggregate(spark, sf):
    """A state of own making, added up in tasks, then merged."""
    add = lambda a, b: {"n": a["n"] + b["n"], "squares": a["squares"] + b["squares"]}
    li = t(spark, sf, "lineitem").select("l_returnflag", "l_tax")
    return rounded(udf.custom_aggregate(li, ["l_returnflag"], lambda x: {"n": len(x), "squares": float((x["l_tax"] ** 2).sum())}, add, "l_returnflag string, n long, squares double"), 4)


@query("SELECT p_partkey, upper(p_name) || '!' AS shout FROM part")
def batch_map(spark, sf):
    return udf.batch_map(t(spark, sf, "part").select("p_partkey", "p_name"), lambda x: x.assign(shout=x["p_name"].str.upper() + "!")[["p_partkey", "shout"]], "p_partkey long, shout string")


@query("""SELECT * FROM (VALUES ('finished', 'SUCCESS'), ('submitted twice', 'SUCCESS'), ('unknown', 'NONEXIST'), ('failed', 'FAIL'), ('killed', 'FAIL'), ('updated', 'FINISHED'), ('not revealed', 'refused'), ('wrong kind', 'refused'),
    ('unsupported', 'refused'), ('rows', '25')) x(job, outcome)""")
def task_control(spark, sf):
    """Submitted, submitted again, failed, killed while it ran, and what is refused."""
    import time

    c = Catalog(spark)
    c.put("n", t(spark, sf, "nation"))
    r, seen = task.Runner(spark, c), {}
    params = {"keys": ["n_nationkey"]}
    doc = {"job_id": "a", "task_type": "PSI_TASK", "algorithm": "psi", "parties": {"CLIENT": "n", "SERVER": "n"}, "params": params, "reveal_to": ["CLIENT"]}
    seen["finished"] = r.fetch_status(r.submit(doc)).value
    seen["submitted twice"] = r.fetch_status(r.submit(doc | {"parties": {}})).value
    seen["unknown"] = r.fetch_status("zz").value
    r.wait(r.start(doc | {"job_id": "b", "parties": {"CLIENT": "zz"}}))
    seen["failed"] = r.fetch_status("b").value

    @task.function("waits")
    def waits(party, df, args):
        def slow(frames):
            time.sleep(60)
            yield from frames

        df.mapInPandas(slow, df.schema).count()
        return df

    job = r.start({"job_id": "k", "algorithm": "python", "parties": {"A": "n"}, "params": {"function": "waits"}})
    time.sleep(1.5)
    assert r.fetch_status(job) is task.Status.RUNNING
    r.kill(job)
    seen["killed"] = r.wait(job, 30).value
    r.update_status("u", "FINISHED")
    seen["updated"] = r.fetch_status("u").value
    for k, f in {
        "not revealed": lambda: r.result("a", "SERVER"), "wrong kind": lambda: r.submit(doc | {"job_id": "w", "task_type": "PIR_TASK"}), "unsupported": lambda: r.submit({"algorithm": "maxpool", "parties": {}}),
    }.items():
        seen[k] = "refused" if refused(f) else "done"
    seen["rows"] = str(r.result("a", "CLIENT").count())
    return said(spark, list(seen.items()), "job string, outcome string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3")
def task_output(spark, sf):
    """A result that goes to the parties that a task names, as files."""
    c, out = Catalog(spark), scratch(spark, "output")
    c.put("n", t(spark, sf, "nation").select("n_nationkey", "n_name"))
    c.put("m", t(spark, sf, "nation").where("n_regionkey = 3").select("n_nationkey"))
    task.Runner(spark, c).submit({"algorithm": "psi", "parties": {"CLIENT": "n", "SERVER": "m"}, "params": {"keys": ["n_nationkey"]}, "reveal_to": ["CLIENT"], "output": {"CLIENT": out}})
    return tables.read_csv(spark, out, T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())]))


@query("SELECT c_custkey AS id, c_acctbal AS x FROM customer WHERE c_custkey <= 40 UNION ALL SELECT -1, 0.5")
def align_missing_keys(spark, sf):
    """A missing key equals a missing one, in alignment and in the join after it."""
    c = t(spark, sf, "customer").where("c_custkey <= 40").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    host = c.unionByName(said(spark, [(None, 0.5)], "id long, x double"))
    guest = host.select("id", F.lit(1).alias("y"))
    host, guest = psi.align_samples(host, guest, "id")
    return psi.aligned_join(host, guest, "id").select(F.coalesce("id", F.lit(-1).cast("long")).alias("id"), "x")


@query(f"SELECT count(*) AS rows_kept, 0.2 AS share FROM (SELECT * FROM ({CUST}) LIMIT (SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) FROM customer))")
def subsample(spark, sf):
    """A share of rows without replacement, as many as its ceiling says."""
    from math import ceil

    df = customers(spark, sf)
    n = df.count()
    return df.orderBy(F.rand(7)).limit(ceil(0.2 * n)).agg(F.count("*").alias("rows_kept"), F.lit(0.2).alias("share"))
