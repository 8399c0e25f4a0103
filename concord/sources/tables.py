"""Sources and sinks. A reader takes (spark, source, schema or None, options) and gives a DataFrame."""

from __future__ import annotations

import csv
import json
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.files import numbered, opened
from concord.types import sql_type

PREVIEW = 100
BOM = "﻿"


def clean_name(name: str) -> str:
    """A header field without byte-order mark, line ends and quotes around it."""
    return name.strip(BOM + "\r\n ").strip('"')


def infer_csv(spark: SparkSession, path: str, sep: str = ",", lines: int = PREVIEW) -> T.StructType:
    """Names from the header, types from the first lines."""
    head = [r.value for r in spark.read.text(path).limit(lines + 1).collect()]
    if not head:
        return T.StructType([])
    # The separator may stand inside a quoted name.
    names = [clean_name(x) for x in next(csv.reader([head[0].lstrip(BOM)], delimiter=sep), [])]
    sample = spark.createDataFrame([(x,) for x in head[1:]] or [("",)], "value string")
    kinds = spark.read.csv(sample.rdd.map(lambda r: r.value), sep=sep, inferSchema=True).schema.fields if head[1:] else []
    kinds = [f.dataType for f in kinds] + [T.StringType()] * (len(names) - len(kinds))
    return T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=False)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, options: dict | None = None) -> DataFrame:
    """Strict: a value that does not fit the schema is an error. options: sep, header, columns (places)."""
    o = options or {}
    sep = o.get("sep", ",")
    schema = schema or infer_csv(spark, path, sep)
    df = spark.read.csv(path, schema=schema, sep=sep, header=o.get("header", True), mode="FAILFAST", enforceSchema=True)
    return project(df, o["columns"]) if o.get("columns") else df


def project(df: DataFrame, places: list[int]) -> DataFrame:
    """Columns by place."""
    bad = [i for i in places if not 0 <= i < len(df.columns)]
    if bad:
        raise IndexError(f"column places out of range: {bad}")
    return df.select([df.columns[i] for i in places])


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema, each cast to its type."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def as_strings(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, options: dict | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return cast_to(df, schema) if schema else df


def read_sqlite(spark: SparkSession, path: str, schema: T.StructType | None = None, options: dict | None = None, rows: int = 50_000) -> DataFrame:
    """A table of a SQLite file that every executor can open; rowid ranges are read in parallel."""
    name = (options or {})["table"]
    quoted = '"' + name.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        found = db.execute(f"PRAGMA table_info({quoted})").fetchall()
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {quoted}").fetchone()
    schema = schema or T.StructType([T.StructField(c[1], sql_type(c[2])) for c in found])
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    picked = ", ".join('CAST("' + f.name.replace('"', '""') + '" AS TEXT)' for f in schema)

    def run(frames):
        import pandas as pd

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for frame in frames:
                for start in frame["id"]:
                    got = db.execute(f"SELECT {picked} FROM {quoted} WHERE rowid >= ? AND rowid < ?", (int(start), int(start) + rows)).fetchall()
                    yield pd.DataFrame(got, columns=texts.names)

    return cast_to(spark.range(low, high + 1, rows).mapInPandas(run, texts), schema)


def read_jdbc(spark: SparkSession, url: str, schema: T.StructType | None = None, options: dict | None = None) -> DataFrame:
    """options as Spark's jdbc source takes them (table is short for dbtable); give partitionColumn and its bounds for large tables."""
    o = {("dbtable" if k == "table" else k): str(v) for k, v in (options or {}).items()}
    df = spark.read.format("jdbc").options(url=url, **o).load()
    return cast_to(df, schema) if schema else df


def read_images(spark: SparkSession, path: str, schema: T.StructType | None = None, options: dict | None = None) -> DataFrame:
    """Annotations (a CSV with file_name) joined with the files of a folder."""
    notes = read_csv(spark, options["annotations"], schema)
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "content")
    return notes.join(files, "file_name")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in an order that must be given; rows before them are counted by ranges, not brought to one task."""
    if not order:
        raise ValueError("a page needs an order")
    return numbered(df, order, "_row").where((F.col("_row") >= offset) & (F.col("_row") < offset + limit)).drop("_row")


def preview(df: DataFrame, n: int = PREVIEW) -> DataFrame:
    return df.limit(n)


def lenient_number(c: str, kind: str) -> F.Column:
    """A string as a number; what is none is 0."""
    return F.coalesce(F.col(c).try_cast(kind), F.lit(0).cast(kind))


def selected(df: DataFrame, columns: list[str] | None = None, dropped: list[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).drop(*(dropped or []))


def mini_batches(df: DataFrame, batches: int, seed: int = 0) -> list[DataFrame]:
    """Random parts of about equal size, without replacement."""
    return df.randomSplit([1.0] * batches, seed)


def step_batch(df: DataFrame, step: int, batches: int, seed: int = 0) -> DataFrame:
    """The rows of one step: an epoch has ``batches`` steps, each row is in one of them, and each epoch deals the rows anew.

    A row's step comes from a hash of the row, so it does not depend on how rows are partitioned.
    """
    epoch, at = divmod(step, batches)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), *(F.col(f"`{c}`") for c in df.columns)), F.lit(batches)) == at)


def write_csv(df: DataFrame, path: str, one_file: bool = False, bom: bool = False) -> None:
    """A folder of CSV parts with headers; with bom each header starts with a byte-order mark and its names are not quoted."""
    df = df.coalesce(1) if one_file else df
    if not bom:
        df.write.mode("overwrite").csv(path, header=True)
        return
    # The header line is written as it is, before the rows of its part.
    names = df.columns
    marked = df.select(*(F.col(f"`{c}`").alias((BOM if i == 0 else "") + c) for i, c in enumerate(names)))
    marked.write.mode("overwrite").csv(path, header=True, quoteAll=False)


def write_json(values: dict, path: str) -> None:
    """A small result or model of the driver."""
    fs, at = opened(path)
    fs.create_dir(at.rpartition("/")[0] or ".", recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(json.dumps(values, indent=1, default=str).encode())


def read_json(path: str) -> dict:
    fs, at = opened(path)
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())
