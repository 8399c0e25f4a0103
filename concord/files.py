"""Files that the driver and all executors share; row numbers that need no single task."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where that is absent and Spark is one process (tests) a temporary folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = getattr(shared_dir, "own", None)
        if own is None or not os.path.isdir(own):
            own = shared_dir.own = tempfile.mkdtemp(prefix="concord-")
            atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        root = f"file://{own}"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the shared folder; removed when this process ends, for results may be read from it until then."""
    path = f"{shared_dir(spark)}/concord/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: [remove(x) for x in _made])
    _made.append(path)
    return path


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def remove(path: str) -> None:
    """Removes a file or folder that nothing reads any more; what cannot be removed stays."""
    try:
        fs, at = opened(path)
        (fs.delete_dir if fs.get_file_info(at).type is pafs.FileType.Directory else fs.delete_file)(at)
    except (OSError, ValueError):
        return


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back, which cuts its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list, folder: str) -> DataFrame:
    """df in ranges of an order, written once: with _part, the range, and _nth, the place in it (from 0).

    Numbers of one place are of one run, so totals by _part can be joined back.
    """
    spark = df.sparkSession
    parts = df.rdd.getNumPartitions() if spark.conf.get("spark.sql.adaptive.enabled") != "true" else int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # That id is the partition's number and, in its low 33 bits, the row's in it.
    return stored(dealt.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_nth": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), folder)


def before(rows: DataFrame, sums: dict) -> DataFrame:
    """For each range the sums of the ranges before it; one row a range, joined back to rows as _before_<name>."""
    totals = rows.groupBy("_part").agg(*(v.alias(f"_t_{n}") for n, v in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shuffle partition
    base = totals.select("_part", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums))
    return rows.join(F.broadcast(base), "_part")


def numbered(df: DataFrame, order: list, name: str = "row_index", folder: str | None = None) -> DataFrame:
    """df with each row's place (from 0) in an order. Ranges are numbered by themselves, so no task sees all rows."""
    rows = ranged(df, order, folder or scratch(df.sparkSession, "numbered"))
    return before(rows, {"n": F.count("*")}).withColumn(name, F.col("_before_n") + F.col("_nth")).drop("_part", "_nth", "_before_n")
