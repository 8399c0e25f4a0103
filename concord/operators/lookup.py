"""Keyword lookup (private retrieval's result) and alignment of a table to an intersection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.files import numbered
from concord.operators.keys import PREFIX, keyed_pair, with_keys
from concord.types import require_columns


def query_frame(spark: SparkSession, keys: list, name: str = "key") -> DataFrame:
    """Literal keys, or tuples of them, as a set."""
    rows = [k if isinstance(k, tuple) else (k,) for k in keys]
    width = {len(r) for r in rows}
    if len(width) != 1:
        raise ValueError("keys of one width are needed")
    names = [name] if width == {1} else [f"{name}{i}" for i in range(width.pop())]
    return spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"{n} string" for n in names)).distinct()


def keyword_lookup(queries: DataFrame, server: DataFrame, keys: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """All server rows of each queried key; keys without rows give none. keys: the server's, by default its first column."""
    if len(server.columns) < 2:
        raise ValueError("the server's table needs a key and at least one more column")
    keys = list(dict.fromkeys(keys or server.columns[:1]))
    if len(queries.columns) != len(keys):
        raise ValueError("the queries need as many columns as the server has keys")
    labels = labels or [c for c in server.columns if not c.startswith(PREFIX)]
    require_columns(server, labels)
    offline = [f"{PREFIX}{i}" for i in range(len(keys))]
    if set(offline) <= set(server.columns):
        # A table by build_lookup_table has its keys at hand, and is dealt by them.
        asked, _ = with_keys(queries, queries.columns)
        return server.join(asked.select(offline).distinct(), offline, "left_semi").select(*labels)
    rows, asked, _, equal = keyed_pair(server, keys, queries, queries.columns)
    return rows.join(asked, equal, "left_semi").select(*labels)


def build_lookup_table(server: DataFrame, keys: str | list[str], table: str, buckets: int = 64, rebuild: bool = False, path: str | None = None) -> DataFrame:
    """The server's offline part: a table bucketed and sorted by the text of its keys, so that lookups do not shuffle it.

    A table of that name that is there already is used as it is, unless rebuild.
    path: where its files go, if not to the warehouse.
    """
    spark = server.sparkSession
    if rebuild or not spark.catalog.tableExists(table):
        rows, names = with_keys(server, [keys] if isinstance(keys, str) else keys)
        writer = rows.write.mode("overwrite").bucketBy(buckets, *names).sortBy(*names)
        (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def row_lookup(server: DataFrame, order: list[str], places: list[int]) -> DataFrame:
    """Rows by place (from 0) in a given order; places come from counts by ranges, so no task sees all rows."""
    if not places or min(places) < 0:
        raise ValueError("places from 0 are needed")
    return numbered(server, order).where(F.col("row_index").isin(places))


def align(table: DataFrame, keys: list[str], result: DataFrame, result_keys: list[str], position: str) -> DataFrame:
    """One table row for each result row, numbered by the result's position; of rows with one key the first by all columns."""
    asked, names = with_keys(result.select(position, *result_keys), result_keys)
    rows, _ = with_keys(table, keys)
    rows = rows.join(asked.select(names).distinct(), names, "left_semi")
    first = F.struct(*(c for c in table.columns))
    one = rows.groupBy(names).agg(F.min(first).alias("_row"))
    return asked.select(position, *names).join(one, names).select(F.col(position).alias("position"), "_row.*")


def sorted_by_last(rows: DataFrame) -> DataFrame:
    """Rows of a batch in the order of their last column."""
    return rows.orderBy(rows.columns[-1])


def check_aligned(aligned: DataFrame, result: DataFrame) -> None:
    got, want = aligned.count(), result.count()
    if got != want:
        raise ValueError(f"{got} rows are aligned, the result has {want}")
