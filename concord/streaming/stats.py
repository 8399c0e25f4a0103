"""The mergeable statistics over windows of event time, as Structured Streaming. An extension: batch parity is in operators.stats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.types import present


def windowed(events: DataFrame, time: str, columns: list[str], every: str = "1 hour", late: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Count, sum, mean, min, max and population variance of columns for each window (and group); works on streams and tables."""
    # A watermark needs an instant; a local time is taken in the session's zone.
    df = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    stats = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "var": F.var_pop}
    out = df.groupBy(F.window(time, every), *(by or [])).agg(F.count("*").alias("rows"), *(f(present(c)).alias(f"{c}_{n}") for c in columns for n, f in stats.items()))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(by or []), "rows", *(f"{c}_{n}" for c in columns for n in stats))


def matching(events: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """A stream's rows whose key a table has: an intersection that goes on."""
    return events.join(keys.select(key).distinct(), key, "left_semi")


def run_once(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into a table in memory; for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
