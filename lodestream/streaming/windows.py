"""Event-time windows over a stream: the tumbling window of the dialect with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import width_ms


def by_window_stream(stream: DataFrame, timestamp: str, width: str, late: str, *aggregates: Column) -> DataFrame:
    """Windows of ``width`` as rows (_time = start in epoch milliseconds, aggregates); rows later than ``late`` are dropped."""
    w = f"{width_ms(width)} milliseconds"
    grouped = stream.withWatermark(timestamp, late).groupBy(F.window(timestamp, w)).agg(*aggregates)
    return grouped.select(F.unix_millis(F.col("window.start")).alias("_time"), *[F.col(c) for c in grouped.columns if c != "window"])


def run_by_window(stream: DataFrame, rows: DataFrame, timestamp: str, width: str, late: str, folder: str, *aggregates: Column) -> DataFrame:
    """Windows of all that ``stream`` holds now, in append mode: what the watermark closes goes to a table in ``folder``.

    Rows later than ``late`` are dropped. The windows that are still open at the end come from ``rows``, the same source
    as a table, of which only the stretch past the watermark is read.
    """
    spark = stream.sparkSession
    made = by_window_stream(stream, timestamp, width, late, *aggregates)
    running = made.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    closed = spark.read.schema(made.schema).parquet(f"{folder}/rows")
    w = width_ms(width)
    edge = rows.agg((F.max(timestamp) - F.expr(f"INTERVAL {late}")).alias("t")).first()["t"]
    if edge is None:
        return closed
    start = F.unix_millis(timestamp) - F.pmod(F.unix_millis(timestamp), F.lit(w))
    tail = rows.where(F.timestamp_millis(start + w) > F.lit(edge)).groupBy(start.alias("_time")).agg(*aggregates)
    return closed.unionByName(tail)


def sessions_stream(stream: DataFrame, timestamp: str, gap: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Sessions of rows less than ``gap`` apart, by keys."""
    g = f"{width_ms(gap)} milliseconds"
    grouped = stream.withWatermark(timestamp, late).groupBy(*keys, F.session_window(timestamp, g)).agg(*aggregates)
    return grouped.select(*keys, F.unix_millis(F.col("session_window.start")).alias("_start_time"), F.unix_millis(F.col("session_window.end")).alias("_end_time"), *[F.col(c) for c in grouped.columns if c not in (*keys, "session_window")])


def into_store(stream: DataFrame, store, table: str, checkpoint: str):
    """A stream appended to a stored table, batch by batch."""
    return stream.writeStream.foreachBatch(lambda df, _: store.into(table, df)).option("checkpointLocation", checkpoint).start()
