"""Physical plans: nothing that gathers all rows in one task, and no nested loops over unbounded sides."""

import os

import pytest

from lodestream.plans.catalogue import QUERIES, session

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def windows_alone(text):
    """Windows right above an exchange to a single partition."""
    lines = text.splitlines()
    return [a for a, b in zip(lines, lines[1:] + [""]) if "Window [" in a and any("SinglePartition" in x for x in lines[lines.index(a) : lines.index(a) + 4])]


@pytest.mark.parametrize("name", ["row_number", "any_inequality", "all_inequality", "not_in_subquery", "all_distinct", "agg_quantile", "any_subquery", "join_row_number", "join_quantile"])
def test_no_single_task(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert not windows_alone(text)
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    assert "collect_list" not in text


def test_filters_reach_the_scan(spark):
    text = plan(session(spark, DATA).query("SELECT l_orderkey FROM lineitem WHERE l_extendedprice > 30000"))
    assert "GreaterThan(l_extendedprice" in text and "ReadSchema: struct<l_orderkey" in text and "l_comment" not in text


def test_time_ranges_reach_the_scan(spark):
    text = plan(QUERIES["ranged_scan"](spark, DATA))
    assert "GreaterThanOrEqual(_time" in text and "LessThanOrEqual(_time" in text


def test_table_text(spark):
    from lodestream.sources.sinks import table_text

    assert table_text(spark.sql("SELECT 1 AS a, 'xyz' AS name UNION ALL SELECT NULL, 'q'")) == "a | name\n1 | xyz\n  | q"


def test_late_rows_are_dropped(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestream.streaming.windows import by_window_stream

    rows = lambda *minutes: spark.createDataFrame([(m * 60,) for m in minutes], "s long").select(F.timestamp_seconds("s").alias("at"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = spark.readStream.schema("at timestamp").parquet(source) if rows(0, 30, 200).write.parquet(source) is None else None
    started = lambda: by_window_stream(stream, "at", "1h", "10 minutes", F.count(F.lit(1)).alias("n")).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    started()
    rows(10, 190, 400).write.mode("append").parquet(source)  # minute 10 comes after its window has closed
    started()
    got = {r["_time"]: r["n"] for r in spark.read.parquet(out).collect()}
    assert got == {0: 2, 10_800_000: 2}
