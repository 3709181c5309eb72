"""Exact nearest-rank quantiles of groups too large to collect: ranks from counts of distinct values, by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Even ranges between a group's least and greatest number, of which one holds the rank.
EVEN = 1024


def _holding(ranges: DataFrame) -> DataFrame:
    """(__key, __b, __rank): of (__key, __b, __m, __rank) the range that holds the rank, and the rank inside."""
    upto = F.sum("__m").over(Window.partitionBy("__key").orderBy("__b"))
    chosen = ranges.withColumn("__upto", upto).where((F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__m") <= F.col("__rank")))
    return chosen.select("__key", "__b", (F.col("__rank") - F.col("__upto") + F.col("__m")).alias("__rank"))


def _by_key(df: DataFrame, keys: list[str], value: str, percent: float, name: str, buckets: int) -> DataFrame:
    """(__key, quantile) by a struct of the keys, in which nulls equal each other.

    Numbers are counted where they are read, by EVEN ranges of each group, and only the range that holds the rank goes on. Its
    values are counted each. Approximate cuts part them into ``buckets`` ranges; their counts tell in which one the rank lies, and
    only that range's values are put in order.
    """
    key = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(1))
    rows = df.where(F.col(f"`{value}`").isNotNull()).select(key.alias("__key"), F.col(f"`{value}`").alias("__v"))
    facts = rows.groupBy("__key").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__all"))
    ranks = facts.select("__key", F.floor(F.lit(percent / 100.0) * (F.col("__all") - 1) + 0.5).alias("__rank"))
    if rows.schema["__v"].dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "decimal"):
        v, lo, hi = (F.col(c).cast("double") for c in ("__v", "__lo", "__hi"))
        # Each step keeps the order; a group with NaN or without a finite width stays one range.
        width = hi - lo
        even = F.when((width > 0) & (width < float("inf")), F.floor((v - lo) / width * EVEN).cast("long")).otherwise(F.lit(0).cast("long"))
        placed = rows.join(facts.select("__key", "__lo", "__hi"), "__key").select("__key", "__v", even.alias("__b"))
        chosen = _holding(placed.groupBy("__key", "__b").agg(F.count(F.lit(1)).alias("__m")).join(ranks, "__key"))
        rows, ranks = placed.join(chosen.select("__key", "__b"), ["__key", "__b"]).select("__key", "__v"), chosen.select("__key", "__rank")
    counts = rows.groupBy("__key", "__v").agg(F.count(F.lit(1)).alias("__n"))
    bounds = counts.groupBy("__key").agg(F.percentile_approx("__v", [k / buckets for k in range(1, buckets)], 1000).alias("__cuts"))
    placed = counts.join(bounds.select("__key", "__cuts"), "__key").select("__key", "__v", "__n", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__b"))
    chosen = _holding(placed.groupBy("__key", "__b").agg(F.sum("__n").alias("__m")).join(ranks, "__key"))
    ended = placed.join(chosen, ["__key", "__b"]).withColumn("__end", F.sum("__n").over(Window.partitionBy("__key").orderBy("__v")))
    return ended.where((F.col("__end") > F.col("__rank")) & (F.col("__end") - F.col("__n") <= F.col("__rank"))).select("__key", F.col("__v").alias(name))


def grouped_quantile(df: DataFrame, keys: list[str], value: str, percent: float = 50, name: str = "quantile", buckets: int = 64) -> DataFrame:
    """One row for each group that has a value, with the one at rank round(q * (n - 1)); no group is in one task."""
    return _by_key(df, keys, value, percent, name, buckets).select(*[F.col("__key").getField(k).alias(k) for k in keys], name)


def with_quantile(df: DataFrame, keys: list[str], value: str, percent: float, name: str, buckets: int = 64) -> DataFrame:
    """``df`` and its group's quantile in every row; null where the group has no value."""
    key = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(1))
    found = _by_key(df, keys, value, percent, name, buckets)
    return df.withColumn("__key", key).join(found, "__key", "left").drop("__key")
