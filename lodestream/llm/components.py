"""Connected components by alternating star operations on an edge table.

What a star operation returns is dealt by the greater node, which has few rows there, so that the next one needs no
shuffle to group and join by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, swept


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's greater neighbours get the least of its neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").repartition("u").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours get the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").repartition("u").distinct()


def components(edges: DataFrame, rounds: int | None = None, sweep: bool = False) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v) but the roots themselves; a root is its component's least node.

    After a given number of ``rounds``, a node may have several roots, and a root one of its own: edges that connect the same nodes.
    Each round is written to the shared checkpoint folder; rounds grow with the logarithm of the longest path. With ``sweep``, files of
    earlier rounds go at once.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = checkpointed(now)
    before = None
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = checkpointed(_small_star(_large_star(now)))
        if sweep:
            swept(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
